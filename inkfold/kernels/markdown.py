"""Markdown nodes to normalised Markdown text."""

from __future__ import annotations

import re
from typing import Any

from .blocks import parse
from .model import Document, Node, Options, deep
from .scalars import sanitize_url
from .tags import stripped

_SPECIAL = re.compile(r"([\\`*_\[\]<>~=|])")
_START = re.compile(r"(?m)^([ \t]*)([-+#>])")


class Compiler:
    """Renders one document. Options: reference_links, setext, keep_frontmatter."""

    def __init__(self, doc: Document, reference_links: bool = False, setext: bool = False, keep_frontmatter: bool = True) -> None:
        self.doc, self.reference_links, self.setext, self.front = doc, reference_links, setext, keep_frontmatter
        self.made: list[tuple[str, str | None]] = []

    def document(self) -> str:
        nodes, front = self.doc.nodes, []
        if nodes and nodes[0].type == "frontmatter":  # it stays first, else it would be none when read again
            nodes, front = nodes[1:], nodes[:1] if self.front else []
        parts = [p for p in (*(x.text for x in front), self.definitions(), *(self.block(x) for x in nodes)) if p]
        if self.made:
            parts.append("\n".join(f"[ref{k}]: {t}{self.title(n)}" for k, (t, n) in enumerate(self.made, 1)))
        return "\n\n".join(parts)

    def definitions(self) -> str:
        safe = [r for r in self.doc.refs.values() if r.footnote or sanitize_url(r.target) is not None]
        return "\n".join(f"[{r.label}]: {r.target}{self.title(r.title)}" for r in sorted(safe, key=lambda r: (not r.label.isdigit(), int(r.label) if r.label.isdigit() else r.ord)))

    @staticmethod
    def title(title: str | None) -> str:
        return f' "{title.replace(chr(92), chr(92) * 2).replace(chr(34), chr(92) + chr(34))}"' if title else ""

    def inline(self, nodes: list[Node]) -> str:
        return "".join(self.span(x) for x in nodes)

    def span(self, x: Node) -> str:
        match x.type:
            case "text":
                return _START.sub(r"\1\\\2", _SPECIAL.sub(r"\\\1", x.text or ""))
            case "codeInline":
                text = x.text or ""
                fence = "`" * (max((len(m) for m in re.findall("`+", text)), default=0) + 1)
                pad = " " if text[:1] == "`" or text[-1:] == "`" else ""
                return f"{fence}{pad}{text}{pad}{fence}"
            case "textFormatted":
                mark = {"em": "*", "strong": "**", "del": "~~", "mark": "=="}[x.tag]
                return mark + self.inline(x.children) + mark
            case "link" | "image":
                text = self.inline(x.children) if x.type == "link" else x.alt or ""
                bang = "!" if x.type == "image" else ""
                if self.reference_links and x.target:
                    self.made.append((x.target, x.title))
                    return f"{bang}[{text}][ref{len(self.made)}]"
                return f"{bang}[{text}]({x.target or ''}{self.title(x.title)})"
            case "footnoteReference":
                return f"[^{x.text}]"
            case "breakLine":
                return "  \n"
            case "gfmTask":
                return "[x]" if x.completed else "[ ]"
            case "htmlBlock":
                inner = self.inline(x.children) if x.children else stripped(x.text or "")
                return inner if x.loose else f"{stripped(x.raw_open)}{inner}</{x.tag}>"
            case "htmlSelfClosing":
                return stripped(x.raw_open or "")
            case "htmlComment":
                return stripped(x.text or "")
        return self.block(x)

    def block(self, x: Node) -> str:
        match x.type:
            case "paragraph":
                return self.inline(x.children)
            case "heading":
                text = self.inline(x.children)
                if self.setext and x.level <= 2 and text:
                    return f"{text}\n{('=' if x.level == 1 else '-') * max(1, len(text.encode('utf-16-le')) // 2)}"
                return "#" * x.level + " " + text
            case "breakThematic":
                return "---"
            case "codeBlock":
                fence = "`" * max(3, max((len(m) for m in re.findall("`+", x.text or "")), default=0) + 1)
                return f"{fence}{x.lang or ''}\n{x.text or ''}\n{fence}"
            case "blockQuote":
                body = "\n\n".join(self.block(c) for c in x.children)
                lines = ([f"[!{x.alert}]"] if x.alert else []) + (body.split("\n") if body else [])
                return "\n".join(f"> {line}" if line else ">" for line in lines)
            case "orderedList" | "unorderedList":
                out = []
                for k, item in enumerate(x.items or ()):
                    mark = f"{(x.start or 0) + k}. " if x.type == "orderedList" else "- "
                    pad = " " * len(mark)
                    out.append(mark + ("\n" + pad).join(self.item(item).split("\n")).replace("\n" + pad + "\n", "\n\n"))
                return ("\n\n" if x.loose else "\n").join(out)
            case "table":
                def row(cells: list[list[Node]]) -> str:
                    return "| " + " | ".join(re.sub(r"(?<!\\)\|", r"\\|", self.inline(c)) for c in cells) + " |"

                rule = "| " + " | ".join({"left": ":---", "right": "---:", "center": ":---:"}.get(a, "---") for a in x.align) + " |"
                return "\n".join([row(x.header), rule, *(row(r) for r in x.rows)])
            case "frontmatter":
                return x.text or ""
            case "htmlBlock" if not x.loose and x.raw_open != x.text:
                blocks = any(c.type in ("paragraph", "heading", "orderedList", "unorderedList", "blockQuote", "table", "codeBlock") for c in x.children)
                inner = "\n" + "\n\n".join(self.block(c) for c in x.children) + "\n" if blocks else self.inline(x.children) if x.children else stripped(x.text or "")
                return f"{stripped(x.raw_open)}{inner}</{x.tag}>"
            case "htmlBlock" | "htmlComment" | "htmlSelfClosing":
                return stripped(x.text or x.raw_open or "")
        return self.span(x)

    def item(self, nodes: list[Node]) -> str:
        out, run = [], []
        for x in nodes:
            if x.type in ("paragraph", "heading", "codeBlock", "blockQuote", "orderedList", "unorderedList", "table", "breakThematic") or x.type.startswith("html") and x.raw_open and "\n" in (x.text or ""):
                if run:
                    out.append(self.inline(run))
                    run = []
                out.append(self.block(x))
            else:
                run.append(x)
        if run:
            out.append(self.inline(run))
        paragraphs = any(x.type == "paragraph" for x in nodes)
        return ("\n\n" if paragraphs else "\n").join(out)


@deep
def to_markdown(text: str | None, options: Options | None = None, **how: Any) -> str | None:
    """A Markdown text in normal form; null stays null."""
    return None if text is None else Compiler(parse(text, options), **how).document()


