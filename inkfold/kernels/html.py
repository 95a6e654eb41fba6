"""Markdown nodes to HTML text."""

from __future__ import annotations

import json
import re
from collections.abc import Mapping
from typing import Any

from . import inline as I
from . import scalars as S
from .blocks import definitions, parse
from .model import Document, Node, Options, Refs, deep, truth


class Compiler:
    """Renders one document. overrides: tag -> new tag, or (new tag, props); rule: called with (node, render) and may return text."""

    def __init__(self, doc: Document, options: Options, overrides: dict[str, Any] | None = None, rule: Any = None, preserve_frontmatter: bool = False) -> None:
        self.doc, self.options, self.overrides, self.rule, self.front = doc, options, overrides or {}, rule, preserve_frontmatter

    def tag(self, name: str, attrs: dict[str, Any] | None = None) -> tuple[str, str]:
        """A tag after overrides, and its attributes as text."""
        over = self.overrides.get(name)
        new, props = (over, {}) if isinstance(over, str) else (over[0] or name, over[1] or {}) if over else (name, {})
        return new, attrs_text({**props, **(attrs or {})})

    def wrap(self, name: str, inner: str, attrs: dict[str, Any] | None = None) -> str:
        if not self.overrides:
            return f"<{name}{attrs_text(attrs)}>{inner}</{name}>" if attrs else f"<{name}>{inner}</{name}>"
        new, text = self.tag(name, attrs)
        return f"<{new}{text}>{inner}</{new}>"

    def all(self, nodes: list[Node]) -> str:
        return "".join(map(self.plain if self.rule is None else self.one, nodes))

    def one(self, x: Node) -> str:
        if self.rule and (own := self.rule(x, self.plain)) is not None:
            return own
        return self.plain(x)

    def plain(self, x: Node) -> str:
        if x.type == "text":
            return S.escape_html(x.text or "")
        return getattr(self, "_" + x.type)(x)

    def _text(self, x: Node) -> str:
        return S.escape_html(x.text or "")

    def _paragraph(self, x: Node) -> str:
        return self.wrap("p", self.all(x.children))

    def _heading(self, x: Node) -> str:
        return self.wrap(f"h{x.level}", self.all(x.children), {"id": x.id} if x.id else None)

    def _breakLine(self, x: Node) -> str:
        return f"<{self.tag('br')[0]} />\n"

    def _breakThematic(self, x: Node) -> str:
        return f"<{self.tag('hr')[0]} />"

    def _blockQuote(self, x: Node) -> str:
        if x.alert:
            head = f"<header>{S.escape_html(x.alert)}</header>"
            return self.wrap("blockquote", head + self.all(x.children), {"class": f"markdown-alert-{self.options.slug(x.alert)}"})
        return self.wrap("blockquote", self.all(x.children))

    def _codeBlock(self, x: Node) -> str:
        attrs = dict(x.attrs or {})
        if x.lang:
            attrs["class"] = " ".join(p for p in (attrs.get("class"), f"language-{x.lang}") if p)
        return self.wrap("pre", self.wrap("code", S.escape_html(x.text or ""), attrs))

    def _codeInline(self, x: Node) -> str:
        return self.wrap("code", S.escape_html(x.text or ""))

    def _textFormatted(self, x: Node) -> str:
        return self.wrap(x.tag or "strong", self.all(x.children))

    def _link(self, x: Node) -> str:
        attrs: dict[str, Any] = {}
        if x.target is not None and (url := self.options.clean(S.decode_entities(x.target), "a", "href")) is not None:
            attrs["href"] = S.encode_url(url)
        if x.title:
            attrs["title"] = x.title
        return self.wrap("a", self.all(x.children), attrs)

    def _image(self, x: Node) -> str:
        new, text = self.tag("img", {"src": x.target or "", "alt": x.alt or "", **({"title": x.title} if x.title else {})})
        return f"<{new}{text} />"

    def _footnoteReference(self, x: Node) -> str:
        return self.wrap("a", self.wrap("sup", S.escape_html(x.text or "")), {"href": x.target})

    def _gfmTask(self, x: Node) -> str:
        new, _ = self.tag("input")
        return f"<{new}{' checked=\"\"' if x.completed else ''} disabled=\"\" type=\"checkbox\">"

    def _list(self, x: Node) -> str:
        inner = "".join(self.wrap("li", self.all(item)) for item in x.items or ())
        ordered = x.type == "orderedList"
        return self.wrap("ol" if ordered else "ul", inner, {"start": str(x.start)} if ordered and x.start != 1 else None)

    _orderedList = _unorderedList = _list

    def _table(self, x: Node) -> str:
        def row(name: str, cells: list[list[Node]]) -> str:
            return self.wrap("tr", "".join(self.wrap(name, self.all(c), {"align": a} if a else None) for c, a in zip(cells, x.align, strict=True)))

        body = self.wrap("tbody", "".join(row("td", r) for r in x.rows)) if x.rows else ""
        return self.wrap("table", self.wrap("thead", row("th", x.header)) + body)

    def _frontmatter(self, x: Node) -> str:
        return self.wrap("pre", S.escape_html(x.text or "")) if self.front else ""

    def _htmlComment(self, x: Node) -> str:
        return self._filtered(I.strip_dangerous(x.text or ""))

    def _filtered(self, text: str) -> str:
        return S.apply_tagfilter(text) if self.options.tagfilter else text

    def _htmlBlock(self, x: Node) -> str:
        if x.loose or x.raw_open == x.text:
            return self._filtered(I.strip_dangerous(x.text or ""))
        inner = self.all(x.children) if x.children else self._filtered(I.strip_dangerous(x.text or ""))
        if self.options.tagfilter and (x.tag or "").lower() in S.TAGFILTER:
            return self._filtered(I.strip_dangerous(x.raw_open)) + inner + f"&lt;/{x.tag}>"
        new, text = self.tag(x.tag, x.attrs)
        return f"<{new}{text}>{inner}</{new}>"

    def _htmlSelfClosing(self, x: Node) -> str:
        raw = I.strip_dangerous(x.raw_open or "")
        if x.completed or self.options.tagfilter and (x.tag or "").lower() in S.TAGFILTER or x.tag not in self.overrides:
            return self._filtered(raw)
        new, text = self.tag(x.tag, x.attrs)
        return f"<{new}{text} />"

    def footer(self) -> str:
        notes = [r for r in self.doc.refs.values() if r.footnote]
        if not notes:
            return ""
        rows = []
        for r in notes:
            name = r.label[1:]
            inner = self.all(I.parse(r.target, self.doc.refs, self.options))
            rows.append(self.wrap("div", f"{S.escape_html(name)}: {inner}", {"id": self.options.slug(name)}))
        return self.wrap("footer", "".join(rows))

    def document(self, wrapper: str | None = "div", props: dict[str, Any] | None = None, force_wrapper: bool = False, inline: bool = False) -> str:
        """The document's HTML, in a wrapper element where it has several nodes or one is forced. inline: a lone paragraph gives its content alone."""
        shown = [x for x in self.doc.nodes if x.type not in ("footnote", "ref") and (x.type != "frontmatter" or self.front)]
        foot = self.footer()
        if len(shown) == 1 and shown[0].type == "paragraph" and inline:
            inner = [self.all(shown[0].children)]
        else:
            inner = [self.one(x) for x in shown]
        if not force_wrapper and (wrapper is None or len(inner) + bool(foot) <= 1 and not (inline and inner)):
            return "".join(inner) + foot
        return self.wrap(wrapper or ("span" if inline else "div"), "".join(inner) + foot, props)


def attrs_text(attrs: dict[str, Any]) -> str:
    out = []
    for name, value in attrs.items():
        name = {"className": "class"}.get(name, name)
        if value is None:
            continue
        if value is True:
            out.append(f" {name}")
        elif isinstance(value, dict) and name == "style":
            out.append(f' style="{S.escape_attr("; ".join(f"{re.sub("([A-Z])", lambda m: "-" + m[1].lower(), k)}: {v}" for k, v in value.items()))}"')
        elif isinstance(value, (str, int, float)) and value is not False:
            out.append(f' {name}="{S.escape_attr(str(value))}"')
        else:
            out.append(" ")
    return "".join(out)


def rendered(doc: Document, given: Mapping[str, Any] | None = None, options: Options | None = None) -> str:
    """A document's HTML by options of both kinds: those of the parser (Options), and wrapper, wrapper_props, force_wrapper, force_inline,
    overrides, rule and preserve_frontmatter. Overrides and props may be JSON, as SQL gives them."""
    if not given:
        return Compiler(doc, options or Options()).document()
    given = {k: truth(v) for k, v in given.items()}
    for k in ("overrides", "wrapper_props"):
        if isinstance(given.get(k), str):
            given[k] = json.loads(given[k])
    inline = bool(given.get("force_inline"))
    made = Compiler(doc, options or Options.of(given), given.get("overrides"), given.get("rule"), bool(given.get("preserve_frontmatter")))
    wrapper = given.get("wrapper", "span" if inline else "div")
    return made.document(None if wrapper in (None, "") else wrapper, given.get("wrapper_props"), bool(given.get("force_wrapper")), inline)


@deep
def to_html(text: str | None, options: Options | None = None, **given: Any) -> str | None:
    """The HTML of a Markdown text; null stays null."""
    if text is None:
        return None
    options = options or Options.of(given)
    if truth(given.get("force_inline")):
        refs = Refs()
        refs.update(definitions(text))
        return rendered(Document([Node("paragraph", children=inline_parse(text, options, refs))], refs), given, options)
    return rendered(parse(text, options), given, options)


def inline_parse(text: str, options: Options, refs: Refs) -> list[Node]:
    """A text's inline content, whatever blocks its lines would make."""
    return I.parse(" ".join(S.normalize_input(text).split("\n")).strip(), refs, options)
