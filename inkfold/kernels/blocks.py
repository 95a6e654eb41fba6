"""Block structure of Markdown: a text becomes a tree of nodes whose inline content is parsed last."""

from __future__ import annotations

import bisect
import itertools
import re

from . import inline as I
from . import scalars as S
from .model import Document, Node, Options, Ref, Refs, deep
from .streaming import settle

#: Block elements that start an HTML block, from the public CommonMark specification.
HTML_BLOCKS = "address article aside base basefont blockquote body caption center col colgroup dd details dialog dir div dl dt fieldset figcaption figure footer form frame frameset h1 h2 h3 h4 h5 h6 head header hr html iframe legend li link main menu menuitem nav noframes ol optgroup option p param search section summary table tbody td tfoot th thead title tr track ul".split()
MAX_DEPTH = 500
#: Nodes that may hold headings.
CONTAINERS = {"blockQuote", "orderedList", "unorderedList", "htmlBlock"}

THEMATIC = re.compile(r" {0,3}(?:(?:\*[ \t]*){3,}|(?:-[ \t]*){3,}|(?:_[ \t]*){3,})$")
ATX = re.compile(r" {0,3}(#{1,6})(?:[ \t]+(.*?))?[ \t]*$", re.S)
ATX_CLOSE = re.compile(r"(?:^|[ \t]+)#+[ \t]*$")
SETEXT = re.compile(r" {0,3}(=+|-+)[ \t]*$")
FENCE = re.compile(r"( {0,3})(`{3,}(?=[^`]*$)|~{3,})[ \t]*(.*?)[ \t]*$")
MARKER = re.compile(r"( {0,3})([-*+]|(\d{1,9})([.)]))(?=[ \t]|$)")
DELIMITER_CELL = re.compile(r":?-+:?")
FOOTNOTE = re.compile(r" {0,3}\[\^([^\]\s]+)\]:[ \t]*(.*)$")
LABEL = re.compile(r" {0,3}\[((?:\\.|[^\[\]\\]){1,999})\]:[ \t]*\n?[ \t]*")
DESTINATION = re.compile(r"<((?:\\.|[^<>\\\n])*)>|([^\s<][^\s]*)")
BEFORE_TITLE = re.compile(r"(?:[ \t]+|[ \t]*\n[ \t]*)([\"'(])")
TITLE = re.compile(r"(?:[ \t]+|[ \t]*\n[ \t]*)(\"(?:\\.|[^\"\\])*\"|'(?:\\.|[^'\\])*'|\((?:\\.|[^()\\])*\))[ \t]*(?=\n|$)")
LINE_END = re.compile(r"[ \t]*(?=\n|$)")
FRONT_KEY = re.compile(r"[ \t]*[A-Za-z0-9_][A-Za-z0-9_.-]*:(?:[ \t]|$)")
ALERT = re.compile(r"\[!([A-Za-z]+)\][ \t]*$")
TASK = re.compile(r"\[([ xX])\]")
HTML_START = (
    (re.compile(r" {0,3}<(?:pre|script|style|textarea)(?:[\s>]|$)", re.I), re.compile(r"</(?:pre|script|style|textarea)>", re.I)),
    (re.compile(r" {0,3}<!--"), re.compile(r"-->")),
    (re.compile(r" {0,3}<\?"), re.compile(r"\?>")),
    (re.compile(r" {0,3}<![A-Za-z]"), re.compile(r">")),
    (re.compile(r" {0,3}<!\[CDATA\["), re.compile(r"\]\]>")),
    (re.compile(rf" {{0,3}}</?(?:{'|'.join(HTML_BLOCKS)})(?:[\s>]|/>|$)", re.I), None),
    (re.compile(rf" {{0,3}}(?:{I.OPEN_TAG}|{I.CLOSE_TAG})[ \t]*$"), None),
)
OPENING = re.compile(rf"\s*({I.OPEN_TAG})")
NAME = re.compile(r"\s*</?([A-Za-z][\w:.-]*)")
BLOCKISH = re.compile(r"\s*(?:<|[-*+] |#|>|\d+[.)] |```)")
ATTR_PAIR = re.compile(r"([\w-]+)=(?:\"([^\"]*)\"|'([^']*)')")


def indent_of(line: str) -> int:
    """Columns of leading white space, tabs to stops of four."""
    col = 0
    for c in line:
        if c == " ":
            col += 1
        elif c == "\t":
            col += 4 - col % 4
        else:
            break
    return col


def dedent(line: str, cols: int, at: int = 0) -> str:
    """The line without its first cols columns of white space. at: the column where it begins. Tabs that no longer begin at a stop become spaces."""
    col, k = at, 0
    while k < len(line) and col < at + cols and line[k] in " \t":
        col += 1 if line[k] == " " else 4 - col % 4
        k += 1
    if "\t" not in line[k:] or col == at + cols and col % 4 == 0:
        return " " * max(0, col - at - cols) + line[k:]
    while k < len(line) and line[k] in " \t":
        col += 1 if line[k] == " " else 4 - col % 4
        k += 1
    return " " * max(0, col - at - cols) + line[k:]


def blank(line: str) -> bool:
    return not line.strip(" \t")


class Chunk:
    """Lines up to the next blank one, as one text, with where each begins; made once for all definitions in it."""

    def __init__(self, lines: list[str], first: int) -> None:
        self.lines, self.first = lines, first
        self.stop = next((k for k in range(first, len(lines)) if blank(lines[k])), len(lines))
        self.text = "\n".join(lines[first : self.stop])
        self.starts = [0]
        for line in lines[first : self.stop]:
            self.starts.append(self.starts[-1] + len(line) + 1)
        self.last = {c: self.text.rfind(c) for c in ("'", '"', ")")}

    def closes(self, opening: str, at: int) -> bool:
        return self.last[")" if opening == "(" else opening] >= at


class Parser:
    """One document's parse. Definitions are collected by the block pass, so inline content is parsed after it."""

    def __init__(self, options: Options | None = None) -> None:
        self.options, self.refs = options or Options(), Refs()
        self.chunk: Chunk | None = None
        self.closes: dict[tuple[int, str], tuple] = {}

    def parse(self, text: str) -> Document:
        text = S.normalize_input(text[1:] if text[:1] == "\ufeff" else text)
        if self.options.streaming:
            self.refs.update(definitions(text))  # those behind the edge count too
            text = settle(text)
        nodes = self.blocks(text.split("\n"), 0, top=True)
        self.finish(nodes, False)
        self.heading_ids(nodes, {})
        return Document(nodes, self.refs)

    # ---- blocks

    def blocks(self, lines: list[str], depth: int, top: bool = False) -> list[Node]:
        if depth > MAX_DEPTH:
            return [Node("text", text="\n".join(lines))]
        out: list[Node] = []
        i = 0
        if top and not self.options.disable_frontmatter and lines and lines[0].rstrip(" \t") == "---" and lines[0][:3] == "---":
            end = next((k for k in range(1, len(lines) - 1) if lines[k].startswith("---")), None)
            if end and any(FRONT_KEY.match(x) for x in lines[1:end]):
                out.append(Node("frontmatter", text="\n".join(lines[: end + 1])))
                i = end + 1
        n = len(lines)
        while i < n:
            line = lines[i]
            if blank(line):
                i += 1
                continue
            lazy = line.startswith("\x1e")
            if not lazy:
                if indent_of(line) >= 4:
                    i = self.indented(lines, i, out)
                    continue
                first = line.lstrip(" ")[:1]
                if first == "#" and (m := ATX.match(line)):
                    content = ATX_CLOSE.sub("", m[2] or "")
                    out.append(Node("heading", level=len(m[1]), raw=content.strip(" \t")))
                    i += 1
                    continue
                if first == ">":
                    i = self.quote(lines, i, out, depth)
                    continue
                if first in "`~" and (m := FENCE.match(line)):
                    i = self.fence(lines, i, m, out)
                    continue
                if first in "*-_" and THEMATIC.match(line):
                    out.append(Node("breakThematic"))
                    i += 1
                    continue
                if MARKER.match(line):
                    i = self.list(lines, i, out, depth)
                    continue
                if first == "<" and (k := self.html_kind(line, False)) is not None:
                    i = self.html(lines, i, k, out, depth)
                    continue
                if first == "[":
                    k = self.footnote(lines, i) or self.definition(lines, i)
                    if k:
                        i = k
                        continue
                if "|" in line and (k := self.table(lines, i, out)):
                    i = k
                    continue
            i = self.paragraph(lines, i, out)
        return out

    def indented(self, lines: list[str], i: int, out: list[Node]) -> int:
        body = []
        while i < len(lines) and (blank(lines[i]) or indent_of(lines[i]) >= 4):
            body.append(dedent(lines[i], 4) if not blank(lines[i]) or indent_of(lines[i]) >= 4 else "")
            i += 1
        out.append(Node("codeBlock", text="\n".join(body).rstrip("\n") if not all(blank(b) for b in body) else ""))
        while out[-1].text and blank(out[-1].text.rsplit("\n", 1)[-1]) and "\n" in out[-1].text:
            out[-1].text = out[-1].text.rsplit("\n", 1)[0]
        return i

    def fence(self, lines: list[str], i: int, m: re.Match, out: list[Node]) -> int:
        mark, indent, info = m[2][0], len(m[1]), S.unescape(S.decode_entities(m[3]))
        close = re.compile(rf" {{0,3}}{re.escape(mark)}{{{len(m[2])},}}[ \t]*$")
        body, i = [], i + 1
        while i < len(lines) and not close.match(lines[i]):
            line = lines[i]
            cut = len(line) - len(line.lstrip(" "))
            body.append(line[min(cut, indent):])
            i += 1
        if i >= len(lines) and body and body[-1] == "":
            body.pop()
        node = Node("codeBlock", text="\n".join(body), info=info or None)
        words = info.split(None, 1)
        if words:
            node.lang = words[0]
            pairs = {k: a or b for k, a, b in ATTR_PAIR.findall(words[1])} if len(words) > 1 else {}
            node.attrs = pairs or None
        out.append(node)
        return i + 1

    def interrupts(self, line: str, following: str | None) -> bool:
        """Whether a line ends an open paragraph."""
        if indent_of(line) >= 4:
            return False
        s = line.lstrip(" ")
        c = s[:1]
        if c == ">" or c == "#" and ATX.match(line) or c in ("`", "~") and FENCE.match(line):
            return True
        if c in ("*", "-", "_") and THEMATIC.match(line):
            return True
        if (m := MARKER.match(line)) and line[m.end():].strip(" \t") and (not m[3] or m[3] == "1"):
            return True
        if c == "<" and self.html_kind(line, True) is not None:
            return True
        return "|" in line and following is not None and self.delimiter(following) is not None and len(self.delimiter(following) or ()) == len(cells(line))

    def quote(self, lines: list[str], i: int, out: list[Node], depth: int) -> int:
        body: list[str] = []
        open_fence = False
        while i < len(lines):
            line = lines[i]
            s = line.lstrip(" \t")
            if s.startswith(">") and (indent_of(line) < 4 or body):
                col = indent_of(line) + 1
                rest = s[1:]
                if rest.startswith(" "):
                    rest = rest[1:]
                elif rest.startswith("\t"):
                    rest = dedent(rest, 1, col)
                body.append(rest)
                if re.match(r" {0,3}(```|~~~)", rest):
                    open_fence = not open_fence
            elif body and not blank(line) and not blank(body[-1]) and not open_fence and self.lazy_after(body) and (indent_of(line) >= 4 or not (s[0] in "#>`~<" or THEMATIC.match(line) or MARKER.match(line))):
                body.append("\x1e" + line.lstrip(" \t\x1e"))
            else:
                break
            i += 1
        node = Node("blockQuote")
        if body and (m := ALERT.match(body[0])):
            node.alert = m[1].upper()
            body = body[1:]
        node.children = self.blocks(body, depth + 1)
        out.append(node)
        return i

    @staticmethod
    def lazy_after(body: list[str]) -> bool:
        last = body[-1]
        return last.startswith("\x1e") or indent_of(last) < 4 and not ATX.match(last) and not THEMATIC.match(last)

    def list(self, lines: list[str], i: int, out: list[Node], depth: int) -> int:
        m = MARKER.match(lines[i])
        kind = m[4] or m[2]
        items: list[list[str]] = []
        gaps: list[bool] = []  # a blank line before the item
        loose_inside = False
        start = int(m[3]) if m[3] else None
        content = 0
        blanks = False
        while i < len(lines):
            line = lines[i]
            if blank(line):
                if items and len(items[-1]) == 1 and blank(items[-1][0]) and not (i + 1 < len(lines) and self.same_kind(lines[i + 1], kind)):
                    i += 1
                    break
                if items:
                    items[-1].append("")
                blanks = True
                i += 1
                continue
            ind = indent_of(line)
            if items and ind >= content:
                items[-1].append(dedent(line, content))
                blanks = False
                i += 1
                continue
            if THEMATIC.match(line):
                break
            m = MARKER.match(line)
            if m and (m[4] or m[2]) == kind:
                gaps.append(blanks and bool(items))
                width = len(m[0])
                rest = line[width:]
                pad = indent_of_rest(rest, width)
                content = width + (pad if 1 <= pad <= 4 and rest.strip(" \t") else 1)
                items.append([dedent(rest, content - width, width) if rest.strip(" \t") else ""])
                blanks = False
                i += 1
                continue
            if m or blanks or not items or not items[-1] or blank(items[-1][-1]) or self.interrupts(line, lines[i + 1] if i + 1 < len(lines) else None):
                break
            items[-1].append("\x1e" + line.lstrip(" \t\x1e"))
            i += 1
        node = Node("orderedList" if start is not None else "unorderedList", items=[], start=start)
        trimmed = []
        for body in items:
            while len(body) > 1 and blank(body[-1]):
                body.pop()
            trimmed.append(body)
        for body in trimmed:
            parsed = self.blocks(self.task(body, box := []), depth + 1)
            loose_inside = loose_inside or self.gap_between_blocks(body)
            node.items.append([*box, *parsed])
        node.loose = any(gaps) or loose_inside
        if not node.loose:
            node.items = [[y for x in item for y in ([Node("inlines", raw=x.raw)] if x.type == "paragraph" else [x])] for item in node.items]
        out.append(node)
        return i

    @staticmethod
    def task(body: list[str], box: list[Node]) -> list[str]:
        if m := TASK.match(body[0]):
            box += [Node("gfmTask", completed=m[1] != " "), Node("text", text=" ")]
            return [body[0][3:].lstrip(" "), *body[1:]]
        return body

    def gap_between_blocks(self, body: list[str]) -> bool:
        """A blank line between two direct blocks of an item; those inside fences and nested lists do not count."""
        fence = None
        nested = -1
        gap = False
        for k, line in enumerate(body):
            if fence:
                if re.match(rf" {{0,3}}{re.escape(fence)}+[ \t]*$", line):
                    fence = None
                continue
            if blank(line):
                gap = k > 0
                continue
            ind = indent_of(line)
            if nested >= 0 and ind >= nested:
                if gap and ind < nested:
                    return True
                gap = False
                continue
            if gap:
                return True
            gap = False
            nested = -1
            if m := FENCE.match(line):
                fence = m[2]
            elif m := MARKER.match(line):
                nested = len(m[0]) + 1
        return False

    @staticmethod
    def same_kind(line: str, kind: str) -> bool:
        m = MARKER.match(line)
        return bool(m and (m[4] or m[2]) == kind)

    def html_kind(self, line: str, interrupting: bool) -> int | None:
        if self.options.disable_raw_html or self.options.ignore_html_blocks:
            return None
        if re.match(r" {0,3}<(?:[A-Za-z][A-Za-z0-9+.-]{1,31}:[^\s<>]*|[^\s<>@]+@[^\s<>]+)>", line):
            return None
        for k, (start, _) in enumerate(HTML_START):
            if k == 6 and interrupting:
                return None
            if start.match(line):
                return k
        return None

    def html(self, lines: list[str], i: int, kind: int, out: list[Node], depth: int) -> int:
        end = HTML_START[kind][1]
        body = [lines[i]]
        if end:
            at = HTML_START[kind][0].match(lines[i]).end()
            if not end.search(lines[i], at if kind in (1, 2, 3, 4) else 0):
                i += 1
                while i < len(lines):
                    body.append(lines[i])
                    if end.search(lines[i]):
                        break
                    i += 1
            i += 1
            text = "\n".join(body).rstrip("\n")
            out.append(Node("htmlBlock", tag=(re.match(r"\s*<(\w+)", text) or ["", ""])[1].lower(), text=text, raw_open=text) if kind == 0 else Node("htmlComment", text=text))
            return i
        i += 1
        while i < len(lines) and not blank(lines[i]):
            body.append(lines[i])
            i += 1
        text = "\n".join(body)
        m = OPENING.match(text)
        name = NAME.match(text)
        name = name[1] if name else ""
        if m and name:
            attrs = I.attributes(m[1])
            if m[1].endswith("/>") or name.lower() in S.VOID:
                if not text[m.end():].strip():
                    out.append(Node("htmlSelfClosing", tag=name, attrs=attrs, raw_open=m[1], text=text))
                    return i
            first = i - len(body)
            close, blanks = self.own_close(lines, name, first, m.start(1)), False
            if close and close[1] > len(text):
                if kind == 5 or name[0].isupper():  # an element goes on over blank lines up to its own end
                    text, i, blanks = "\n".join(lines[first : close[2] + 1]), close[2] + 1, True
                else:
                    close = None
            if close and not text[close[1]:].strip():
                inner = text[m.end(): close[0]]
                node = Node("htmlBlock", tag=name, attrs=attrs, raw_open=m[1], text=inner)
                if inner.strip():
                    if name.lower() != "p" and inner.startswith("\n") and (blanks or BLOCKISH.match(inner)):
                        node.children = self.blocks(inner.strip("\n").split("\n"), depth + 1)
                    elif inner.startswith("\n") and "<" not in inner and name.lower() != "p":
                        node.children = [Node("text", text=inner.strip("\n"))]
                    else:
                        node.raw = inner.strip("\n")
                out.append(node)
                return i
        out.append(Node("htmlBlock", tag=name, attrs=I.attributes(m[1]) if m else None, raw_open=m[1] if m else text, text=text, loose=True))
        return i

    def own_close(self, lines: list[str], name: str, first: int, at: int) -> tuple[int, int, int] | None:
        """Where the closing tag of the element that opens at a place of a line is, from that line's begin, and on which line;
        nested ones of its name are counted. One pass over the lines finds all elements of a name."""
        key = (id(lines), name.lower())
        if key not in self.closes:
            starts = [0, *itertools.accumulate(len(x) + 1 for x in lines)]
            opened: list[int] = []
            found: dict[int, tuple[int, int]] = {}
            for t in re.compile(rf"<(/?){re.escape(name)}(?=[\s/>])[^<>]*>", re.I).finditer("\n".join(lines)):
                if not t[1]:
                    if not t[0].endswith("/>"):
                        opened.append(t.start())
                elif opened:
                    found[opened.pop()] = t.span()
            self.closes[key] = (lines, starts, found)
        _, starts, found = self.closes[key]
        close = found.get(starts[first] + at)
        return (close[0] - starts[first], close[1] - starts[first], bisect.bisect_right(starts, close[1] - 1) - 1) if close else None

    def delimiter(self, line: str) -> list[str | None] | None:
        if "-" not in line or indent_of(line) >= 4 or not re.fullmatch(r"[\s|:-]+", line) or not ("|" in line or ":" in line or line.strip()):
            return None
        found = cells(line)
        if not found or not all(DELIMITER_CELL.fullmatch(c) for c in found):
            return None
        return ["center" if c[0] == ":" and c[-1] == ":" and len(c) > 1 else "left" if c[0] == ":" else "right" if c[-1] == ":" else None for c in found]

    def table(self, lines: list[str], i: int, out: list[Node]) -> int | None:
        if i + 1 >= len(lines):
            return None
        align = self.delimiter(lines[i + 1])
        if align is None or len(cells(lines[i])) != len(align):
            return None
        k, body = i + 2, []
        while k < len(lines) and not blank(lines[k]):
            line = lines[k]
            if indent_of(line) < 4 and (line.lstrip(" ")[:1] in (">", "#") or THEMATIC.match(line) or FENCE.match(line)):
                break
            row = cells(line)[: len(align)]
            body.append(row + [""] * (len(align) - len(row)))
            k += 1
        out.append(Node("table", align=align, header=[[Node("inlines", raw=c)] for c in cells(lines[i])], rows=[[[Node("inlines", raw=c)] for c in row] for row in body]))
        return k

    def footnote(self, lines: list[str], i: int) -> int | None:
        m = FOOTNOTE.match(lines[i])
        if not m:
            return None
        body, k = [m[2]], i + 1
        while k < len(lines) and not blank(lines[k]) and indent_of(lines[k]) >= 2:
            body.append(lines[k])
            k += 1
        label = "^" + m[1].lower()
        self.refs.setdefault(label, Ref(label, "\n".join(body), None, len(self.refs), True))
        return k

    def definition(self, lines: list[str], i: int) -> int | None:
        """Lines that are one link reference definition; the first of a label wins."""
        if self.chunk is None or self.chunk.lines is not lines or not self.chunk.first <= i < self.chunk.stop:
            self.chunk = Chunk(lines, i)
        chunk, text = self.chunk, self.chunk.text
        start = chunk.starts[i - chunk.first]
        m = LABEL.match(text, start)
        if not m or not m[1].strip() or m[1].startswith("^"):
            return None
        d = DESTINATION.match(text, m.end())
        if not d:
            return None
        target = d[1] if d[1] is not None else d[2]
        title, end = None, None
        q = BEFORE_TITLE.match(text, d.end())
        if q and chunk.closes(q[1], q.end()) and (t := TITLE.match(text, d.end())):
            title, end = t[1][1:-1], t.end()
        elif e := LINE_END.match(text, d.end()):
            end = e.end()
        if end is None:
            return None
        label = S.normalize_label(m[1])
        target = S.decode_entities(S.unescape(target))
        self.refs.setdefault(label, Ref(label, target, S.decode_entities(S.unescape(title)) if title is not None else None, len(self.refs), False))
        return i + text.count("\n", start, end) + 1

    def paragraph(self, lines: list[str], i: int, out: list[Node]) -> int:
        body = [lines[i]]
        i += 1
        while i < len(lines) and not blank(lines[i]):
            line = lines[i]
            if not line.startswith("\x1e"):
                if (m := SETEXT.match(line)) and not body[-1].startswith("\x1e"):
                    out.append(Node("heading", level=1 if m[1][0] == "=" else 2, raw=self.clean_lines(body)))
                    return i + 1
                if self.interrupts(line, lines[i + 1] if i + 1 < len(lines) else None):
                    break
            body.append(line)
            i += 1
        out.append(Node("paragraph", raw=self.clean_lines(body)))
        return i

    @staticmethod
    def clean_lines(body: list[str]) -> str:
        return "\n".join(x.lstrip(" \t\x1e") for x in body).strip(" \t").rstrip("\r\n \t")

    # ---- inline content, after all definitions are known

    def finish(self, nodes: list[Node], in_anchor: bool) -> None:
        k = 0
        while k < len(nodes):
            x = nodes[k]
            if x.type == "inlines":
                nodes[k : k + 1] = found = I.parse(x.raw, self.refs, self.options, in_anchor)
                k += len(found)
                continue
            if isinstance(x.raw, str):
                x.children = I.parse(x.raw, self.refs, self.options, in_anchor)
                x.raw = None
            elif x.children:
                self.finish(x.children, in_anchor)
            if x.items is not None:
                for part in x.items:
                    self.finish(part, in_anchor)
            elif x.header is not None:
                for part in itertools.chain(x.header, *x.rows):
                    self.finish(part, in_anchor)
            k += 1

    def heading_ids(self, nodes: list[Node], taken: dict[str, int]) -> None:
        for x in nodes:
            if x.type == "heading":
                base = self.options.slug(I.flatten(x.children, alt=False))
                x.id = base
                if base:
                    if base in taken:
                        k = taken[base]
                        while f"{base}-{k}" in taken:
                            k += 1
                        taken[base] = k + 1
                        x.id = f"{base}-{k}"
                        taken[x.id] = 1
                    else:
                        taken[base] = 1
            elif x.type in CONTAINERS:
                self.heading_ids(x.children, taken)
                for item in x.items or ():
                    self.heading_ids(item, taken)


def indent_of_rest(rest: str, col: int) -> int:
    start = col
    for c in rest:
        if c == " ":
            col += 1
        elif c == "\t":
            col += 4 - col % 4
        else:
            break
    return col - start


def cells(line: str) -> list[str]:
    """A row's cells: pipes outside code spans and escapes divide; outer pipes are optional."""
    s = line.strip(" \t")
    if s.startswith("|"):
        s = s[1:]
    out, cell, k = [], [], 0
    while k < len(s):
        c = s[k]
        if c == "\\" and k + 1 < len(s):
            cell.append("|" if s[k + 1] == "|" else s[k : k + 2])
            k += 2
            continue
        if c == "`":
            run = len(s[k:]) - len(s[k:].lstrip("`"))
            end = I.close_ticks(s, k + run, run)
            if end >= 0:
                cell.append(s[k:end].replace("\\|", "|"))
                k = end
                continue
            cell.append("`" * run)
            k += run
            continue
        if c == "|":
            out.append("".join(cell).strip(" \t"))
            cell = []
        else:
            cell.append(c)
        k += 1
    last = "".join(cell).strip(" \t")
    if last or not s.endswith("|") or not out:
        out.append(last)
    return out


def definitions(text: str) -> dict[str, Ref]:
    """The definitions of a text alone, by label."""
    found = Parser()
    found.blocks(S.normalize_input(text).split("\n"), 0, top=True)
    return found.refs


def code_fenced(text: str) -> Node | None:
    """The fenced code with which a text begins, if it begins with one."""
    lines = S.normalize_input(text).split("\n")
    out: list[Node] = []
    if m := FENCE.match(lines[0]):
        Parser().fence(lines, 0, m, out)
    return out[0] if out else None


def definition(text: str) -> Ref | None:
    """The link reference definition with which a text begins, if it begins with one."""
    found = Parser()
    return next(iter(found.refs.values())) if found.definition(S.normalize_input(text).split("\n"), 0) else None


@deep
def parse(text: str | None, options: Options | None = None) -> Document:
    return Parser(options).parse(text or "")
