"""Inline content: code spans, emphasis, links, images, autolinks, HTML, breaks and escapes."""

from __future__ import annotations

import json
import re
import unicodedata
from typing import Any

from . import scalars as S
from . import tags as T
from .model import Node

ATTRIBUTE = r"""\s+[A-Za-z_:@][\w:.@-]*(?:\s*=\s*(?:"[^"]*"|'[^']*'|\{[^{}]*(?:\{[^{}]*\}[^{}]*)*\}|[^\s"'=<>`{]+))?"""
OPEN_TAG = rf"<(?![A-Za-z]:)[A-Za-z][\w:.-]*(?:{ATTRIBUTE})*\s*/?>"
CLOSE_TAG = r"</(?![A-Za-z]:)[A-Za-z][\w:.-]*\s*>"
_OPEN, _CLOSE = re.compile(OPEN_TAG), re.compile(CLOSE_TAG)
_ATTR = re.compile(r"""([A-Za-z_:@][\w:.@-]*)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|\{((?:[^{}]|\{[^{}]*\})*)\}|([^\s"'=<>`{]+)))?""")
_OTHER = re.compile(r"<!-->|<!--->|<!--.*?-->|<\?.*?\?>|<!\[CDATA\[.*?\]\]>|<![A-Za-z][^>]*>", re.S)
AUTOLINK = re.compile(r"<([A-Za-z][A-Za-z0-9+.-]{1,31}:[^\s<>]*)>")
AUTOMAIL = re.compile(r"<([A-Za-z0-9.!#$%&'*+/=?^_`{|}~-]+@[A-Za-z0-9](?:[A-Za-z0-9-]{0,61}[A-Za-z0-9])?(?:\.[A-Za-z0-9](?:[A-Za-z0-9-]{0,61}[A-Za-z0-9])?)*)>")
BARE_URL = re.compile(r"(?:https?://|ftp://|www\.)[^\s<>]*")
MAIL_DOMAIN = re.compile(r"@([A-Za-z0-9_-]{1,63}(?:\.[A-Za-z0-9_-]{1,63})+)")
MAIL_CHARS = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789.+_-")
TICKS, STARS, BARS = re.compile(r"`+"), re.compile(r"\*+"), re.compile(r"_+")
ANY_TAG = re.compile(r"<(/?)([A-Za-z][\w:.-]*)(?=[\s/>])[^<>]*>")
FOOTNOTE_REF = re.compile(r"\[\^([^\]\s\[]+)\]")
DEST = re.compile(r"<((?:\\.|[^<>\\\n])*)>")
TITLE = re.compile(r"(\"(?:\\.|[^\"\\])*\"|'(?:\\.|[^'\\])*'|\((?:\\.|[^()\\])*\))", re.S)
LABEL = re.compile(r"\[((?:\\.|[^\[\]\\]){0,999})\]", re.S)
PLAIN = re.compile(r"[^\\`*_~=\[\]!<&\n]+")
URL_START = re.compile(r"https?://|ftp://|www\.")
MAX_DEPTH = 200


def close_ticks(s: str, at: int, run: int) -> int:
    """Where the run of exactly so many backticks ends that closes a code span, or -1."""
    for m in TICKS.finditer(s, at):
        if len(m[0]) == run:
            return m.end()
    return -1


def attributes(open_tag: str) -> dict[str, Any] | None:
    """The attributes of a tag: strings, True for bare names, {braces} as JSON where they are."""
    body = re.sub(r"^<[A-Za-z][\w:.-]*|/?>$", "", open_tag)
    out: dict[str, Any] = {}
    for m in _ATTR.finditer(body):
        name = m[1]
        value: Any = next((g for g in m.groups()[1:] if g is not None), True)
        if m[4] is not None:
            value = {"true": True, "false": False}.get(value, value)
            if isinstance(value, str) and value[:1] in "[{":
                try:
                    value = json.loads(value, parse_constant=lambda x: (_ for _ in ()).throw(ValueError(x)))
                except ValueError:
                    pass
        if T.dangerous(name, value) if isinstance(value, str) else name.lower().startswith("on") and open_tag[1:2].islower():
            continue
        out[name] = value
    return out or None


strip_dangerous = T.stripped


def flatten(nodes: list, alt: bool = True) -> str:
    out = []
    for x in nodes:
        if x.type in ("text", "codeInline", "footnoteReference"):
            out.append(x.text or "")
        elif x.type == "breakLine":
            out.append(" ")
        elif x.type == "image":
            out.append(x.alt or "" if alt else "")
        else:
            out.append(flatten(x.children, alt))
    return "".join(out)


def _space(c: str) -> bool:
    return c == "" or c in " \t\n\f\r\v" or unicodedata.category(c) == "Zs"


def _punct(c: str) -> bool:
    return c != "" and (c in S.PUNCT or ord(c) < 0x10000 and unicodedata.category(c)[0] in "PS")


class _Delimiter:
    __slots__ = ("active", "at", "char", "closes", "count", "length", "opens")

    def __init__(self, at: int, char: str, count: int, opens: bool, closes: bool) -> None:
        self.at, self.char, self.count, self.length, self.opens, self.closes, self.active = at, char, count, count, opens, closes, True


class Inline:
    def __init__(self, text: str, refs: dict, options: Any, in_anchor: bool, depth: int) -> None:
        self.s, self.refs, self.options, self.in_anchor, self.depth = text, refs, options, in_anchor, depth
        self.no_ticks: set[int] = set()
        self.brackets: dict[int, int] | None = None
        self.closers: dict[int, tuple[int, int]] | None = None

    def sub(self, text: str, in_anchor: bool | None = None) -> list:
        return Inline(text, self.refs, self.options, self.in_anchor if in_anchor is None else in_anchor, self.depth + 1).run()

    def run(self) -> list:
        s, n, k = self.s, len(self.s), 0
        if self.depth > MAX_DEPTH:
            return [Node("text", text=s)] if s else []
        out: list = []
        buf: list[str] = []
        marks: list[_Delimiter] = []
        linking = not self.in_anchor and not self.options.disable_auto_link
        mails = self.mails() if linking and "@" in s else []
        urls = [m.start() for m in URL_START.finditer(s)] if linking and ("://" in s or "www." in s) else []
        mails.append((n + 1, 0, ""))
        urls.append(n + 1)
        mail = url = 0

        def flush() -> None:
            if buf:
                out.append(Node("text", text="".join(buf)))
                buf.clear()

        while k < n:
            while mails[mail][0] < k:
                mail += 1
            if mails[mail][0] == k:
                _, k, address = mails[mail]
                flush()
                out.append(Node("link", children=[Node("text", text=address)], target="mailto:" + address))
                continue
            while urls[url] < k:
                url += 1
            if urls[url] == k:
                url += 1
                found, end = self.bare(k)
                if found:
                    flush()
                    out.append(found)
                    k = end
                    continue
            m = PLAIN.match(s, k, min(urls[url], mails[mail][0]))
            if m:
                buf.append(m[0])
                k = m.end()
                continue
            c = s[k]
            found, end = None, 0
            if c == "\\":
                if k + 1 < n and s[k + 1] == "\n":
                    found, end = Node("breakLine"), k + 2
                    while end < n and s[end] in " \t":
                        end += 1
                elif k + 1 < n and s[k + 1] in S.PUNCT:
                    buf.append(s[k + 1])
                    k += 2
                    continue
            elif c == "`":
                found, end = self.code(k)
                if not found:
                    run = TICKS.match(s, k)
                    buf.append(run[0])
                    k = run.end()
                    continue
            elif c in "*_":
                m = (STARS if c == "*" else BARS).match(s, k)
                before, after = s[k - 1] if k else "", s[m.end()] if m.end() < n else ""
                left = not _space(after) and (not _punct(after) or _space(before) or _punct(before))
                right = not _space(before) and (not _punct(before) or _space(after) or _punct(after))
                opens = left and (c == "*" or not right or _punct(before))
                closes = right and (c == "*" or not left or _punct(after))
                flush()
                marks.append(_Delimiter(len(out), c, len(m[0]), opens, closes))
                out.append(Node("text", text=m[0]))
                k = m.end()
                continue
            elif c in "~=" and s.startswith(c * 2, k):
                found, end = self.pair(k, c)
                if not found and self.options.streaming:
                    k += 2
                    continue
            elif c == "!" and s.startswith("![", k):
                found, end = self.link(k + 1, True)
            elif c == "[":
                m = FOOTNOTE_REF.match(s, k)
                if m:
                    found, end = Node("footnoteReference", text=m[1], target="#" + self.options.slug(m[1])), m.end()
                else:
                    found, end = self.link(k, False)
            elif c == "<":
                found, end = self.angle(k)
            elif c == "&":
                m = S.ENTITY.match(s, k)
                if m:
                    buf.append(S.decode_entities(m[0]))
                    k = m.end()
                    continue
            elif c == "\n":
                text = "".join(buf)
                bare = text.rstrip(" ")
                hard = len(text) - len(bare) >= 2
                buf[:] = [bare]
                k += 1
                while k < n and s[k] in " \t":
                    k += 1
                if hard:
                    flush()
                    out.append(Node("breakLine"))
                else:
                    buf.append("\n")
                continue
            if found:
                if buf == [""]:
                    buf.clear()
                flush()
                out.append(found)
                k = end
            else:
                buf.append(c)
                k += 1
        flush()
        return self.emphasis(out, marks) if marks else [x for x in out if x.type != "text" or x.text]

    def code(self, k: int):
        m = TICKS.match(self.s, k)
        run = len(m[0])
        if run in self.no_ticks:
            return None, 0
        end = close_ticks(self.s, m.end(), run)
        if end < 0:
            self.no_ticks.add(run)
            return None, 0
        text = self.s[m.end() : end - run].replace("\n", " ")
        if len(text) > 1 and text[0] == text[-1] == " " and text.strip(" "):
            text = text[1:-1]
        return Node("codeInline", text=text), end

    def pair(self, k: int, c: str):
        """~~struck~~ or ==marked== text."""
        s, at = self.s, k + 2
        while at < len(s):
            if s[at] == "\\":
                at += 2
            elif s[at] == "`":
                found, end = self.code(at)
                at = end if found else at + 1
            elif s.startswith(c * 2, at):
                inner = s[k + 2 : at]
                if c == "=" and not inner:
                    return None, 0
                return Node("textFormatted", tag="del" if c == "~" else "mark", children=self.sub(inner)), at + 2
            else:
                at += 1
        return None, 0

    def bracket_ends(self) -> dict[int, int]:
        """Each opening bracket's closing one, skipping escapes, code spans, autolinks and tags; one pass for all."""
        if self.brackets is None:
            s, k, stack, found = self.s, 0, [], {}
            while k < len(s):
                c = s[k]
                if c == "\\":
                    k += 2
                    continue
                if c == "`":
                    span, end = self.code(k)
                    k = end if span else k + len(TICKS.match(s, k)[0])
                    continue
                if c == "<":
                    m = AUTOLINK.match(s, k) or AUTOMAIL.match(s, k) or _OPEN.match(s, k) or _CLOSE.match(s, k)
                    k = m.end() if m else k + 1
                    continue
                if c == "[":
                    stack.append(k)
                elif c == "]" and stack:
                    found[stack.pop()] = k
                k += 1
            self.brackets = found
        return self.brackets

    def link(self, k: int, image: bool):
        s = self.s
        if self.in_anchor and not image:
            return None, 0
        close = self.bracket_ends().get(k)
        if close is None:
            return None, 0
        text, at = s[k + 1 : close], close + 1
        target = title = label = None
        end = 0
        if s.startswith("(", at):
            target, title, end = self.destination(at)
        if not end:
            ref = None
            if (m := LABEL.match(s, at)) and m[1].strip():
                label = S.normalize_label(m[1])
                ref, end = self.refs.get(label), m.end()
                self.refs.uses.append((label, image, ref is not None))
                if ref is None:
                    return None, 0
            elif not re.search(r"(?<!\\)(?:\\\\)*[\[\]]", text) and text.strip() and len(text) < 1000:
                label = S.normalize_label(text)
                ref = self.refs.get(label)
                collapsed = s.startswith("[]", at)
                end = at + 2 if collapsed else at
                if ref or collapsed:
                    self.refs.uses.append((label, image, ref is not None))
            if ref is None or ref.footnote:
                return None, 0
            target, title = ref.target, ref.title
        if image:
            clean = self.options.clean(target, "img", "src")
            return Node("image", alt=flatten(self.sub(text)), target=target if clean is not None else None, rejected=clean is None, title=title, label=label), end
        children = self.sub(text, True) if "[" not in text else self.sub(text)
        if _has_link(children):
            return None, 0
        clean = self.options.clean(target, "a", "href")
        return Node("link", children=children, target=target if clean is not None else None, rejected=clean is None, title=title, label=label), end

    def destination(self, at: int) -> tuple[str | None, str | None, int]:
        """(target, title, end) of an inline destination that begins with a parenthesis, end 0 if it is none."""
        s, n = self.s, len(self.s)
        k = at + 1
        while k < n and s[k] in " \t\n":
            k += 1
        if m := DEST.match(s, k):
            target, k = m[1], m.end()
        else:
            if s.startswith("<", k):
                return None, None, 0
            level, start = 0, k
            while k < n and s[k] not in " \t\n":
                if s[k] == "\\" and k + 1 < n:
                    k += 2
                    continue
                if s[k] == "(":
                    level += 1
                    if level > 32:
                        return None, None, 0
                elif s[k] == ")":
                    if not level:
                        break
                    level -= 1
                k += 1
            if level:
                return None, None, 0
            target = s[start:k]
        gap = k
        while k < n and s[k] in " \t\n":
            k += 1
        title = None
        if k > gap and (m := TITLE.match(s, k)):
            title, k = S.decode_entities(S.unescape(m[1][1:-1])), m.end()
            while k < n and s[k] in " \t\n":
                k += 1
        return (S.decode_entities(S.unescape(target)), title, k + 1) if s.startswith(")", k) else (None, None, 0)

    def angle(self, k: int):
        s = self.s
        if m := AUTOLINK.match(s, k):
            clean = self.options.clean(m[1], "a", "href")
            return Node("link", children=[Node("text", text=m[1])], target=m[1] if clean is not None else None, rejected=clean is None), m.end()
        if m := AUTOMAIL.match(s, k):
            return Node("link", children=[Node("text", text=m[1])], target="mailto:" + m[1]), m.end()
        if self.options.disable_raw_html:
            return None, 0
        if m := _OTHER.match(s, k):
            return Node("htmlComment", text=m[0]), m.end()
        if m := _CLOSE.match(s, k):
            return Node("htmlSelfClosing", tag=re.match(r"</([\w:.-]+)", m[0])[1], raw_open=m[0], text=m[0], completed=True), m.end()
        m = _OPEN.match(s, k)
        if not m:
            return None, 0
        tag = re.match(r"<([A-Za-z][\w:.-]*)", m[0])[1]
        attrs = attributes(m[0])
        if m[0].endswith("/>") or S.is_void(tag):
            return Node("htmlSelfClosing", tag=tag, attrs=attrs, raw_open=m[0], text=m[0]), m.end()
        if k in self.tag_ends():
            close, end = self.tag_ends()[k]
            if close >= m.end():
                inner = s[m.end() : close]
                node = Node("htmlBlock", tag=tag, attrs=attrs, raw_open=m[0], text=inner)
                if tag.lower() not in ("pre", "script", "style", "textarea"):
                    node.children = self.sub(inner, self.in_anchor or tag.lower() == "a")
                return node, end
        return Node("htmlSelfClosing", tag=tag, attrs=attrs, raw_open=m[0], text=m[0], completed=True), m.end()

    def tag_ends(self) -> dict[int, tuple[int, int]]:
        """Where the closing tag of each opening one begins and ends, nested ones of a name counted; one pass for all."""
        if self.closers is None:
            opened: dict[str, list[int]] = {}
            self.closers = {}
            for t in ANY_TAG.finditer(self.s):
                stack = opened.setdefault(t[2].lower(), [])
                if not t[1]:
                    if not t[0].endswith("/>"):
                        stack.append(t.start())
                elif stack:
                    self.closers[stack.pop()] = t.span()
        return self.closers

    def bare(self, k: int):
        s = self.s
        if k and s[k - 1] == "<":
            return None, 0
        m = BARE_URL.match(s, k)
        if not m:
            return None, 0
        url = m[0]
        while url:
            last = url[-1]
            if last in ".,:!?*_~'\"":
                url = url[:-1]
            elif last == ")" and url.count(")") > url.count("("):
                url = url[:-1]
            elif last == ";":
                e = re.search(r"&[A-Za-z0-9]+;\Z", url)
                url = url[: e.start()] if e else url[:-1]
            else:
                break
        www = url.startswith("www.")
        host = re.split(r"[/?#]", re.sub(r"^(?:https?://|ftp://)", "", url), maxsplit=1)[0]
        if not host or host == "www" or www and "." not in host[4:] and "." not in s[k + 4 :] or any("_" in x for x in host.split(".")[-2:]):
            return None, 0
        target = ("http://" if www else "") + url
        clean = self.options.clean(target, "a", "href")
        return Node("link", children=[Node("text", text=url)], target=target if clean is not None else None, rejected=clean is None), k + len(url)

    def mails(self) -> list[tuple[int, int, str]]:
        """(start, end, address) of the bare addresses, in order. Underscores before the first other character are not theirs."""
        s, out, last = self.s, [], 0
        for m in MAIL_DOMAIN.finditer(s):
            k = m.start()
            while k > last and k > m.start() - 65 and s[k - 1] in MAIL_CHARS:
                k -= 1
            if m.start() - k == 65:
                continue
            while k < m.start() and s[k] == "_":
                k += 1
            host = m[1].rstrip("-_")
            if k == m.start() or host != m[1] or any("_" in x for x in host.split(".")[-2:]):
                continue
            last = m.start() + 1 + len(host)
            out.append((k, last, f"{s[k : m.start()]}@{host}"))
        return out

    def emphasis(self, out: list, marks: list[_Delimiter]) -> list:
        """Matches delimiter runs; what a failed search has ruled out is not searched again."""
        bottom: dict[tuple, int] = {}
        spans: list[tuple[int, int, str]] = []
        c = 0
        while c < len(marks):
            closer = marks[c]
            if not closer.closes or not closer.active:
                c += 1
                continue
            while closer.count and closer.active:
                key = (closer.char, closer.length % 3, closer.opens)
                o = c - 1
                low = bottom.get(key, -1)
                while o > low:
                    m = marks[o]
                    if m.active and m.count and m.opens and m.char == closer.char and not ((m.closes or closer.opens) and (m.length + closer.length) % 3 == 0 and (m.length % 3 or closer.length % 3)):
                        break
                    o -= 1
                if o <= low:
                    bottom[key] = c - 1
                    if not closer.opens:
                        closer.active = False
                    break
                opener = marks[o]
                use = 2 if opener.count >= 2 and closer.count >= 2 else 1
                opener.count -= use
                closer.count -= use
                spans.append((opener.at, closer.at, "strong" if use == 2 else "em"))
                for m in marks[o + 1 : c]:
                    m.active = False
            c += 1
        arriving = self.options.streaming  # what could still be matched is not shown as marks
        left = {m.at: "" if arriving and (m.opens or m.closes) else m.char * m.count for m in marks}
        opened: dict[int, list] = {}
        closed: dict[int, int] = {}
        for a, b, tag in spans:
            opened.setdefault(a, []).append(tag)
            closed[b] = closed.get(b, 0) + 1
        stack: list[list] = [[]]
        tags: list[str] = []

        def put(x) -> None:
            here = stack[-1]
            if x.type == "text" and here and here[-1].type == "text":
                here[-1].text += x.text
            elif x.type != "text" or x.text:
                here.append(x)

        for k, x in enumerate(out):
            if k in left:
                for _ in range(closed.get(k, 0)):
                    inner = stack.pop()
                    put(Node("textFormatted", tag=tags.pop(), children=inner))
                put(Node("text", text=left[k]))
                for tag in reversed(opened.get(k, [])):
                    stack.append([])
                    tags.append(tag)
            else:
                put(x)
        return stack[0]


def _has_link(nodes: list) -> bool:
    return any(x.type == "link" or _has_link(x.children) for x in nodes)


def parse(text: str, refs: dict, options: Any, in_anchor: bool = False, depth: int = 0) -> list:
    return Inline(text, refs, options, in_anchor, depth).run()
