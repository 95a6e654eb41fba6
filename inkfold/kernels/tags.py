"""Raw HTML as a browser reads it: tags with whatever stands between `<` and `>`, however odd, and what of it is safe."""

from __future__ import annotations

import html
import re
from collections.abc import Callable, Iterator

from . import scalars as S

#: Attributes whose value is a URL that a browser may load or follow.
URL_ATTRS = {"action", "background", "cite", "data", "formaction", "href", "longdesc", "manifest", "ping", "poster", "src", "srcset", "xlink:href"}
#: Elements whose content is no markup to a browser; it is made safe as if it were, since a filter may take the tag away.
RAW = {"iframe", "noembed", "noframes", "noscript", "plaintext", "script", "style", "textarea", "title", "xmp"}

_NAME = re.compile(r"[A-Za-z][^ \t\n\f\r/>]*")
_GAP = re.compile(r"[ \t\n\f\r/]*")
_ATTR = re.compile(r"=?[^ \t\n\f\r/>=]*")
_SIGN = re.compile(r"[ \t\n\f\r]*=[ \t\n\f\r]*")
_BARE = re.compile(r"[^ \t\n\f\r>]*")
_COMMENT_END = re.compile(r"--!?>")
_CONTROL = re.compile(r"[\x00-\x20\x7f]")
_STYLE = re.compile(r"url\(['\"]?(?:javascript|vbscript|data:(?!image/))|expression\(", re.I)


class Tag:
    """end is where the tag's last character was, or -1 if it never ends; attrs are (name, value or None, as written)."""

    __slots__ = ("attrs", "closing", "end", "name", "slash", "start")

    def __init__(self, start: int, name: str, closing: bool) -> None:
        self.start, self.name, self.closing = start, name, closing
        self.attrs: list[tuple[str, str | None, str]] = []
        self.slash, self.end = False, -1


class Scanner:
    """Reads the tags of one text; a quote that never closes is searched for once."""

    def __init__(self, text: str) -> None:
        self.text, self.unclosed = text, set()

    def tag(self, at: int) -> Tag | None:
        """The tag that begins at `at`, if one does."""
        s, n = self.text, len(self.text)
        closing = s.startswith("</", at)
        name = _NAME.match(s, at + 1 + closing)
        if not name:
            return None
        tag, k = Tag(at, name[0], closing), name.end()
        while True:
            k = _GAP.match(s, k).end()
            if k >= n:
                return tag
            if s[k] == ">":
                tag.slash, tag.end = s[k - 1] == "/", k + 1
                return tag
            start = k
            k = _ATTR.match(s, k).end()
            found, value = s[start:k], None
            if sign := _SIGN.match(s, k):
                k = sign.end()
                quote = s[k : k + 1]
                if quote in ("'", '"'):
                    end = -1 if quote in self.unclosed else s.find(quote, k + 1)
                    if end < 0:
                        self.unclosed.add(quote)
                        return tag
                    value, k = s[k + 1 : end], end + 1
                else:
                    bare = _BARE.match(s, k)
                    value, k = bare[0], bare.end()
            tag.attrs.append((found, value, s[start:k]))

    def past(self, at: int) -> int:
        """Where a comment, declaration or instruction that begins at `at` ends; -1 if it never does."""
        s = self.text
        if s.startswith("<!--", at):
            if s.startswith((">", "->"), at + 4):
                return s.index(">", at) + 1
            end = _COMMENT_END.search(s, at + 4)
            return end.end() if end else -1
        return s.find(">", at) + 1 or -1


def tags(text: str) -> Iterator[Tag]:
    """The tags outside comments and raw elements' content, in order."""
    scanner, at = Scanner(text), text.find("<")
    while at >= 0:
        tag = scanner.tag(at)
        if tag and tag.end > 0:
            yield tag
            at = tag.end
            if not tag.closing and tag.name.lower() in RAW:
                close = _close(text, tag.name, at)
                at = close if close >= 0 else len(text)
        elif not tag and text.startswith(("<!", "<?", "</"), at):
            at = scanner.past(at)
            if at < 0:
                return
        else:
            at += 1
        at = text.find("<", at)


def _close(text: str, name: str, at: int) -> int:
    found = re.compile(rf"</{re.escape(name)}(?=[ \t\n\f\r/>])", re.I).search(text, at)
    return found.start() if found else -1


def unsafe_url(value: str, sanitize: Callable[[str], str | None] = S.sanitize_url) -> bool:
    """Whether a browser could run what an attribute's URL holds: references are resolved, with or without their semicolon, and control characters ignored."""
    plain = html.unescape(S.decode_entities(value))
    return sanitize(plain) is None or sanitize(_CONTROL.sub("", plain)) is None


def dangerous(name: str, value: str | None) -> bool:
    low = name.lower()
    if low.startswith("on") or low == "srcdoc":
        return True
    if low == "style":
        return bool(_STYLE.search(_CONTROL.sub("", html.unescape(value or ""))))
    return low in URL_ATTRS and unsafe_url(value or "")


def stripped(text: str) -> str:
    """Raw HTML without the attributes that could run code, and with a `<` that no tag ends after escaped; what is safe stays as it is."""
    if "<" not in text:
        return text
    scanner, out, done, at = Scanner(text), [], 0, text.find("<")
    while at >= 0:
        tag = scanner.tag(at)
        if tag and tag.end < 0:
            out += [text[done:at], "&lt;"]
            done = at = at + 1
        elif tag:
            kept = [raw for name, value, raw in tag.attrs if not dangerous(name, value)]
            if len(kept) < len(tag.attrs) and not tag.closing:
                out += [text[done:at], "<", " ".join([tag.name, *kept]), " />" if tag.slash else ">"]
                done = tag.end
            at = tag.end
            if not tag.closing and tag.name.lower() in RAW:
                close = _close(text, tag.name, at)
                if close >= 0:
                    out += [text[done:at], stripped(text[at:close])]
                    done = at = close
        elif text.startswith(("<!", "<?", "</"), at):
            end = scanner.past(at)
            at = end if end >= 0 else len(text)
        else:
            at += 1
        at = text.find("<", at)
    return "".join([*out, text[done:]])
