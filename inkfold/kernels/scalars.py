"""Scalar string functions that the parser and the compilers share."""

from __future__ import annotations

import html.entities
import re
from urllib.parse import unquote_to_bytes

#: Void elements of HTML (fixed values).
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
#: Tags that the GFM tagfilter extension names (fixed values).
TAGFILTER = ("title", "textarea", "style", "xmp", "iframe", "noembed", "noframes", "script", "plaintext")
#: Letters that a slug folds (fixed values).
_FOLD = {ord(c): d for letters, d in (("ÀÁÂÃÄÅàáâãäåÆæ", "a"), ("Çç", "c"), ("Ðð", "d"), ("ÈÉÊËéèêë", "e"), ("ÏÎÍÌïîíì", "i"), ("Ññ", "n"), ("øØœŒõÕóÓòÒÔÖôö", "o"), ("ÜÛÚÙüûúù", "u"), ("ŸÿÝý", "y")) for c in letters}
_SLUG = _FOLD | {k: chr(k + 32) for k in range(65, 91)} | {32: "-"}
_NOT_SLUG = re.compile(r"[^a-z0-9-]")
PUNCT = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
BAD_SCHEME = re.compile(r"(javascript|vbscript|data(?!:image)):", re.I)
CONTROL = re.compile(r"[\x00-\x1f\x7f]")
NAMED = {k[:-1]: v for k, v in html.entities.html5.items() if k.endswith(";")}
ENTITY = re.compile(r"&(?:#([0-9]{1,7})|#[xX]([0-9a-fA-F]{1,6})|([A-Za-z][A-Za-z0-9]{1,31}));")
_ESCAPED = re.compile(r"\\([!-/:-@\[-`{-~])")
TAGFILTER_RE = re.compile(rf"<(/?)({'|'.join(TAGFILTER)})(\s|>|/)", re.I)


def normalize_input(text: str) -> str:
    if "\r" in text:
        text = text.replace("\r\n", "\n").replace("\r", "\n")
    return text.replace("\0", "\ufffd") if "\0" in text else text


def slugify(text: str) -> str:
    return _NOT_SLUG.sub("", text.translate(_SLUG))


def _char(code: int) -> str:
    return "\ufffd" if code == 0 or code > 0x10FFFF or 0xD800 <= code <= 0xDFFF else chr(code)


def decode_entities(text: str) -> str:
    def one(m: re.Match) -> str:
        if m[1]:
            return _char(int(m[1]))
        if m[2]:
            return _char(int(m[2], 16))
        return NAMED.get(m[3]) or NAMED.get(m[3].lower()) or m[0]

    return ENTITY.sub(one, text) if "&" in text else text


_NUMERIC = re.compile(r"&#(?:[xX]([0-9a-fA-F]+)|([0-9]+));?")


def decode_numeric(text: str) -> str:
    """Numeric references with or without their semicolon, as a browser resolves them in a URL; those of no character stay."""
    def one(m: re.Match) -> str:
        code = int(m[1], 16) if m[1] else int(m[2])
        return chr(code) if 0 < code <= 0x10FFFF and not 0xD800 <= code <= 0xDFFF else m[0]

    return _NUMERIC.sub(one, text) if "&#" in text else text


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text) if "\\" in text else text


def sanitize_url(url: str) -> str | None:
    """The URL, or None where its scheme could run code or its percent escapes are malformed."""
    if BAD_SCHEME.search(url) or CONTROL.search(url) and BAD_SCHEME.search(CONTROL.sub("", url)):
        return None
    if "%" in url:
        if re.search(r"%(?![0-9A-Fa-f]{2})", url):
            return None
        try:
            plain = unquote_to_bytes(url).decode("utf-8")
        except UnicodeDecodeError:
            return None
        if BAD_SCHEME.search(re.sub(r"[^A-Za-z0-9/:]", "", plain)):
            return None
    return url


_URI_SAFE = re.compile(r"%[0-9A-Fa-f]{2}|[A-Za-z0-9;,/?:@&=+$\-_.!~*'()#]")


def encode_url(url: str) -> str:
    out, k = [], 0
    while k < len(url):
        m = _URI_SAFE.match(url, k)
        if m:
            out.append(m[0])
            k = m.end()
        else:
            out.append("".join(f"%{b:02X}" for b in url[k].encode("utf-8", "replace")))
            k += 1
    return "".join(out)


_ESCAPABLE = re.compile('[&<>"]')


def escape_html(text: str) -> str:
    if not _ESCAPABLE.search(text):
        return text
    return text.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;").replace('"', "&quot;")


_BARE_AMP = re.compile(r"&(?!(?:[A-Za-z][A-Za-z0-9]*|#[0-9]+|#[xX][0-9A-Fa-f]+);)")


def escape_attr(text: str) -> str:
    return _BARE_AMP.sub("&amp;", text).replace("<", "&lt;").replace(">", "&gt;").replace('"', "&quot;")


def normalize_label(label: str) -> str:
    return re.sub(r"[ \t\n\r]+", " ", label).strip().replace("ẞ", "ss").lower()


def apply_tagfilter(text: str) -> str:
    return TAGFILTER_RE.sub(r"&lt;\1\2\3", text)


def is_void(tag: str) -> bool:
    return tag.lower().rsplit(":", 1)[-1] in VOID
