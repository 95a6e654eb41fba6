"""Text that is still arriving: what would flash or flicker at the end of a prefix is held back."""

from __future__ import annotations

import re

def _fence_open(text: str) -> bool:
    open_mark = None
    for line in text.split("\n"):
        m = re.match(r" {0,3}(`{3,}|~{3,})", line)
        if m and open_mark is None:
            open_mark = m[1]
        elif m and line.strip().startswith(open_mark) and not line.strip().strip(open_mark[0]):
            open_mark = None
    return open_mark is not None


def settle(text: str) -> str:
    """The prefix without an unfinished table, tag, setext underline, list marker, emphasis, code span or link at its end."""
    if _fence_open(text):
        return text
    lines = text.split("\n")
    start = len(lines)
    while start > 0 and lines[start - 1].strip():
        start -= 1
    block = lines[start:]
    if block and "|" in block[0]:  # a table shows from its first body row on
        ruled = len(block) > 1 and re.fullmatch(r"[\s|:-]+", block[1]) and "-" in block[1]
        if not ruled:
            if block[0].lstrip().startswith("|"):
                return "\n".join(lines[:start])
        elif len(block) == 2 or not block[2].replace("|", "").strip():
            return "\n".join(lines[:start])
    if block:
        if re.fullmatch(r" {0,3}(?:-{1,2}|=+)[ \t]*", block[-1]) and len(block) > 1 or re.fullmatch(r"\s*(?:[-*+]|\d{1,9}[.)]?)[ \t]*", block[-1]):
            block = block[:-1]
        tail = "\n".join(block)
        m = re.search(r"<(?:/?[A-Za-z][^<>\n]*|/|!-{0,2}[^>]*)?\Z", tail)
        if m and (len(m[0]) > 1 or not tail.endswith("< ")):
            tail = tail[: m.start()]
        tail = re.sub(r"<([A-Z][\w.]*)(?:\s[^<>]*)?>(?!.*</\1>)", "", tail, flags=re.S)
        tail = _spans(tail)
        lines = [*lines[:start], *tail.split("\n")]
    return "\n".join(lines)


def _spans(text: str) -> str:
    ticks = [m.start() for m in re.finditer(r"(?<!`)`(?!`)", text)]
    if len(ticks) % 2:
        text = text[: ticks[-1]]
    image = re.search(r"!\[[^\]\n]*(?:\](?:\([^)\n]*)?)?\Z", text)
    if image:
        text = text[: image.start()]
    link = re.search(r"\[([^\]\n]*)(?:\](?:\([^)\n]*)?)?\Z", text)
    if link and not re.search(r"\]\Z", link[0]):
        text = text[: link.start()] + link[1]
    return text
