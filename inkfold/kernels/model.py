"""What a parsed document is made of."""

from __future__ import annotations

import functools
import sys
from collections.abc import Callable, Mapping
from dataclasses import dataclass
from typing import Any

from . import scalars as S

#: Frames that the deepest tree which the parser makes needs.
FRAMES = 12_000


def deep(f: Callable) -> Callable:
    """f with room for deep trees, while it runs; the process's own limit is as before afterwards."""
    @functools.wraps(f)
    def roomy(*args: Any, **how: Any) -> Any:
        limit = sys.getrecursionlimit()
        if limit >= FRAMES:
            return f(*args, **how)
        sys.setrecursionlimit(FRAMES)
        try:
            return f(*args, **how)
        finally:
            sys.setrecursionlimit(limit)

    return roomy


def truth(value: Any) -> Any:
    return {"true": True, "false": False}.get(value.lower(), value) if isinstance(value, str) else value


@dataclass
class Options:
    """What the parser is told. Callables are Python functions that travel with the kernel."""

    tagfilter: bool = True
    disable_auto_link: bool = False
    disable_raw_html: bool = False
    ignore_html_blocks: bool = False
    disable_frontmatter: bool = False
    streaming: bool = False
    sanitizer: Any = None
    slugify: Any = None

    @classmethod
    def of(cls, given: Mapping[str, Any] | None) -> Options:
        """Options from names and values, as SQL gives them: strings "true" and "false" are booleans; other names are left to the compilers."""
        return cls(**{k: truth(v) for k, v in given.items() if k in cls.__dataclass_fields__}) if given else cls()

    def clean(self, url: str, tag: str, attr: str) -> str | None:
        return self.sanitizer(url, tag, attr) if self.sanitizer else S.sanitize_url(url)

    def slug(self, text: str) -> str:
        return self.slugify(text, S.slugify) if self.slugify else S.slugify(text)


class Node:
    """A syntax node: its type, and of the fields below those that its type has."""

    items: list[list[Node]] | None = None
    header: list[list[Node]] | None = None
    rows: list[list[list[Node]]] | None = None
    raw: Any = None
    tag: str | None = None
    level: int | None = None
    id: str | None = None
    text: str | None = None
    lang: str | None = None
    info: str | None = None
    target: str | None = None
    rejected: bool = False
    title: str | None = None
    alt: str | None = None
    alert: str | None = None
    start: int | None = None
    completed: bool | None = None
    align: list[str | None] | None = None
    attrs: dict[str, Any] | None = None
    raw_open: str | None = None
    loose: bool | None = None
    label: str | None = None

    def __init__(self, type: str, children: list[Node] | None = None, **has: Any) -> None:
        self.type, self.children = type, [] if children is None else children
        if has:
            self.__dict__.update(has)


class Refs(dict):
    """Definitions by label, and the references made by label: (label, image, resolved)."""

    def __init__(self) -> None:
        super().__init__()
        self.uses: list[tuple[str, bool, bool]] = []


@dataclass
class Ref:
    label: str
    target: str
    title: str | None
    ord: int
    footnote: bool


@dataclass
class Document:
    nodes: list[Node]
    refs: dict[str, Ref]
