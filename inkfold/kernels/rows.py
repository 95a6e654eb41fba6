"""A parsed document as flat rows: nodes in preorder, definitions, table cells."""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator, Mapping
from typing import Any

from . import inline as I
from .model import Document, Node, Ref, Refs, deep

NODE_FIELDS = ("node_id", "parent_id", "subtree_end", "depth", "ord", "role", "item_no", "row_no", "col_no", "type", "tag", "level", "id", "text", "lang", "info", "target", "target_rejected", "title", "alt", "alert", "start", "completed", "align", "attrs", "raw_open", "content", "label", "loose", "parts", "typed")


@deep
def nodes(doc: Document, kinds: frozenset[str] | None = None) -> list[tuple]:
    """Tuples of NODE_FIELDS; with kinds, only nodes of those types (ids stay those of the whole tree)."""
    out: list[list] = []

    def walk(x: Node, parent: int | None, depth: int, order: int, role: str, item: int | None, row: int | None, col: int | None) -> None:
        at = len(out)
        if kinds is not None and x.type not in kinds:
            out.append(None)
        else:
            out.append(fields(x, at, parent, depth, order, role, item, row, col))
        deeper(x, at, depth)
        if out[at] is not None:
            out[at][2] = len(out) - 1

    def fields(x: Node, at: int, parent: int | None, depth: int, order: int, role: str, item: int | None, row: int | None, col: int | None) -> list:
        attrs = {k: v if isinstance(v, str) else json.dumps(v) for k, v in (x.attrs or {}).items()} or None
        content = I.flatten(x.children) if x.type in ("heading", "paragraph", "link", "textFormatted", "blockQuote") else None
        parts = len(x.items) if x.items is not None else len(x.rows) if x.rows is not None else None
        typed = [k for k, v in (x.attrs or {}).items() if not isinstance(v, str)] or None
        return [at, parent, at, depth, order, role, item, row, col, x.type, x.tag, x.level, x.id, x.text, x.lang, x.info, x.target, x.rejected, x.title, x.alt, x.alert, x.start, x.completed, x.align, attrs, x.raw_open, content, x.label, x.loose, parts, typed]

    def deeper(x: Node, at: int, depth: int) -> None:
        for k, c in enumerate(x.children):
            walk(c, at, depth + 1, k, "child", None, None, None)
        for i, part in enumerate(x.items or ()):
            for k, c in enumerate(part):
                walk(c, at, depth + 1, k, "item", i, None, None)
        for j, cell in enumerate(x.header or ()):
            for k, c in enumerate(cell):
                walk(c, at, depth + 1, k, "header_cell", None, 0, j)
        for i, line in enumerate(x.rows or (), 1):
            for j, cell in enumerate(line):
                for k, c in enumerate(cell):
                    walk(c, at, depth + 1, k, "body_cell", None, i, j)

    for k, x in enumerate(doc.nodes):
        walk(x, None, 0, k, "root", None, None, None)
    return [tuple(r) for r in out if r is not None]


def document(found: Iterable[Mapping[str, Any]], refs: Iterable[Mapping[str, Any]] = ()) -> Document:
    """The document whose rows of all kinds these are, in any order; what nodes() makes of it is the same rows again."""
    root: list[Node] = []
    by: dict[int, Node] = {}
    for r in sorted(found, key=lambda r: r["node_id"]):
        attrs = {k: json.loads(v) if k in (r["typed"] or ()) else v for k, v in dict(r["attrs"] or {}).items()} or None
        x = Node(r["type"], tag=r["tag"], level=r["level"], id=r["id"], text=r["text"], lang=r["lang"], info=r["info"], target=r["target"], rejected=r["target_rejected"], title=r["title"], alt=r["alt"], alert=r["alert"], start=r["start"], completed=r["completed"], align=list(r["align"]) if r["align"] is not None else None, attrs=attrs, raw_open=r["raw_open"], loose=r["loose"], label=r["label"])
        if x.type == "table":
            x.header, x.rows = [[] for _ in x.align], [[[] for _ in x.align] for _ in range(r["parts"])]
        elif r["parts"] is not None:
            x.items = [[] for _ in range(r["parts"])]
        by[r["node_id"]] = x
        up = by.get(r["parent_id"])
        match r["role"]:
            case "root":
                root.append(x)
            case "child":
                up.children.append(x)
            case "item":
                up.items[r["item_no"]].append(x)
            case "header_cell":
                up.header[r["col_no"]].append(x)
            case "body_cell":
                up.rows[r["row_no"] - 1][r["col_no"]].append(x)
    made = Refs()
    for r in sorted(refs, key=lambda r: r["ord"]):
        made[r["label"]] = Ref(r["label"], r["target"], r["title"], r["ord"], r["is_footnote"])
    return Document(root, made)


def cells(doc: Document) -> Iterator[tuple]:
    """(table_no, row_no, col_no, is_header, align, text) of every table, nested ones too."""
    number = 0
    todo = list(reversed(doc.nodes))
    while todo:
        x = todo.pop()
        if x.type == "table":
            for r, line in enumerate([x.header, *x.rows]):
                for c, cell in enumerate(line):
                    yield number, r, c, r == 0, x.align[c], I.flatten(cell)
            number += 1
        todo += reversed([*x.children, *(c for part in x.items or () for c in part)])
