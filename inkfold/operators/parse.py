"""Texts to tables: nodes, definitions, table cells, element trees, HTML tags. Narrow stages, no shuffle."""

from __future__ import annotations

import html
from collections.abc import Callable, Iterator, Mapping
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..kernels import blocks, elements, rows, tags
from ..kernels.model import Options

NODES = "node_id int, parent_id int, subtree_end int, depth int, ord int, role string, item_no int, row_no int, col_no int, type string, tag string, level int, id string, text string, lang string, info string, target string, target_rejected boolean, title string, alt string, alert string, start int, completed boolean, align array<string>, attrs map<string,string>, raw_open string, content string, label string, loose boolean, parts int, typed array<string>"
REFS = "label string, target string, title string, ord int, is_footnote boolean"
USES = "ord int, label string, is_image boolean, resolved boolean"
CELLS = "table_no int, row_no int, col_no int, is_header boolean, align string, text string"
ELEMENTS = "el_id int, parent_id int, tag string, props map<string,string>, text string"
TAGS = "ord int, tag string, closing boolean, self_closing boolean, attrs map<string,string>"


def _exploded(df: DataFrame, key: str, column: str, ddl: str, make: Callable[[str], list[tuple]]) -> DataFrame:
    """key and a row for each tuple that make gives for the text. Rows leave in small batches, so memory holds one document's."""
    if df.schema[column].dataType.simpleString() != "string":
        raise TypeError(f"{column} is {df.schema[column].dataType.simpleString()}; texts are strings")
    schema = T.StructType([df.schema[key], *T._parse_datatype_string(ddl).fields])
    arrow = to_arrow_schema(schema)
    arrow = arrow if isinstance(arrow, pa.Schema) else pa.schema(arrow)

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for batch in batches:
            for k, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if text is not None:
                    held += [(k, *r) for r in make(text)]
                while len(held) >= 8192:
                    yield record_batch(held[:8192], arrow)
                    held = held[8192:]
        if held:
            yield record_batch(held, arrow)

    return spread(df.select(key, column)).mapInArrow(part, schema)


def spread(df: DataFrame) -> DataFrame:
    """df over all cores where a scan would give it to fewer: a small file of many texts is one task, and parsing is what costs."""
    if df.isStreaming:
        return df
    cores, session = df.sparkSession.sparkContext.defaultParallelism, df.sparkSession._jsparkSession.sessionState()
    size = df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    return df.repartition(cores) if int(size) < cores * session.conf().filesMaxPartitionBytes() else df


def record_batch(held: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = [pa.array([list(v.items()) if isinstance(v, dict) else v for v in c], f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)]
    return pa.RecordBatch.from_arrays(columns, schema=schema)


def nodes(df: DataFrame, key: str = "doc_id", column: str = "md", kinds: list[str] | None = None, options: Options | None = None) -> DataFrame:
    """One row for each syntax node, in preorder; with kinds the kernel emits only those types."""
    wanted = frozenset(kinds) if kinds else None
    return _exploded(df, key, column, NODES, lambda t: rows.nodes(blocks.parse(t, options), wanted))


def refs(df: DataFrame, key: str = "doc_id", column: str = "md", options: Options | None = None) -> DataFrame:
    """Link and footnote definitions. Texts without an opening bracket never reach Python."""
    return _exploded(df.where(F.col(column).contains("[")), key, column, REFS, lambda t: [(r.label, r.target, r.title, r.ord, r.footnote) for r in blocks.parse(t, options).refs.values()])


def uses(df: DataFrame, key: str = "doc_id", column: str = "md", options: Options | None = None) -> DataFrame:
    """Links and images made by label, in order; those whose label nothing defines are not resolved and stay text."""
    return _exploded(df.where(F.col(column).contains("[")), key, column, USES, lambda t: [(k, *u) for k, u in enumerate(blocks.parse(t, options).refs.uses)])


def table_cells(df: DataFrame, key: str = "doc_id", column: str = "md", options: Options | None = None) -> DataFrame:
    return _exploded(df.where(F.col(column).contains("|")), key, column, CELLS, lambda t: list(rows.cells(blocks.parse(t, options))))


def element_tree(df: DataFrame, target: str, key: str = "doc_id", column: str = "md", options: Options | None = None, overrides: Mapping[str, Any] | None = None) -> DataFrame:
    """Rows of the element tree for react, native, solid or vue; overrides name other tags, or (tag, props), by tag."""
    if target not in elements.TARGETS:
        raise ValueError(f"target is one of {', '.join(elements.TARGETS)}")
    return _exploded(df, key, column, ELEMENTS, lambda t: elements.to_elements(t, options, target, overrides))


def html_tags(df: DataFrame, key: str = "page_id", column: str = "html") -> DataFrame:
    """One row for each tag of raw HTML outside comments and raw elements' content, with its safe attributes."""
    def make(text: str) -> list[tuple]:
        out = []
        for t in tags.tags(text):
            attrs = {n: html.unescape(v) if v is not None else "true" for n, v, _ in t.attrs if not tags.dangerous(n, v)} if not t.closing else None
            out.append((len(out), t.name.lower(), t.closing, t.slash, attrs or None))
        return out

    return _exploded(df, key, column, TAGS, make)
