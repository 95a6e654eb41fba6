"""Node tables to texts: what was parsed once is rendered without being parsed again."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..kernels import elements, html, markdown, rows
from ..kernels.model import Document, Options
from .parse import ELEMENTS, record_batch

#: Characters of texts that leave together, at least one text.
HELD = 4_000_000


def _documents(nodes: DataFrame, refs: DataFrame | None, key: str) -> DataFrame:
    """key, nodes, refs: a document's rows as arrays, in any order. A document's rows are one text's, so an array is bounded by it."""
    held = nodes.groupBy(key).agg(F.collect_list(F.struct(*rows.NODE_FIELDS)).alias("nodes"))
    if refs is None:
        return held.withColumn("refs", F.lit(None))
    defined = refs.groupBy(F.col(key).alias("its")).agg(F.collect_list(F.struct("ord", "label", "target", "title", "is_footnote")).alias("refs"))
    return held.join(defined, F.col(key).eqNullSafe(F.col("its")), "left").drop("its")


def _each(batch: pa.RecordBatch) -> Iterator[Document]:
    """The documents of (key, nodes, refs), one after the other: the nodes of a whole batch as Python objects would take many times its size."""
    for nodes, refs in zip(batch.column(1), batch.column(2), strict=True):
        yield rows.document(nodes.as_py(), refs.as_py() or ())


def _rendered(nodes: DataFrame, refs: DataFrame | None, key: str, name: str, one: Callable[[Document], str]) -> DataFrame:
    held = _documents(nodes, refs, key)
    schema = T.StructType([held.schema[key], T.StructField(name, T.StringType())])

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, begin, size = [], 0, 0
            for n, doc in enumerate(_each(batch), 1):
                texts.append(one(doc))
                size += len(texts[-1])
                if size >= HELD or n == batch.num_rows:
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(begin, len(texts)), pa.array(texts, pa.string())], names=[key, name])
                    texts, begin, size = [], n, 0

    return held.select(key, "nodes", "refs").mapInArrow(part, schema)


def to_html(nodes: DataFrame, refs: DataFrame | None = None, key: str = "doc_id", options: dict | None = None) -> DataFrame:
    """(key, html) of each document that has nodes; refs give its footnotes. Node tables of all kinds, as parse.nodes makes them."""
    return _rendered(nodes, refs, key, "html", lambda d: html.rendered(d, options))


def to_markdown(nodes: DataFrame, refs: DataFrame | None = None, key: str = "doc_id", **how) -> DataFrame:
    """(key, md): the documents in normal form."""
    return _rendered(nodes, refs, key, "md", lambda d: markdown.Compiler(d, **how).document())


def to_elements(nodes: DataFrame, target: str, refs: DataFrame | None = None, key: str = "doc_id", options: Options | None = None) -> DataFrame:
    """The element tree's rows of each document."""
    held = _documents(nodes, refs, key)
    schema = T.StructType([held.schema[key], *T._parse_datatype_string(ELEMENTS).fields])
    arrow = to_arrow_schema(schema)
    arrow = arrow if isinstance(arrow, pa.Schema) else pa.schema(arrow)

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for batch in batches:
            for k, doc in zip(batch.column(0), _each(batch), strict=True):
                at = k.as_py()
                out += [(at, *r) for r in elements.Tree(doc, options or Options(), target).document()]
                while len(out) >= 8192:
                    yield record_batch(out[:8192], arrow)
                    out = out[8192:]
        if out:
            yield record_batch(out, arrow)

    return held.select(key, "nodes", "refs").mapInArrow(part, schema)
