"""Functions that need a kernel, in Arrow batches, and their names in SQL."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..kernels import blocks, html, markdown, rows, tags
from ..kernels import scalars as S
from ..kernels.model import Options, truth


def _text_udf(one):
    @F.pandas_udf(T.StringType())
    def udf(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else one(t))

    return udf


def _text_udf_with_options(one):
    """A function of a text and, if given, of a map of options by name, as in md_to_html(text, map('force_inline', 'true'))."""
    @F.pandas_udf(T.StringType())
    def udf(*columns: pd.Series) -> pd.Series:
        given = columns[1] if len(columns) > 1 else [None] * len(columns[0])
        return pd.Series([None if t is None else one(t, dict(o or {})) for t, o in zip(columns[0], given, strict=True)], dtype=object)

    return udf


def _html(text: str, given: dict) -> str:
    return html.to_html(text, **given)


def _markdown(text: str, given: dict) -> str:
    return markdown.to_markdown(text, Options.of(given), **{k: truth(v) for k, v in given.items() if k in ("reference_links", "setext", "keep_frontmatter")})


@F.pandas_udf(T.MapType(T.StringType(), T.StringType()))
def safe_attributes(attrs: pd.Series) -> pd.Series:
    """A map of a tag's attributes without those that could run code: the rule of the parser and of strip_html."""
    return attrs.map(lambda a: None if a is None else {k: v for k, v in dict(a).items() if not tags.dangerous(k, v)})


md_to_html = _text_udf_with_options(_html)
md_normalize = _text_udf_with_options(_markdown)
md_stream_html = _text_udf_with_options(lambda t, given: html.to_html(t, Options.of({**given, "streaming": True}), **given))
decode_entities = _text_udf(lambda t: S.decode_entities(t))
decode_numeric = _text_udf(lambda t: S.decode_numeric(t))
encode_url = _text_udf(lambda t: S.encode_url(t))
sanitize_and_encode = _text_udf(lambda t: None if S.sanitize_url(t) is None else S.encode_url(t))
strip_html = _text_udf(lambda t: tags.stripped(t))


@F.pandas_udf(T.StructType().add("columns", "integer").add("chars", "integer"))
def indent(lines: pd.Series) -> pd.DataFrame:
    """A line's leading white space: columns (tabs to stops of four) and characters."""
    return pd.DataFrame([(None, None) if t is None else (blocks.indent_of(t), len(t) - len(t.lstrip(" \t"))) for t in lines], columns=["columns", "chars"])


@F.pandas_udf(T.StructType().add("lang", "string").add("info", "string").add("text", "string"))
def parse_code_fenced(texts: pd.Series) -> pd.DataFrame:
    """The fenced code with which a text begins; nulls where it begins with none."""
    found = [blocks.code_fenced(t) if t is not None else None for t in texts]
    return pd.DataFrame([(x.lang, x.info, x.text) if x else (None, None, None) for x in found], columns=["lang", "info", "text"])


@F.pandas_udf(T.StructType().add("label", "string").add("target", "string").add("title", "string"))
def parse_definition(texts: pd.Series) -> pd.DataFrame:
    """The link reference definition with which a text begins; nulls where it begins with none."""
    found = [blocks.definition(t) if t is not None else None for t in texts]
    return pd.DataFrame([(x.label, x.target, x.title) if x else (None, None, None) for x in found], columns=["label", "target", "title"])


@F.udtf(returnType="node_id int, parent_id int, subtree_end int, type string, tag string, level int, id string, text string, target string, content string")
class MdNodes:
    def eval(self, text: str) -> Iterator[tuple]:
        names = rows.NODE_FIELDS
        at = [names.index(n) for n in ("node_id", "parent_id", "subtree_end", "type", "tag", "level", "id", "text", "target", "content")]
        for row in rows.nodes(blocks.parse(text)):
            yield tuple(row[k] for k in at)


@F.udtf(returnType="label string, target string, title string, ord int, footnote boolean")
class MdRefs:
    def eval(self, text: str) -> Iterator[tuple]:
        for r in blocks.parse(text).refs.values():
            yield r.label, r.target, r.title, r.ord, r.footnote


@F.udtf(returnType="ord int, label string, is_image boolean, resolved boolean")
class MdUses:
    def eval(self, text: str) -> Iterator[tuple]:
        for k, use in enumerate(blocks.parse(text).refs.uses):
            yield k, *use


@F.udtf(returnType="ord int, tag string, closing boolean, self_closing boolean, attrs map<string,string>")
class HtmlTags:
    def eval(self, text: str) -> Iterator[tuple]:
        for k, t in enumerate(tags.tags(text or "")):
            yield k, t.name.lower(), t.closing, t.slash, {n: v if v is not None else "true" for n, v, _ in t.attrs if not tags.dangerous(n, v)} if not t.closing else None


@F.udtf(returnType="table_no int, row_no int, col_no int, is_header boolean, align string, text string")
class MdTableCells:
    def eval(self, text: str) -> Iterator[tuple]:
        yield from rows.cells(blocks.parse(text))


def register(spark: SparkSession) -> None:
    """Names for SQL: SELECT md_to_html(text) ...; SELECT n.* FROM docs, LATERAL md_nodes(text) n."""
    for f in ("md_to_html", "md_normalize", "md_stream_html", "decode_entities", "decode_numeric", "encode_url", "sanitize_and_encode", "strip_html", "safe_attributes", "indent", "parse_code_fenced", "parse_definition"):
        spark.udf.register(f, globals()[f])
    for name, f in (("md_nodes", MdNodes), ("md_refs", MdRefs), ("md_uses", MdUses), ("md_table_cells", MdTableCells), ("html_tags", HtmlTags)):
        spark.udtf.register(name, f)
