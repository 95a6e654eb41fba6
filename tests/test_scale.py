"""What large tables need: work over all cores, and memory that does not grow with them."""

import sys

import pytest
from pyspark.sql import functions as F

from inkfold.kernels.model import Options
from inkfold.operators import compile as compile_
from inkfold.operators import parse
from inkfold.plans import catalogue

SF = "/root/testdata/sf0.001"
SCALARS = ["md_to_html", "md_normalize", "strip_html", "safe_markdown_html", "safe_attributes", "encode_url", "sanitize_and_encode", "decode_entities", "md_roundtrip", "html_options", "markdown_options", "parse_switches", "indents", "fenced_heads", "definition_heads", "table_function", "html_table", "markdown_table", "stream_holds_back", "stream_definitions"]


@pytest.mark.parametrize("name", SCALARS)
def test_scalar_kernels_run_on_all_cores(spark, name):
    """A table of one file is one task of a scan; the kernels must not stay in it."""
    assert catalogue.QUERIES[name](spark, SF).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


def measured(nodes) -> int:
    """The most blocks of memory that Python had allocated while it rendered the code spans of these nodes' documents."""
    def rule(node, render):
        return str(sys.getallocatedblocks()) if node.type == "codeInline" else None

    texts = compile_.to_html(nodes.coalesce(1), options={"rule": rule})
    return texts.agg(F.max(F.regexp_extract("html", "([0-9]{4,})", 1).cast("long"))).first()[0]


def documents(spark, n: int, source: str):
    return spark.range(n).select(F.col("id").alias("doc_id"), F.concat(F.lit(source), F.lit("\n\n`x`")).alias("md"))


def measured_elements(nodes) -> int:
    """The same of element trees: what it was at each link."""
    def sanitizer(url, tag, attr):
        return f"/{sys.getallocatedblocks()}"

    found = compile_.to_elements(nodes.coalesce(1), "react", options=Options(sanitizer=sanitizer)).where("tag = 'a'")
    return found.agg(F.max(F.substring(F.col("props")["href"], 2, 20).cast("long"))).first()[0]


def test_rendered_tables_are_read_one_at_a_time(spark):
    """Python holds the nodes of one document, not of a whole batch."""
    table = "|a|b|\n|:-|-:|\n|c|d|"
    few, many = (measured(parse.nodes(documents(spark, n, table))) for n in (100, 4000))
    assert many - few < 100_000


def test_rendered_void_tags_are_read_one_at_a_time(spark):
    few, many = (measured(parse.nodes(documents(spark, n, "a <br> b <br> c <br> d"))) for n in (100, 4000))
    assert many - few < 100_000


def test_element_trees_are_read_one_at_a_time(spark):
    few, many = (measured_elements(parse.nodes(documents(spark, n, "a <br> b <br> c <br> [d](/e)"))) for n in (100, 4000))
    assert many - few < 100_000
