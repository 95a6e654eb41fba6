"""Questions over node tables, in DataFrame operations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def sections(nodes: DataFrame, key: str = "doc_id") -> DataFrame:
    """nodes with section: the text of the last heading before each, in its document."""
    w = Window.partitionBy(key).orderBy("node_id").rowsBetween(Window.unboundedPreceding, 0)
    return nodes.withColumn("section", F.last(F.when(F.col("type") == "heading", F.col("content")), ignorenulls=True).over(w))


def descendants(nodes: DataFrame, ancestors: DataFrame, key: str = "doc_id") -> DataFrame:
    """Pairs of an ancestor and a node below it: an equi join by document with the preorder interval as its condition."""
    a = ancestors.select(F.col(key).alias("_key"), F.col("node_id").alias("ancestor_id"), F.col("subtree_end").alias("_end"))
    return nodes.join(a, (F.col(key) == F.col("_key")) & (F.col("node_id") > F.col("ancestor_id")) & (F.col("node_id") <= F.col("_end"))).drop("_key", "_end")


def with_overrides(nodes: DataFrame, overrides: DataFrame, key: str = "tag", broadcast_rows: int = 100_000) -> DataFrame:
    """Tags renamed by a table (tag, new_tag), which is counted and broadcast up to so many rows; a larger one is joined by shuffling."""
    names = overrides.select(F.col(key).alias("its"), "new_tag").where("new_tag IS NOT NULL")
    names = F.broadcast(names) if names.count() <= broadcast_rows else names
    return nodes.join(names, F.col(key) == F.col("its"), "left").withColumn(key, F.coalesce("new_tag", key)).drop("its", "new_tag")


def runs(nodes: DataFrame, same: str, key: str = "doc_id", order: str = "node_id") -> DataFrame:
    """key, run, first, last, n: the stretches of neighbouring rows that agree in a column (gaps and islands)."""
    w = Window.partitionBy(key).orderBy(order)
    held = nodes.withColumn("_island", F.row_number().over(w) - F.row_number().over(Window.partitionBy(key, same).orderBy(order)))
    return held.groupBy(key, same, "_island").agg(F.min(order).alias("first"), F.max(order).alias("last"), F.count("*").alias("n")).drop("_island")


def unresolved(uses: DataFrame, refs: DataFrame, key: str = "doc_id") -> DataFrame:
    """The references whose label their document does not define (left anti join)."""
    return uses.join(refs.select(key, "label"), [key, "label"], "left_anti")
