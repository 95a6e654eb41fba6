"""Node tables over event time, for streams and batches alike."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import parse


def node_counts(texts: DataFrame, column: str, time: str, window: str = "1 hour", late: str = "10 minutes", kinds: list[str] | None = None) -> DataFrame:
    """(begin, type, n): the nodes of each type by the window of their text's time.

    On a stream, windows that a text could still come late for are held, others are emitted once; texts later than that are left out.
    """
    timed = texts.withWatermark(time, late).select(F.struct(F.col(time).alias("at")).alias("key"), F.col(column).alias("md"))
    found = parse.nodes(timed.select(F.col("key.at").alias("at"), "md"), key="at", kinds=kinds)
    return found.groupBy(F.window("at", window).alias("w"), "type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("begin"), "type", "n")


def sessions(texts: DataFrame, key: str, time: str, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """(key, begin, end, n): stretches of a key's texts with no gap of so long between them."""
    held = texts.withWatermark(time, late).groupBy(key, F.session_window(time, gap).alias("w")).agg(F.count("*").alias("n"))
    return held.select(key, F.col("w.start").alias("begin"), F.col("w.end").alias("end"), "n")
