"""Connected components of an edge table, without the driver ever seeing an edge."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import removed, written


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """edges (a, b) -> (id, component): the smallest id that each id of the table reaches.

    Alternating large and small stars (Kiveris et al., 2014): every round replaces the edges by
    edges to smaller ids and keeps the components; the rounds grow with the logarithm of the
    longest path. Each round's edges and minima are written tables, so a lost executor costs one
    round, and both sides of each join come straight from an exchange, so that Spark can split
    a hub's rows. Only a count and a checksum come to the driver.
    """
    now = written(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    last = None
    for _ in range(max_rounds):
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % 1_000_003), F.sum(F.xxhash64("v", "u") % 1_000_033)).first()
        if seen == last or not seen[0]:
            break
        last = seen
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        lowest = written(both.groupBy("u").agg(F.min("v").alias("v")).select("u", F.least("u", "v").alias("m")), "least")
        large = both.where("v > u").join(lowest, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = written(large, "large")
        least = written(large.groupBy("u").agg(F.min("v").alias("m")), "least")
        moved = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        before, now = now, written(moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "edges")
        removed(before, lowest, large, least)
    else:
        raise RuntimeError("the components did not settle")
    stars = now.groupBy("u").agg(F.min("v").alias("component")).select(F.col("u").alias("id"), "component")
    return stars.unionByName(stars.select(F.col("component").alias("id"), "component").distinct())
