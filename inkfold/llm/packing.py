"""Packing into optimal length buckets.

The lengths' global histogram goes to a dynamic programme that chooses the bucket boundaries with
the least padding; batches of a token budget then form inside each bucket.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import before, written

MAX_LEN, BUCKETS, BUDGET, BLOCK_ROWS = 4096, 16, 65_536, 1_000_000


def word_count(text: Column) -> Column:
    """Words `[^\\x20\\x09-\\x0D]+`; a null text has none. Splits once, without a Python worker."""
    return F.size(F.filter(F.split(F.coalesce(text, F.lit("")), "[\\x20\\x09-\\x0D]+"), lambda w: w != "")).cast("int")


def optimal_boundaries(lengths: list[int], counts: list[int], buckets: int) -> list[int]:
    """The upper bounds of at most `buckets` buckets that pad least; ties go to fewer buckets.

    lengths ascend strictly. cost(i, j) = sum of counts[i..j] * lengths[j] meets the quadrangle
    inequality, so each layer is solved by divide and conquer: O(buckets * n log n). Of equal costs the lower boundaries are taken.
    """
    n = len(lengths)
    if not n:
        return []
    size = np.asarray(lengths, np.float64)
    before = np.concatenate([[0], np.cumsum(np.asarray(counts, np.float64))])
    best = [np.concatenate([[0.0], np.full(n, np.inf)])]
    froms = []
    for _ in range(min(buckets, n)):
        last, now, back = best[-1], np.full(n + 1, np.inf), np.zeros(n + 1, np.int64)
        todo = [(1, n, 0, n - 1)]
        while todo:
            lo, hi, a, b = todo.pop()
            if lo > hi:
                continue
            j = (lo + hi) // 2
            i = np.arange(a, min(b, j - 1) + 1)
            cost = last[i] + (before[j] - before[i]) * size[j - 1]
            k = int(np.argmin(cost)) if len(cost) else 0
            if len(cost):
                now[j], back[j] = cost[k], a + k
            opt = a + k if len(cost) and np.isfinite(cost[k]) else a
            todo += [(lo, j - 1, a, opt if len(cost) and np.isfinite(cost[k]) else b), (j + 1, hi, opt, b)]
        best.append(now)
        froms.append(back)
    layer = int(np.argmin([x[n] for x in best[1:]]))
    out, j = [], n
    for back in reversed(froms[: layer + 1]):
        out.append(lengths[j - 1])
        j = int(back[j])
        if j == 0:
            break
    return out[::-1]


def pack(documents: DataFrame, max_len: int = MAX_LEN, buckets: int = BUCKETS, budget: int = BUDGET, block_rows: int = BLOCK_ROWS, length: Column | None = None) -> DataFrame:
    """(doc_id, piece, start, n_tokens, bucket, bucket_len, batch, row): every token of every document in one batch.

    A document of more than max_len tokens is cut into pieces of max_len and a rest, so nothing is
    dropped; start is the piece's first token. length counts a row's tokens: the words of `text`
    by default; pass the size of a column of token ids for a tokenizer's own. A text that is null
    or has no token gives one piece of length 0, in bucket length 1 at least. bucket numbers the
    buckets by length from 0; batch numbers a bucket's batches from 0; each holds
    max(1, budget // bucket_len) rows, but the last of a bucket may hold fewer; row is the place in
    the batch. A bucket is filled by doc_id and piece. Repeated rows are packed each by itself; null ids sort first; an empty table gives no rows.

    The histogram has at most max_len + 1 rows. Rows are dealt by ranges of (bucket, doc_id, piece), at most about block_rows
    each (and one range a core at least), and numbered there; the ranges' counts give the offsets, so a bucket that holds
    a third of all rows is dealt to as many tasks as its rows need.
    """
    length = word_count(F.col("text")) if length is None else length
    base = documents.select("doc_id", length.cast("int").alias("n")).withColumn("n", F.coalesce("n", F.lit(0)))
    top = max_len
    pieces = written(base.select("doc_id", F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(F.col("n") / top).cast("int") - 1))).alias("piece"), "n").select(
        "doc_id", "piece", (F.col("piece") * top).alias("start"), F.least(F.lit(top), F.col("n") - F.col("piece") * top).cast("int").alias("n_tokens")), "pieces")
    hist: dict[int, int] = {}
    for n, count in pieces.groupBy("n_tokens").count().collect():  # at most max_len + 1 rows
        hist[max(1, n)] = hist.get(max(1, n), 0) + count
    lengths = sorted(hist)
    bounds = optimal_boundaries(lengths, [hist[x] for x in lengths], buckets) or [1]

    def choose(values: list[int]) -> Column:
        out = F.lit(values[-1])
        for bound, value in list(zip(bounds, values, strict=True))[-2::-1]:
            out = F.when(F.col("n_tokens") <= bound, F.lit(value)).otherwise(out)
        return out

    placed = pieces.withColumn("bucket", choose(list(range(len(bounds))))).withColumn("bucket_len", choose(bounds))
    parts = max(documents.sparkSession.sparkContext.defaultParallelism, -(-sum(hist.values()) // block_rows))
    ranges = placed.repartitionByRange(parts, "bucket", "doc_id", "piece", "n_tokens")
    placed = written(ranges.withColumn("block", F.spark_partition_id()), "ranges", narrowed=False)
    lower_blocks = before(placed.groupBy("bucket", "block").agg(F.count("*").alias("rows")), ["bucket"], "block").select("bucket", "block", "before")
    numbered = placed.withColumn("at", F.row_number().over(Window.partitionBy("bucket", "block").orderBy("doc_id", "piece", "n_tokens")))
    fits = F.greatest(F.lit(1), F.floor(F.lit(budget) / F.col("bucket_len"))).cast("long")
    at = F.col("before") + F.col("at") - 1
    return numbered.join(lower_blocks, ["bucket", "block"]).select(
        "doc_id", "piece", "start", "n_tokens", "bucket", "bucket_len", F.floor(at / fits).cast("long").alias("batch"), (at % fits).cast("int").alias("row"))
