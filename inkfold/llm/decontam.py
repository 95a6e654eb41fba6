"""Benchmark decontamination by spaced-seed hashing, in DataFrame operations only."""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, rows_as, small, written

#: An overlap counts from so many tokens (or the whole item, if shorter), with so many per cent alike.
WINDOW, PERCENT = 13, 80
#: Positions that the masks of an item of so many tokens read (the last entry: of so many or more); they ignore those between.
#: Whatever tokens of WINDOW the PERCENT allow to be others, one mask at one place meets none of them (see complete).
MASKS: dict[int, tuple[tuple[int, ...], ...]] = {
    1: ((0,),),
    2: ((0, 1),),
    3: ((0, 1, 2),),
    4: ((0, 1, 2, 3),),
    5: ((0, 1, 2), (0, 1, 3)),
    6: ((0, 1, 2, 3), (0, 1, 3, 4)),
    7: ((0, 1, 2, 3, 4), (0, 1, 2, 3, 5), (0, 1, 3, 4, 5)),
    8: ((0, 1, 2, 3, 4, 5), (0, 1, 2, 3, 5, 6), (0, 1, 3, 4, 5, 6)),
    9: ((0, 1, 2, 3, 4, 5), (0, 1, 2, 4, 5, 6)),
    10: ((0, 1, 2, 3), (0, 1, 2, 4)),
    11: ((0, 1, 2, 3, 5), (0, 1, 4, 7, 8)),
    12: ((0, 1, 2, 3, 4), (0, 1, 2, 4, 5)),
    13: ((0, 1, 3, 6, 7),),
}


def least_matched(tokens: int, percent: int = PERCENT) -> int:
    return -(-tokens * percent // 100)


def complete(tokens: int, masks: tuple[tuple[int, ...], ...], percent: int = PERCENT) -> bool:
    """Whether some mask misses every set of tokens that may be others, at some place in so many tokens."""
    places = [frozenset(at + p for p in m) for m in masks for at in range(tokens - m[-1])]
    return all(any(p.isdisjoint(other) for p in places) for other in itertools.combinations(range(tokens), tokens - least_matched(tokens, percent)))


def token_hashes(text: Column) -> Column:
    """Hashes of the lower-case runs of letters and digits."""
    tokens = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda t: t != "")
    return F.transform(tokens, lambda t: F.xxhash64(t))


def _seeds(h: str, mask: tuple[int, ...], number: int) -> Column:
    span = mask[-1] + 1
    read = ", ".join(f"{h}[i + {p}]" for p in mask)
    return F.expr(f"CASE WHEN size({h}) >= {span} THEN transform(sequence(0, size({h}) - {span}), i -> xxhash64({number}, {read})) ELSE cast(array() as array<long>) END")


def _all_seeds(df: DataFrame, key: list[str], masks: dict[tuple[int, ...], int]) -> DataFrame:
    """key columns, pos, seed: one row for each position and mask."""
    per = F.array(*[_seeds("h", m, i) for m, i in masks.items()])
    return df.select(*key, F.explode(per).alias("seeds")).select(*key, F.posexplode("seeds").alias("pos", "seed"))


def overlaps(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW, percent: int = PERCENT, min_item: int = 1, masks: dict[int, tuple[tuple[int, ...], ...]] | None = None, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """(doc_id, row, item_id, n_matched, n_tokens, doc_start): one row for each document and item that overlap.

    Both texts become lower-case tokens. A document and an item that share a seed (the tokens that
    a mask reads) are aligned there, and the alignment is verified: some window of
    min(window, item length) of the item's tokens must have at least percent per cent of its tokens
    in place. The masks leave no such window without a seed; those given for another window or percent have to as
    well, else this raises. n_matched is the best window's count, n_tokens its length, doc_start the document's
    token at which that alignment's item begins (negative if it is cut off). So an item of one to four tokens is found
    wherever a document has it as it is; min_item leaves out those that are too short to be evidence.
    Null and empty texts overlap with nothing; a repeated document or item row gives what one gives; rows with
    null ids are treated as any other, their id stays null. Empty tables give no rows. row is the hash of
    the document's text, which tells apart rows with one doc_id.

    Seeds of the benchmark, and the ids of candidates, are counted, and broadcast only up to broadcast_rows; more
    are joined by shuffling. Texts are met again only by candidates, which are one row for
    each document, item and alignment. Masks are tried only where the benchmark has items of their lengths.
    """
    masks = masks or MASKS
    if lossy := [n for n in range(1, window + 1) if n not in masks or not complete(n, masks[n], percent)]:
        raise ValueError(f"the masks lose overlaps of {lossy} tokens")
    docs = documents.select("doc_id", F.xxhash64("text").alias("row"), "text")
    items = benchmark.select("item_id", token_hashes(F.col("text")).alias("h")).distinct().where(F.size("h") >= min_item).where(F.size("h") > 0)
    items = written(items.withColumn("item_row", F.xxhash64("h")).withColumn("long", F.least(F.lit(window), F.size("h"))), "items")
    lengths = sorted(r[0] for r in items.select("long").distinct().collect())  # window numbers at most
    number = {m: k for k, m in enumerate(dict.fromkeys(m for n in range(1, window + 1) for m in masks[n]))}
    marks = [_all_seeds(items.where(F.col("long") == n), ["item_id", "item_row"], {m: number[m] for m in masks[n]}) for n in lengths]
    used = {m: number[m] for n in lengths for m in masks[n]}
    if not used:
        return documents.select("doc_id", F.lit(0).cast("long").alias("row"), F.lit(None).cast(benchmark.schema["item_id"].dataType).alias("item_id"), *[F.lit(0).cast("long").alias(c) for c in ("n_matched", "n_tokens", "doc_start")]).where(F.lit(False))
    every = marks[0]
    for more in marks[1:]:
        every = every.unionByName(more)
    seeds = small(every.select("item_id", "item_row", F.col("pos").alias("item_pos"), "seed"), "seeds", broadcast_rows)
    hashed = docs.select("doc_id", "row", token_hashes(F.col("text")).alias("h"))
    found = _all_seeds(hashed, ["doc_id", "row"], used).join(seeds, "seed").select("doc_id", "row", "item_id", "item_row", (F.col("pos") - F.col("item_pos")).alias("shift")).distinct()
    found = written(found, "candidates")
    wanted = small(found.select(F.col("doc_id").alias("d"), F.col("row").alias("r")).distinct(), "candidate-ids", broadcast_rows)
    same = F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("row") == F.col("r"))
    texts = docs.join(wanted, same, "left_semi").distinct().select("doc_id", "row", token_hashes(F.col("text")).alias("h"))
    found = found.select(F.col("doc_id").alias("d"), F.col("row").alias("r"), F.col("item_id").alias("i"), "item_row", "shift")
    aligned = texts.join(found, same).select("doc_id", "row", "i", "item_row", "shift", "h")
    its = items.select(F.col("item_id").alias("its_id"), F.col("item_row").alias("its_row"), F.col("h").alias("g"))
    aligned = aligned.join(its, F.col("i").eqNullSafe(F.col("its_id")) & (F.col("item_row") == F.col("its_row")))
    hits = F.expr("transform(g, (x, k) -> CASE WHEN k + shift >= 0 AND k + shift < size(h) AND get(h, k + shift) = x THEN 1 ELSE 0 END)")
    aligned = aligned.select("doc_id", "row", F.col("i").alias("item_id"), "shift", hits.alias("hits"), F.least(F.lit(window), F.size("g")).alias("n_tokens"))
    best = F.expr("array_max(transform(sequence(1, size(hits) - n_tokens + 1), s -> aggregate(slice(hits, s, n_tokens), 0, (a, x) -> a + x)))")
    aligned = aligned.withColumn("n_matched", best).where(F.col("n_matched") >= F.ceil(F.col("n_tokens") * percent / 100))
    top = aligned.groupBy("doc_id", "row", "item_id").agg(F.max(F.struct("n_matched", "n_tokens", (-F.col("shift")).alias("back"))).alias("b"))
    return top.select("doc_id", "row", "item_id", F.col("b.n_matched").cast("long").alias("n_matched"), F.col("b.n_tokens").cast("long").alias("n_tokens"), (-F.col("b.back")).cast("long").alias("doc_start"))


def decontaminate(documents: DataFrame, benchmark: DataFrame, **how) -> DataFrame:
    """The documents that overlap with no item, with all their columns. A row goes with its equals."""
    bad = small(overlaps(documents, benchmark, **how).select("doc_id", "row").distinct(), "overlapping")
    return rows_as(documents).join(bad, F.col("doc.doc_id").eqNullSafe(F.col("doc_id")) & (F.xxhash64("doc.text") == F.col("row")), "left_anti").select("doc.*")
