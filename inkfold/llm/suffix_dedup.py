"""Repeated passages by a sparse suffix array.

Suffixes are retained where the text itself says so, at minimisers: the position whose GRAM words hash lowest
in some window of WINDOW positions. Two copies of a passage of LEAST words choose the same positions in it, so only suffixes
whose minimisers other texts have too can lie in a repeat. These are sorted by their words across the cluster, and
those that come to stand together are compared and extended: with o words to the left and LEAST - o to the right, for each o
for which the suffix is the lowest of its window, so that every window of LEAST words belongs to one suffix.
What the neighbours leave open (a text in between may share more to the right and less to the left) meets again by
its hash, so that every window that two texts hold is found, wherever partitions are cut.
The union of a document's windows gives its repeated passages, of any length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordHashes, batches, mixed, parts_for, removed, utf8, windows, written

LEAST, GRAM, WINDOW = 50, 8, 32
#: Suffix rows (some 400 bytes each) that one task sorts, about.
SORTED_ROWS = 250_000


def word_hashes(text: bytes | None, hashes: WordHashes) -> np.ndarray:
    return hashes.of((text or b"").lower().split())


def lowest(grams: np.ndarray, window: int, chunk: int = 16_384) -> np.ndarray:
    """The position of the lowest (leftmost of equals) of each window; so many windows at once, since each is copied out."""
    n = len(grams) - window + 1
    view = np.lib.stride_tricks.sliding_window_view(grams, window)
    return np.concatenate([view[k : k + chunk].argmin(1) + np.arange(k, min(n, k + chunk)) for k in range(0, n, chunk)])


def minimisers(grams: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Positions that are the lowest of some window; of all positions, if they are fewer."""
    return np.unique(lowest(grams, min(window, len(grams)))) if len(grams) else np.empty(0, np.int64)


def _anchors(documents: DataFrame, least: int) -> DataFrame:
    """id, key, n: each minimiser's hash once per document, and a row without key that has its number of words."""
    def part(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in rows:
            ids, keys, counts, words = batch.column(0).to_numpy(), [], [], []
            for text in utf8(batch.column(1)):
                h = word_hashes(text, hashes)
                g = mixed(windows(h, GRAM)) if len(h) >= least else np.empty(0, np.uint64)
                k = np.unique(g[minimisers(g)])
                keys.append(k.view(np.int64))
                counts.append(len(k))
                words.append(len(h))
            none = pa.nulls(sum(counts), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, counts)), pa.array(np.concatenate(keys) if keys else np.empty(0, np.int64)), none], names=["id", "key", "n"])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.nulls(len(ids), pa.int64()), pa.array(words, pa.int64())], names=["id", "key", "n"])

    return documents.select("id", "text").mapInArrow(part, "id long, key long, n long")


def _suffixes(documents: DataFrame, least: int) -> DataFrame:
    """key, lead, rest, id, name, at, begin, grams: the suffix at word `at` (its first GRAM words' hash, and those that follow up to
    `least` as a number and as bytes that sort like them), and the hash of each window of least words from `begin` on whose lowest
    minimiser it is and whose minimisers are all named by keys; a window that two texts share always is one."""
    def part(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        inner = least - GRAM - WINDOW + 2  # windows of the minimisers in one of least words

        def every() -> Iterator[tuple]:
            for batch in rows:
                for doc, text, keys, name in zip(batch.column(0).to_pylist(), utf8(batch.column(1)), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                    h = word_hashes(text, hashes)
                    g = mixed(windows(h, GRAM))
                    named = np.concatenate([[0], np.cumsum(np.isin(g[lowest(g, WINDOW)].view(np.int64), np.array(keys, np.int64)))])
                    at = np.nonzero(named[inner:] - named[:-inner] == inner)[0]
                    if not len(at):
                        continue
                    gram = np.zeros(len(at), np.uint64)
                    for k in (*range(0, least - GRAM, GRAM), least - GRAM):
                        gram = mixed(gram * np.uint64(0x9E3779B97F4A7C15) + g[at + k])
                    anchor = lowest(g, least - GRAM + 1)[at]
                    cut = np.nonzero((np.diff(at) != 1) | (np.diff(anchor) != 0))[0] + 1
                    words = (h >> np.uint64(32)).astype(">u4").tobytes()
                    gram, g = gram.view(np.int64), g.view(np.int64)
                    for i, j in zip([0, *cut.tolist()], [*cut.tolist(), len(at)], strict=True):
                        a = int(anchor[i])
                        rest = words[4 * (a + GRAM) : 4 * (a + least)]
                        yield int(g[a]), int.from_bytes(rest[:8].ljust(8, b"\0")) - (1 << 63), rest, doc, name, a, int(at[i]), gram[i:j]

        yield from batches(every(), pa.schema([("key", pa.int64()), ("lead", pa.int64()), ("rest", pa.binary()), ("id", pa.int64()), ("name", pa.int64()), ("at", pa.int64()), ("begin", pa.int64()), ("grams", pa.list_(pa.int64()))]))

    return documents.select("id", "text", "keys", "name").mapInArrow(part, "key long, lead long, rest binary, id long, name long, at long, begin long, grams array<long>")


def _compared(suffixes: DataFrame, least: int) -> DataFrame:
    """gram, id, begin, end, name, partner, by sorted suffixes, of three kinds: with end, what a suffix shares with one of another document
    that stands near it (gram: its first window); with begin alone, a window that no neighbour shares; with
    partner, the lowest and highest names of neighbours that share a window.
    """
    names = ["gram", "id", "begin", "end", "name", "partner"]

    def part(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made(*columns: np.ndarray | None) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.nulls(len(columns[0]), pa.int64()) if x is None else pa.array(x, pa.int64()) for x in columns], names=names)

        for batch in rows:
            grams = batch.column(3)
            many = np.diff(grams.offsets.to_numpy())
            gram = grams.flatten().to_numpy()
            if not len(gram):
                continue
            row = np.repeat(np.arange(len(many)), many)
            doc, name = batch.column(0).to_numpy()[row], batch.column(1).to_numpy()[row]
            begin = batch.column(2).to_numpy()[row] + np.arange(len(gram)) - np.repeat(np.cumsum(many) - many, many)
            order = np.argsort(gram, kind="stable")  # what agrees to the left and right stands together
            starts = np.concatenate([[0], np.nonzero(np.diff(gram[order]))[0] + 1])
            low, high = np.minimum.reduceat(name[order], starts), np.maximum.reduceat(name[order], starts)
            yield made(gram[order][starts][low != high], None, None, None, low[low != high], high[low != high])
            shared = np.empty(len(gram), bool)
            shared[order] = np.repeat(low != high, np.diff(np.append(starts, len(gram))))
            yield made(gram[~shared], doc[~shared], begin[~shared], None, name[~shared], None)
            k = np.nonzero(shared)[0]
            if len(k):
                new = np.concatenate([[0], np.nonzero((np.diff(k) != 1) | (np.diff(row[k]) != 0))[0] + 1])
                last = np.append(new[1:], len(k)) - 1
                yield made(gram[k[new]], doc[k[new]], begin[k[new]], begin[k[last]] + least, name[k[new]], None)

    return suffixes.select("id", "name", "begin", "grams").mapInArrow(part, ", ".join(f"{n} long" for n in names))


def _merged(found: DataFrame) -> DataFrame:
    """id, begin, end, name, gram: what meets or overlaps as one, with its first window; rows of these columns are sorted by id and begin."""
    def part(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def every() -> Iterator[tuple]:
            doc, begin, end, name, gram = None, 0, 0, 0, 0
            for batch in rows:
                for i, b, e, n, g in zip(*[batch.column(k).to_pylist() for k in range(5)], strict=True):
                    if i != doc or b > end:
                        if doc is not None:
                            yield doc, begin, end, name, gram
                        doc, begin, end, name, gram = i, b, e, n, g
                    end = max(end, e)
            if doc is not None:
                yield doc, begin, end, name, gram

        yield from batches(every(), pa.schema([(c, pa.int64()) for c in ("id", "begin", "end", "name", "gram")]))

    return found.mapInArrow(part, "id long, begin long, end long, name long, gram long")


def passages(documents: DataFrame, least: int = LEAST) -> DataFrame:
    """(doc_id, begin, end, n_words, partner): the passages of at least `least` words that another document holds too.

    Words are `[^\\x20\\x09-\\x0D]+` with A-Z lower-cased; begin and end count them in the whole text. partner
    holds the passage's first `least` words: of the documents that do (of each text, its smallest), the smallest, or the largest if that is the document itself; of a whole text's
    copies, the smallest and largest likewise. Passages that meet or overlap are one.
    A text of at least `least` words that other rows repeat whole is one passage. Repeats within one text are not
    reported. Rows that share doc_id and text are one document; rows with one doc_id and other texts are searched each by itself.
    Null or empty texts, texts under `least` words, and rows with a null doc_id give none; so does an empty table.

    Equal texts meet once, by their 128-bit hash, so groups of copies cost no more than their rows. The sort is by range over
    the suffix and its place, so that even one passage of many documents is dealt out; a window's holders are counted with a
    partial aggregation. Neither the passages nor their partners depend on how the rows are dealt. `least` is 40 at least.
    """
    if least < GRAM + WINDOW:
        raise ValueError(f"least is {GRAM + WINDOW} at least")
    docs = documents.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull()).select(F.col("doc_id").cast("long"), "text")
    same = written(docs.select("doc_id", F.xxhash64("text").alias("h1"), F.xxhash64(F.lit("second"), "text").alias("h2")).distinct(), "texts")
    first = written(same.groupBy("h1", "h2").agg(F.min("doc_id").alias("id"), F.max("doc_id").alias("other")), "first-texts")
    anchors = written(_anchors(docs.select(F.xxhash64("text").alias("id"), "text"), least), "anchors")
    often = written(anchors.where("key IS NOT NULL").groupBy("key").agg(F.min("id").alias("x"), F.max("id").alias("y")).where("x <> y").select("key"), "shared-keys")
    wanted = anchors.join(often, "key").groupBy("id").agg(F.collect_set("key").alias("keys"))  # one text's own anchors
    # the first row of each text stands for all of them, so each text is met once
    wanted = wanted.join(first.select(F.col("h1").alias("id"), F.col("id").alias("doc_id")), "id")
    texts = docs.withColumn("h1", F.xxhash64("text")).join(wanted.withColumnRenamed("id", "h1"), ["doc_id", "h1"])
    suffixes = written(_suffixes(texts.select(F.col("h1").alias("id"), "text", "keys", F.col("doc_id").alias("name")), least), "suffixes")
    removed(often)
    ordered = suffixes.repartitionByRange(parts_for(suffixes, SORTED_ROWS), "key", "lead", "id", "at").sortWithinPartitions("key", "lead", "rest", "id", "at")
    compared = written(_compared(ordered, least), "compared")
    removed(suffixes)
    holders = compared.where("end IS NULL").groupBy("gram").agg(F.min("name").alias("low"), F.max(F.coalesce("partner", "name")).alias("high"))
    holders = written(holders.where("low <> high"), "holders")
    left = compared.where("end IS NULL AND begin IS NOT NULL").join(holders.select("gram"), "gram").select("id", "begin", (F.col("begin") + least).alias("end"), "name", "gram")
    found = compared.where("end IS NOT NULL").select("id", "begin", "end", "name", "gram").unionByName(left)
    found = _merged(found.repartition("id").sortWithinPartitions("id", "begin", "end"))  # one text's own windows
    spans = written(found.join(holders, "gram").select("id", "begin", "end", F.when(F.col("name") == F.col("low"), F.col("high")).otherwise(F.col("low")).alias("partner")), "spans")
    removed(compared, holders)
    whole = first.where("other <> id")
    copied = same.join(whole.select("h1", "h2", "id", "other"), ["h1", "h2"]).select("doc_id", "h1", "h2", F.when(F.col("doc_id") == F.col("id"), F.col("other")).otherwise(F.col("id")).alias("partner"))
    sized = anchors.where(F.col("n") >= least).groupBy(F.col("id").alias("h1")).agg(F.max("n").alias("n"))
    whole_rows = copied.join(sized, "h1").select("doc_id", F.lit(0).cast("long").alias("begin"), F.col("n").alias("end"), F.col("n").alias("n_words"), "partner")
    single = same.join(first.where("other = id").select("h1", "h2"), ["h1", "h2"]).select("doc_id", F.col("h1").alias("id"))
    parts_rows = single.join(spans, "id").select("doc_id", "begin", "end", (F.col("end") - F.col("begin")).alias("n_words"), "partner")
    return whole_rows.unionByName(parts_rows)


def cut_passages(documents: DataFrame, least: int = LEAST) -> DataFrame:
    """doc_id and passages: an array of the repeated passages (begin, end, n_words, partner) of each document that has any."""
    return passages(documents, least).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("begin", "end", "n_words", "partner"))).alias("passages"))
