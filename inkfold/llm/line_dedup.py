"""Line dedup over levelled sorted runs of line hashes."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ASCII_SPACE, ascii_lower, folder, removed, rows_as, written

MIN_CHARS, MIN_DOCS, BATCHES, FANOUT = 40, 5, 3, 2
#: Lines (32 bytes each) of a bucket of a run.
BUCKET_ROWS = 1_000_000
#: Lines that make another bucket worth its files, until each core has one.
LEAST_ROWS = 200_000


def line_key(line: Column) -> Column:
    return ascii_lower(F.btrim(line, F.lit(ASCII_SPACE)))


def _hash(key: Column) -> Column:
    """128 bits, so that lines of a whole crawl do not collide."""
    return F.struct(F.xxhash64(key).alias("h1"), F.xxhash64(F.lit("second"), key).alias("h2"))


def _lines(text: str = "text") -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_hashes(documents: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """doc_id, row (the row's own 64-bit hash), h1, h2: each key of at least min_chars code points once per row."""
    keys = F.array_distinct(F.transform(F.filter(F.transform(_lines(), line_key), lambda k: F.length(k) >= min_chars), _hash))
    return documents.select("doc_id", F.xxhash64("text").alias("row"), F.explode(keys).alias("k")).select("doc_id", "row", "k.h1", "k.h2")


class LineRuns:
    """Runs of (h1, h2, docs, last), sorted by hash, in levels; `fanout` runs of a level become one of the next.

    docs counts the rows that hold a line, last is the largest doc_id among them. A run is a table in the shared folder, bucketed
    and sorted by hash, so a batch dealt out the same way meets it bucket by bucket, by merging, and no run is ever shuffled for that.
    Buckets are as many as keep them at BUCKET_ROWS rows each, or the cores if they are more and get LEAST_ROWS rows each; two
    at least, since Spark deals a batch to a single one only after the joins.
    load() anti-joins a batch with every run: what none holds is its own run, on level 0; what some run holds is kept apart, as
    repeats. So each line is in one run, a compaction has nothing to add up, and only lines that came again are counted again.
    """

    KEY = ("h1", "h2")

    def __init__(self, spark: SparkSession, fanout: int = FANOUT, rows: int = 0) -> None:
        self.spark, self.fanout = spark, fanout
        self.buckets = max(2, min(spark.sparkContext.defaultParallelism, -(-rows // LEAST_ROWS)), -(-rows // BUCKET_ROWS))
        self.levels: list[list[str]] = [[]]
        self.repeats: list[DataFrame] = []
        self.places: dict[str, str] = {}

    def table(self, rows: DataFrame) -> str:
        """rows, which are dealt by hash, as a table in buckets of sorted hashes; its name."""
        path = folder(self.spark, "line-run")
        name = "inkfold_" + path.rpartition("-")[2]
        rows.write.bucketBy(self.buckets, *self.KEY).sortBy(*self.KEY).option("path", path).saveAsTable(name)
        self.places[name] = path
        return name

    def dealt(self, rows: DataFrame) -> DataFrame:
        return rows.repartition(self.buckets, *self.KEY)

    def drop(self, *names: str) -> None:
        for name in names:
            gone = self.spark.table(name)
            gone.written_at = self.places.pop(name)
            self.spark.sql(f"DROP TABLE {name}")
            removed(gone)

    def runs(self) -> list[DataFrame]:
        return [self.spark.table(name) for level in self.levels for name in level]

    def unseen(self, batch: DataFrame) -> DataFrame:
        """The batch's rows whose lines no run holds: a merge anti join with each run."""
        for run in self.runs():
            batch = batch.join(run.select(*self.KEY).hint("merge"), list(self.KEY), "left_anti")
        return batch

    def load(self, batch: DataFrame) -> None:
        """A batch (h1, h2, docs, last), each line once."""
        before, batch = bool(self.runs()), self.dealt(batch)
        own = self.table(self.unseen(batch).select("h1", "h2", "docs", "last"))
        if before:
            self.repeats.append(written(batch.join(self.spark.table(own).select(*self.KEY).hint("merge"), list(self.KEY), "left_anti").select("h1", "h2", "docs", "last"), "line-repeats"))
        self.levels[0].append(own)
        self.compact()

    def compact(self) -> None:
        level = 0
        while level < len(self.levels):
            if len(self.levels[level]) >= self.fanout:
                old, self.levels[level] = self.levels[level], []
                if level + 1 == len(self.levels):
                    self.levels.append([])
                self.levels[level + 1].append(self.table(functools.reduce(self.merged, [self.spark.table(name) for name in old])))
                self.drop(*old)
            level += 1

    def merged(self, a: DataFrame, b: DataFrame) -> DataFrame:
        """Two runs, which have no line in common, bucket by bucket. Of a union that is dealt out Spark drops the dealing and then the
        buckets, so each task would write files of many buckets."""
        b = b.select(*self.KEY, F.col("docs").alias("docs_b"), F.col("last").alias("last_b"))
        return a.join(b.hint("merge"), list(self.KEY), "full").select(*self.KEY, F.coalesce("docs", "docs_b").alias("docs"), F.coalesce("last", "last_b").alias("last"))

    def counts(self, least: int = 1) -> DataFrame:
        """h1, h2, docs, last of the lines that at least so many rows hold."""
        if not self.runs():
            return self.spark.createDataFrame([], "h1 long, h2 long, docs long, last long")
        if not self.repeats:
            return functools.reduce(DataFrame.unionByName, self.runs()).where(F.col("docs") >= least)
        again = functools.reduce(DataFrame.unionByName, self.repeats).groupBy(*self.KEY).agg(F.sum("docs").alias("more"), F.max("last").alias("later"))
        again = written(again, "line-repeats")
        found = [run.join(again, list(self.KEY), "left").select(*self.KEY, (F.col("docs") + F.coalesce("more", F.lit(0))).alias("docs"), F.greatest("last", "later").alias("last")) for run in self.runs()]
        return functools.reduce(DataFrame.unionByName, found).where(F.col("docs") >= least)

    def close(self) -> None:
        """Deletes the runs."""
        self.drop(*[name for level in self.levels for name in level])
        removed(*self.repeats)
        self.levels, self.repeats = [[]], []


def batched(hashes: DataFrame, batches: int) -> DataFrame:
    """(doc_id, row, h1, h2) as a written table of so many batches (h1, h2, docs, last, batch), from one scan; a task's batches stand
    one after another in one file, so that a reader may skip the pages of the others."""
    rows = hashes.groupBy(F.pmod("row", F.lit(batches)).cast("int").alias("batch"), "h1", "h2").agg(F.count("*").alias("docs"), F.max("doc_id").alias("last"))
    return written(rows.select("h1", "h2", "docs", "last", "batch").sortWithinPartitions("batch"), "line-batches", narrowed=False)


def dedup_lines(documents: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, batches: int = BATCHES) -> DataFrame:
    """(doc, new_text, n_lines, n_dropped) of every row; doc is a struct of the row's own columns, whatever their names.

    A line's key has `[\\x20\\x09-\\x0D]` stripped and A-Z lower-cased. A key of min_chars code
    points that min_docs documents hold loses its lines everywhere but in the largest doc_id that
    holds it. A document is a row: repeated rows count each, and all rows with that largest doc_id
    keep the line. A row without doc_id is never the largest; a key that only such rows hold stays.
    A null or empty text is one empty line, and an empty text comes out. An empty table gives no rows.

    The documents are loaded into runs (see LineRuns) in so many batches, by the hash of the text. Frequent keys are a written
    table and meet the lines by hash, so both sides of that join are plain exchanges whose large partitions
    Spark splits: a line that a third of the documents hold needs no single task. What is to go
    comes back as one row per document.
    """
    spark = documents.sparkSession
    docs = rows_as(documents)
    hashes = line_hashes(docs.select("doc.doc_id", "doc.text"), min_chars)
    base = batched(hashes, batches)
    runs = LineRuns(spark, rows=base.count())
    for k in range(batches):
        runs.load(base.where(F.col("batch") == k).drop("batch"))
    often = written(runs.counts(min_docs), "frequent-lines")
    runs.close()
    removed(base)
    gone = hashes.join(often, ["h1", "h2"]).where(F.col("last").isNotNull() & ~F.col("doc_id").eqNullSafe(F.col("last")))
    gone = gone.groupBy(F.col("doc_id").alias("its_id"), F.col("row").alias("its_row")).agg(F.collect_set(F.struct("h1", "h2")).alias("gone"))
    joined = docs.join(gone, F.col("doc.doc_id").eqNullSafe(F.col("its_id")) & (F.xxhash64("doc.text") == F.col("its_row")), "left")
    lines = _lines("doc.text")
    kept = F.when(F.col("gone").isNull(), lines).otherwise(
        F.filter(lines, lambda x: ~((F.length(line_key(x)) >= min_chars) & F.array_contains(F.col("gone"), _hash(line_key(x))))))
    return joined.withColumn("kept", kept).select(
        "doc", F.array_join("kept", "\n").alias("new_text"),
        F.size(lines).cast("long").alias("n_lines"), (F.size(lines) - F.size("kept")).cast("long").alias("n_dropped"))
