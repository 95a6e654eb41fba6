"""What the operators of this package share: written tables, word hashes, folds."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: White space of every contract here: space and \x09-\x0D.
ASCII_SPACE = " \t\n\x0b\x0c\r"
#: Rows of a narrow table up to which it is broadcast, after they are counted.
BROADCAST_ROWS = 1_000_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share. Where the session names none, one of our own on a single machine (tests), an error on a cluster."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.conf.get("spark.master", "")):
            raise RuntimeError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="inkfold-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def folder(spark: SparkSession, name: str) -> str:
    """A new folder's path in the shared folder."""
    return f"{shared_dir(spark)}/inkfold/{name}-{uuid.uuid4().hex}"


def narrow(df: DataFrame) -> DataFrame:
    """df without a shuffle in no more partitions than half of what a scan of the tables it comes from would have (twice
    spark.sql.files.maxPartitionBytes each), or one a core if that is more: a table of many tiny files costs more to write and list than its
    rows, and bytes a task stay bounded."""
    session, leaves = df.sparkSession._jsparkSession.sessionState(), df._jdf.queryExecution().optimizedPlan().collectLeaves()
    size = sum(leaves.apply(k).stats().sizeInBytes() for k in range(leaves.size()))
    most = max(df.sparkSession.sparkContext.defaultParallelism, -(-size // (2 * session.conf().filesMaxPartitionBytes())))
    return df.coalesce(most) if most < 1 << 20 else df


def written(df: DataFrame, name: str, narrowed: bool = True) -> DataFrame:
    """df written as Parquet in the shared folder and read again: cuts lineage and outlives lost executors."""
    spark = df.sparkSession
    path = folder(spark, name)
    (narrow(df) if narrowed else df).write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_at = path
    return out


def removed(*tables: DataFrame) -> None:
    """Deletes written tables that no later table needs."""
    for df in tables:
        spark, path = df.sparkSession, df.written_at
        found = spark._jvm.org.apache.hadoop.fs.Path(path)
        found.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(found, True)


def small(df: DataFrame, name: str, most: int | None = None) -> DataFrame:
    """df as a written table that is broadcast to what it is joined with, if it has no more than so many rows (of some 40 bytes); beyond, the join shuffles."""
    out = written(df, name)
    return F.broadcast(out) if out.count() <= (BROADCAST_ROWS if most is None else most) else out


def parts_for(table: DataFrame, rows: int) -> int:
    """Partitions for a sort of a written table: Spark's number of them, or more if that would give each over so many rows."""
    return max(int(table.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-table.count() // rows))


def rows_as(df: DataFrame, name: str = "doc") -> DataFrame:
    """One column, a struct of df's own, so that no name of theirs can clash with another."""
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias(name))


def before(counts: DataFrame, key: list[str], block: str, rows: str = "rows", wide: int = 1000) -> DataFrame:
    """counts with `before`: the sum of rows of the key's lower blocks.

    Two levels, so that a key's blocks are not all in one task: the sums of every `wide` blocks first.
    """
    tall = counts.withColumn("_tall", F.floor(F.col(block) / wide))
    sums = tall.groupBy(*key, "_tall").agg(F.sum(rows).alias("_sum"))
    lower = sums.withColumn("_lower", F.sum("_sum").over(Window.partitionBy(*key).orderBy("_tall")) - F.col("_sum")).drop("_sum")
    inner = tall.withColumn("_inner", F.sum(rows).over(Window.partitionBy(*key, "_tall").orderBy(block)) - F.col(rows))
    return inner.join(lower, [*key, "_tall"]).withColumn("before", F.col("_lower") + F.col("_inner")).drop("_tall", "_lower", "_inner")


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def held_out(doc_id: Column) -> Column:
    """True where crc32 of the id as text leaves 2 when divided by 4."""
    return F.coalesce(F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % 4 == 2, F.lit(False))


def utf8(column: pa.Array) -> list[bytes | None]:
    """The UTF-8 bytes of a string column, without decoding."""
    return column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()


class WordHashes(dict):
    """64-bit hashes by word; forgets all when it holds too many, so its memory is bounded."""

    LIMIT = 150_000

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.LIMIT:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


_MIX = np.uint64(0x9E3779B97F4A7C15)


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def windows(h: np.ndarray, k: int) -> np.ndarray:
    """The hash of each window of k values, in order; empty when there are fewer."""
    n = len(h) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.full(n, k, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(k):
            out = (out ^ h[i : i + n]) * _MIX
            out ^= out >> np.uint64(29)
        return mixed(out)


def batches(rows: Iterator[tuple], schema: pa.Schema, size: int = 2000) -> Iterable[pa.RecordBatch]:
    """Tuples in schema's order as record batches of at most size rows."""
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) == size:
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
