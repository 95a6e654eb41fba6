"""A corpus pipeline: each stage's rows are written as Parquet and read again as the next one's documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkfold.llm import decontam, language_id, line_dedup, ngram_join, packing
from inkfold.llm.common import written

#: None: learnt language profiles can't be said in SQL; tests/llm compares with a brute-force version.
ORACLE_SQL = None


#: Rows that go to a Python worker at once; Spark's 10,000 whole documents would be most of a worker's memory.
ARROW_ROWS = 1000


def _lean(spark: SparkSession) -> None:
    """Smaller Arrow batches for this session, unless it has smaller ones already."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    spark.conf.set(key, min(ARROW_ROWS, int(spark.conf.get(key))))


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language go (operator 6)."""
    _lean(spark)
    return language_id.keep_identified(docs)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Frequent lines go but for one document's (operator 8); a text that had lines taken is counted again, and one that is left without any goes."""
    out = line_dedup.dedup_lines(docs)
    changed = F.col("n_dropped") > 0
    out = out.where(~changed | (F.btrim("new_text") != ""))
    new = {"text": F.col("new_text"), "n_chars": F.length("new_text").cast("long")}
    return out.select(*[F.when(changed, new[c]).otherwise(own).alias(c) if c in new else own.alias(c) for c in docs.columns for own in (F.col(f"doc.`{c}`"),)])


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that shares four fifths of its five-word shingles stays (operator 3)."""
    _lean(spark)
    return ngram_join.keep_one(docs, words=5, percent=80)


def drop_benchmark_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold passages of the benchmark go (operator 10)."""
    return decontam.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack_batches(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every token left, in batches of length buckets (operator 1)."""
    return packing.pack(docs)


STAGES = [
    ("language", identify_language),
    ("lines", drop_repeated_lines),
    ("near copies", drop_near_copies),
    ("benchmark", drop_benchmark_copies),
    ("packing", pack_batches),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = written(docs, f"stage-{k}")
    return docs
