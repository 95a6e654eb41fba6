"""Reading texts and writing results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_markdown(spark: SparkSession, path: str) -> DataFrame:
    """(path, md): one row for each file under a path."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("md"))


def write_nodes(nodes: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """A node table as Parquet, by type: queries for one type read only its folder. Parse once, then ask this table."""
    nodes.write.mode(mode).partitionBy("type").parquet(path)


def write_texts(texts: DataFrame, column: str, path: str, mode: str = "errorifexists") -> None:
    """Compiled documents as text files, a document a record."""
    texts.select(column).write.mode(mode).option("lineSep", "\n\x1e").text(path)
