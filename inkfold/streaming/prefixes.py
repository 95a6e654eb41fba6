"""Text that arrives in pieces: every prefix in a batch, or the prefix so far in a stream."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..kernels.html import to_html
from ..kernels.model import Options


def prefixes(pieces: DataFrame, key: str, order: str, column: str, joiner: str = "") -> DataFrame:
    """pieces with prefix: all its key's texts up to and with its own, in order."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return pieces.withColumn("prefix", F.concat_ws(joiner, F.collect_list(column).over(w)))


class _Prefix(StatefulProcessor):
    def __init__(self, ttl_ms: int | None) -> None:
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.prefix = handle.getValueState("prefix", "text string", ttlDurationMs=self.ttl_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        text = self.prefix.get()[0] if self.prefix.exists() else ""
        parts = pd.concat(list(rows)).sort_values("ord")
        text += "".join(parts["piece"].fillna(""))
        self.prefix.update((text,))
        yield pd.DataFrame({"id": [key[0]], "prefix": [text], "html": [to_html(text, Options(streaming=True))]})

    def close(self) -> None:
        pass


def live_html(stream: DataFrame, ttl_ms: int | None = None) -> DataFrame:
    """A stream (id long, ord long, piece string) -> (id, prefix, html) after each micro-batch.

    The state is one text for each id. With ttl_ms it goes so long after its last piece, so that it does not grow
    for ever; Spark then wakes by the clock, and an availableNow trigger does not end. Needs the RocksDB state store.
    """
    return stream.groupBy("id").transformWithStateInPandas(statefulProcessor=_Prefix(ttl_ms), outputStructType="id long, prefix string, html string", outputMode="Update", timeMode="ProcessingTime" if ttl_ms else "None")
