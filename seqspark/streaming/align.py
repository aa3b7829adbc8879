"""Alignment on streams."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from seqspark.functions.align import align


def align_stream(stream: DataFrame, query: str, target: str, **kw) -> DataFrame:
    """A stream with `result`. align() keeps no state, so any output mode will do."""
    return stream.withColumn("result", align(query, target, **kw))


def n_best_stream(stream: DataFrame, key: str, score: str, item: str, n: int) -> DataFrame:
    """For each key the n items of least score so far (ties by item), as
    key, items, scores, after each batch that brings the key rows. The state is
    n pairs a key. Use output mode update."""
    kind = stream.schema[key].dataType.simpleString()

    def run(k, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        held = list(zip(*state.get, strict=True)) if state.exists else []
        for pdf in batches:
            held = sorted([*held, *zip(pdf["s"].tolist(), pdf["i"].tolist(), strict=True)])[:n]
        state.update(([s for s, _ in held], [i for _, i in held]))
        yield pd.DataFrame({key: [k[0]], "items": [[i for _, i in held]], "scores": [[s for s, _ in held]]})

    rows = stream.where(F.col(score) >= 0).select(F.col(key), F.col(score).cast("int").alias("s"), F.col(item).cast("string").alias("i"))
    return rows.groupBy(key).applyInPandasWithState(run, f"{key} {kind}, items array<string>, scores array<int>", "s array<int>, i array<string>", "update", "NoTimeout")


_HELD = StructType([StructField("s", IntegerType()), StructField("i", StringType())])


class _BestOfWindow(StatefulProcessor):
    """List state of n pairs a key and window; a timer at the window's end gives them out and clears it."""

    def __init__(self, n: int):
        self.n = n

    def init(self, handle):
        self.handle = handle
        self.held = handle.getListState("held", _HELD)

    def handleInputRows(self, key, rows, timerValues):
        had = [(r[0], r[1]) for r in self.held.get()] if self.held.exists() else []
        best = sorted([*had, *((r["s"], r["i"]) for r in rows)])[: self.n]
        self.held.put(best)
        if not had:
            self.handle.registerTimer(int(key[1].timestamp() * 1000))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        best = [(r[0], r[1]) for r in self.held.get()]
        self.held.clear()
        yield Row(k=key[0], until=key[1], items=[i for _, i in best], scores=[s for s, _ in best])

    def close(self):
        pass


def n_best_window_stream(stream: DataFrame, key: str, time: str, score: str, item: str, n: int, window: str = "1 day", delay: str = "1 hour") -> DataFrame:
    """For each key and window of event time the n items of least score (ties by item), once the
    watermark (latest time less delay) has passed the window's end: key, until, items, scores.

    State is n pairs a key and open window, and is cleared when a window ends; rows that come later
    than the watermark allows are left out. The session needs Spark's RocksDB state store
    (spark.sql.streaming.stateStore.providerClass). Use output mode append. Rows with a null score,
    time or key, or a negative score, are left out."""
    kind = stream.schema[key].dataType.simpleString()
    rows = stream.where((F.col(score) >= 0) & F.col(time).isNotNull() & F.col(key).isNotNull())
    rows = rows.select(F.col(key).alias("k"), F.col(time).cast("timestamp").alias("at"), F.col(score).cast("int").alias("s"), F.col(item).cast("string").alias("i")).withWatermark("at", delay)
    rows = rows.withColumn("until", F.window("at", window)["end"])
    out = rows.groupBy("k", "until").transformWithState(_BestOfWindow(n), f"k {kind}, until timestamp, items array<string>, scores array<int>", "Append", "EventTime")
    return out.withColumnRenamed("k", key)
