"""The same vocabulary on unbounded inputs, by Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def generated(spark: SparkSession, value: Callable[[Column], Column], per_second: int = 1000) -> DataFrame:
    """generate() without an end: value(i) for i = 0, 1, ..."""
    rate = spark.readStream.format("rate").option("rowsPerSecond", per_second).load()
    return rate.select(F.col("timestamp"), F.col("value").alias("ord"), value(F.col("value")).alias("value"))


def grouping_by(stream: DataFrame, key: str, time: str, window: str, late: str, **aggregates: Column) -> DataFrame:
    """Grouped aggregates by event-time windows; rows later than `late` are left out."""
    return stream.withWatermark(time, late).groupBy(F.window(time, window), key).agg(*[a.alias(n) for n, a in aggregates.items()])


def window_fixed(stream: DataFrame, key: str, value: str, n: int) -> DataFrame:
    """Windows of n values for each key, sent out as they fill; what is over waits in the key's state."""

    def step(keys: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = list(state.get[0]) if state.exists else []
        for frame in frames:
            held += frame["value"].tolist()
        full = len(held) // n * n
        state.update((held[full:],))
        yield pd.DataFrame({"key": keys[0], "window": [held[i : i + n] for i in range(0, full, n)]}, columns=["key", "window"])

    kind = dict(stream.dtypes)
    rows = stream.select(F.col(key).alias("key"), F.col(value).alias("value"))
    return rows.groupBy("key").applyInPandasWithState(step, f"key {kind[key]}, window array<{kind[value]}>", f"held array<{kind[value]}>", "append", GroupStateTimeout.NoTimeout)


def scan_sum(stream: DataFrame, key: str, value: str) -> DataFrame:
    """Running sums for each key over all batches."""

    def step(keys: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        total = state.get[0] if state.exists else 0
        for frame in frames:
            sums = frame["value"].cumsum() + total
            total = int(sums.iloc[-1]) if len(sums) else total
            yield pd.DataFrame({"key": keys[0], "value": sums})
        state.update((total,))

    kind = dict(stream.dtypes)[key]
    rows = stream.select(F.col(key).alias("key"), F.col(value).cast("long").alias("value"))
    return rows.groupBy("key").applyInPandasWithState(step, f"key {kind}, value long", "total long", "append", GroupStateTimeout.NoTimeout)
