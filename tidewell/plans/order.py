"""Encounter order: which hidden columns tell it, and how rows are numbered by it."""

from __future__ import annotations

import re
import tempfile
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..errors import IllegalStateException

#: Plans whose estimated size is below this are numbered in one task; larger ones by ranges. Of plans that may
#: make more of their input than Catalyst's estimate tells, the input has to be below the second.
ONE_TASK_BYTES, ONE_TASK_UNKNOWN = 64 << 20, 1 << 20
GROWS = re.compile(r"\b(Generate|Expand|MapInArrow|MapInPandas|FlatMapGroups\w*|FlatMapCoGroups\w*|ArrowEvalPython|Join|UnionLoop)\b")

#: What a range of rows should hold.
RANGE_BYTES = 128 << 20


@dataclass(frozen=True)
class Key:
    """A column that rows are ordered by."""

    name: str
    desc: bool = False
    nulls_first: bool | None = None

    def column(self) -> Column:
        c = F.col(self.name)
        first = (not self.desc) if self.nulls_first is None else self.nulls_first
        if self.desc:
            return c.desc_nulls_first() if first else c.desc_nulls_last()
        return c.asc_nulls_first() if first else c.asc_nulls_last()

    def flipped(self) -> Key:
        first = (not self.desc) if self.nulls_first is None else self.nulls_first
        return replace(self, desc=not self.desc, nulls_first=not first)


def sort_columns(order: list[Key]) -> list[Column]:
    return [k.column() for k in order]


def estimated_bytes(df: DataFrame) -> int:
    """Catalyst's estimate for the plan; no job runs."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def needs_ranges(df: DataFrame) -> bool:
    """Whether the rows may be too many for one task."""
    size = estimated_bytes(df)
    return size > ONE_TASK_BYTES or (size > ONE_TASK_UNKNOWN and bool(GROWS.search(df._jdf.queryExecution().optimizedPlan().toString())))


def range_count(df: DataFrame) -> int:
    """Ranges to deal rows out to: the session's shuffle partitions, and more where the plan's estimate asks for it (10,000 at most)."""
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(10_000, estimated_bytes(df) // RANGE_BYTES))


def local(spark: SparkSession) -> bool:
    return spark.sparkContext.master.split("[")[0] == "local"


def checkpointed(df: DataFrame) -> DataFrame:
    """A reliable checkpoint in spark.checkpoint.dir; in a temporary folder where that is unset and all tasks run in this process."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        shared = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not shared and not local(df.sparkSession):
            raise IllegalStateException("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(shared or tempfile.mkdtemp(prefix="tidewell-checkpoint-"))
    return df.checkpoint()


def numbered(df: DataFrame, order: list[Key], name: str, by_ranges: bool | None = None) -> DataFrame:
    """Adds the dense place of each row in the order, from 0.

    Small plans: a window in one task. Others: rows are dealt out by ranges of the order, numbered
    within their ranges, and each range starts where the ones before it end; the ranges' sizes are the
    only thing that meets in one task. The dealt rows are checkpointed, so both passes see the same.
    """
    if not (needs_ranges(df) if by_ranges is None else by_ranges):
        return df.withColumn(name, (F.row_number().over(Window.orderBy(*sort_columns(order))) - 1).cast("long"))
    parts = range_count(df)
    dealt = checkpointed(df.repartitionByRange(parts, *sort_columns(order)).sortWithinPartitions(*sort_columns(order)).withColumn("_at", F.monotonically_increasing_id()))
    dealt = dealt.withColumn("_range", F.shiftright("_at", 33)).withColumn("_in_range", F.col("_at").bitwiseAND((1 << 33) - 1))
    sizes = dealt.groupBy("_range").agg(F.count("*").alias("_n"))
    starts = sizes.select("_range", F.coalesce(F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_start"))
    return dealt.join(F.broadcast(starts), "_range").withColumn(name, F.col("_start") + F.col("_in_range")).drop("_range", "_in_range", "_at", "_start")
