"""Sets and multiset algebra."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ...functions.hashes import set_hash
from ..seq import Seq, true
from .handle import Handle


def union(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.union(b).distinct()


def intersect(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.intersect(b)


def subtract(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.subtract(b)


def contains_all(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: whether every value of b is in a."""
    missing = b.join(a.distinct(), b.columns, "left_anti")
    return missing.agg((F.count("*") == 0).alias("result"))


def equal(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: whether both have the same values, whatever the order."""
    one, two = a.distinct().withColumn("_a", F.lit(1)), b.distinct().withColumn("_b", F.lit(1))
    both = one.join(two, a.columns, "full_outer")
    return both.agg((F.count_if(F.col("_a").isNull() | F.col("_b").isNull()) == 0).alias("result"))


class FrameSet(Handle):
    """Distinct values in a column named value."""

    @staticmethod
    def of(spark: SparkSession, *values, schema: str = "value int") -> FrameSet:
        return FrameSet(spark.createDataFrame([(v,) for v in values], schema).distinct())

    def stream(self) -> Seq:
        return Seq(self.df, ["value"])

    def _rows(self) -> DataFrame:
        return self.df.orderBy("value")

    def contains(self, value) -> bool:
        return not self.df.where(F.col("value") == F.lit(value)).isEmpty()

    def add(self, value) -> bool:
        new = not self.contains(value)
        if new:
            self._set(self.df.unionByName(self.df.sparkSession.createDataFrame([(value,)], self.df.schema)))
        return new

    def remove(self, value) -> bool:
        had = self.contains(value)
        if had:
            self._set(self.df.where(F.col("value") != F.lit(value)))
        return had

    def add_all(self, other: FrameSet) -> None:
        self._set(union(self.df, other.df))

    def retain_all(self, other: FrameSet) -> None:
        self._set(intersect(self.df, other.df))

    def remove_all(self, other: FrameSet) -> None:
        self._set(subtract(self.df, other.df))

    def remove_if(self, condition) -> None:
        self._set(self.df.where(~true(condition)))

    def hash_code(self) -> int:
        return set_hash(self.df).first()[0]

    def equals(self, other: FrameSet) -> bool:
        return equal(self.df, other.df).first()[0]
