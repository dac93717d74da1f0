"""Maps: tables (key, value) with unique keys."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ...errors import NullPointerException, UnsupportedOperationException
from ...functions.hashes import map_hash, plain_hash
from ..seq import col, true
from .handle import Handle


def _both(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of either: key, old and new value, and whether each is there."""
    one = a.select("key", F.col("value").alias("old"), F.lit(True).alias("had"))
    two = b.select("key", F.col("value").alias("new"), F.lit(True).alias("has"))
    return one.join(two, "key", "full_outer").withColumns({"had": F.coalesce("had", F.lit(False)), "has": F.coalesce("has", F.lit(False))})


def put_all(a: DataFrame, b: DataFrame) -> DataFrame:
    """b wins."""
    return _both(a, b).select("key", F.when(F.col("has"), F.col("new")).otherwise(F.col("old")).alias("value"))


def put_if_absent(a: DataFrame, b: DataFrame) -> DataFrame:
    """a wins."""
    return _both(a, b).select("key", F.when(F.col("had"), F.col("old")).otherwise(F.col("new")).alias("value"))


def remove_keys(a: DataFrame, keys: DataFrame) -> DataFrame:
    return a.join(keys.select("key"), "key", "left_anti")


def remove_entries(a: DataFrame, entries: DataFrame) -> DataFrame:
    """Only where the value is equal, too."""
    return a.join(entries.select("key", "value"), ["key", "value"], "left_anti")


def compute_if_absent(a: DataFrame, keys: DataFrame, value) -> DataFrame:
    """value (of key) for keys that aren't there; null results aren't put."""
    absent = keys.select("key").distinct().join(a.select("key"), "key", "left_anti").select("key", col(value).alias("value")).where("value IS NOT NULL")
    return a.select("key", "value").unionByName(absent)


def compute_if_present(a: DataFrame, keys: DataFrame, value) -> DataFrame:
    """value (of key and value) for keys that are there; null results delete."""
    asked = keys.select("key", F.lit(True).alias("_asked")).distinct()
    new = a.join(asked, "key", "left").withColumn("_new", F.when(F.col("_asked"), col(value)).otherwise(F.col("value")))
    return new.where(F.col("_asked").isNull() | F.col("_new").isNotNull()).select("key", F.col("_new").alias("value"))


def compute(a: DataFrame, keys: DataFrame, value) -> DataFrame:
    """value (of key and value, null where absent) for all asked keys; null results delete or aren't put."""
    asked = keys.select("key", F.lit(True).alias("_asked")).distinct()
    both = a.select("key", "value").join(asked, "key", "full_outer").withColumn("_new", F.when(F.col("_asked"), col(value)).otherwise(F.col("value")))
    return both.where(F.col("_asked").isNull() | F.col("_new").isNotNull()).select("key", F.col("_new").alias("value"))


def merge(a: DataFrame, b: DataFrame, function: Callable[[Column, Column], Column]) -> DataFrame:
    """function(old, new) where both have the key, else the one there is; null results delete."""
    merged = F.when(F.col("had") & F.col("has"), function(F.col("old"), F.col("new"))).otherwise(F.coalesce("old", "new"))
    return _both(a, b).select("key", merged.alias("value")).where("value IS NOT NULL")


def replace(a: DataFrame, b: DataFrame, expected: str | None = None) -> DataFrame:
    """b's values for keys that are there; with `expected`, a column of b, only where the old value equals it."""
    new = b.select("key", F.col("value").alias("_new"), F.lit(True).alias("_has"), *([F.col(expected).alias("_expected")] if expected else []))
    hit = F.col("_has") & (F.col("value").eqNullSafe(F.col("_expected")) if expected else F.lit(True))
    return a.join(new, "key", "left").select("key", F.when(F.coalesce(hit, F.lit(False)), F.col("_new")).otherwise(F.col("value")).alias("value"))


def lookup(probes: DataFrame, a: DataFrame, default=None) -> DataFrame:
    """Adds the value of each probe's key; null, or the default, where there is none."""
    found = probes.join(a.select("key", F.col("value").alias("_found"), F.lit(True).alias("_has")), "key", "left")
    value = F.col("_found") if default is None else F.when(F.col("_has"), F.col("_found")).otherwise(F.lit(default))
    return found.withColumn("found", value).drop("_found", "_has")


def equal(a: DataFrame, b: DataFrame) -> DataFrame:
    both = _both(a, b)
    return both.agg((F.count_if(~F.col("had") | ~F.col("has") | ~F.col("old").eqNullSafe(F.col("new"))) == 0).alias("result"))


@dataclass
class Entry:
    """A mapping taken out of a map; set_value() changes this copy only."""

    key: Any
    value: Any

    def get_key(self):
        return self.key

    def get_value(self):
        return self.value

    def set_value(self, value):
        old, self.value = self.value, value
        return old

    def equals(self, other: Entry) -> bool:
        return self == other

    def hash_code(self) -> int:
        h = plain_hash(self.key) ^ plain_hash(self.value)
        return h - (1 << 32) if h >= 1 << 31 else h

    __hash__ = hash_code


class FrameMap(Handle):
    """Single-key mutators are for small changes; bulk ones take another map."""

    @staticmethod
    def of(spark: SparkSession, entries: dict, schema: str = "key string, value int") -> FrameMap:
        return FrameMap(spark.createDataFrame(list(entries.items()), schema))

    def _one(self, key, value=None) -> DataFrame:
        if key is None:
            raise NullPointerException("null key")
        return self.df.sparkSession.createDataFrame([(key, value)], self.df.select("key", "value").schema)

    def _rows(self) -> DataFrame:
        return self.df.orderBy("key")

    def get(self, key):
        row = self.df.where(F.col("key") == F.lit(key)).select("value").first()
        return None if row is None else row[0]

    def get_or_default(self, key, default):
        return self.get(key) if self.contains_key(key) else default

    def contains_key(self, key) -> bool:
        return not self.df.where(F.col("key") == F.lit(key)).isEmpty()

    def contains_value(self, value) -> bool:
        return not self.df.where(F.col("value") == F.lit(value)).isEmpty()

    def put(self, key, value):
        if value is None:
            raise NullPointerException("null value")
        old = self.get(key)
        self._set(put_all(self.df, self._one(key, value)))
        return old

    def put_if_absent(self, key, value):
        old = self.get(key)
        if old is None:
            self._set(put_if_absent(self.df, self._one(key, value)))
        return old

    def put_all(self, other: FrameMap) -> None:
        self._set(put_all(self.df, other.df))

    def remove(self, key, value=None):
        old = self.get(key)
        if old is None or (value is not None and old != value):
            return None if value is None else False
        self._set(self.df.where(F.col("key") != F.lit(key)))
        return old if value is None else True

    def compute_if_absent(self, key, value):
        if not self.contains_key(key):
            self._set(compute_if_absent(self.df, self._one(key), value))
        return self.get(key)

    def compute_if_present(self, key, value):
        if self.contains_key(key):
            self._set(compute_if_present(self.df, self._one(key), value))
        return self.get(key)

    def compute(self, key, value):
        self._set(compute(self.df, self._one(key), value))
        return self.get(key)

    def merge(self, key, value, function):
        self._set(merge(self.df, self._one(key, value), function))
        return self.get(key)

    def replace(self, key, value, expected=None):
        old = self.get(key)
        if old is None or (expected is not None and old != expected):
            return None if expected is None else False
        self._set(replace(self.df, self._one(key, value)))
        return old if expected is None else True

    def replace_all(self, value) -> None:
        self._set(self.df.select("key", col(value).alias("value")))

    def equals(self, other: FrameMap) -> bool:
        return equal(self.df, other.df).first()[0]

    def hash_code(self) -> int:
        return map_hash(self.df).first()[0]

    def entries(self) -> Iterator[Entry]:
        """The mappings in the order of their keys, as copies."""
        for row in self.iterator():
            yield Entry(row["key"], row["value"])

    def key_set(self) -> MapView:
        return MapView(self, "key")

    def values(self) -> MapView:
        return MapView(self, "value")

    def entry_set(self) -> MapView:
        return MapView(self, "key", "value")


class MapView(Handle):
    """Keys, values or entries of a map as they are now; removals go to the map, additions are refused."""

    def __init__(self, backing: FrameMap, *columns: str):
        self._backing, self._columns, self._frozen = backing, columns, False

    @property
    def df(self) -> DataFrame:
        return self._backing.df.select(*self._columns)

    @property
    def version(self) -> int:
        return self._backing.version

    def contains(self, *values) -> bool:
        return not self.df.where([F.col(c) == F.lit(v) for c, v in zip(self._columns, values)][0] if len(values) == 1 else (F.col("key") == F.lit(values[0])) & (F.col("value") == F.lit(values[1]))).isEmpty()

    def add(self, *values):
        raise UnsupportedOperationException("a view of a map takes no additions")

    def remove(self, *values) -> bool:
        """A key, the first mapping with a value, or an entry."""
        if self._columns == ("key",):
            return self._backing.remove(values[0]) is not None
        if len(values) == 2:
            return bool(self._backing.remove(*values))
        row = self._backing.df.where(F.col("value") == F.lit(values[0])).orderBy("key").first()
        return row is not None and self._backing.remove(row["key"]) is not None

    def remove_if(self, condition) -> None:
        self._backing._set(self._backing.df.where(~true(condition)))

    def clear(self) -> None:
        self._backing.clear()
