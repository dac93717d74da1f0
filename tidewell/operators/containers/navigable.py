"""Ordered maps and sets: ends, nearest keys, ranges, descending views, and nearest-key (as-of) joins."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ...errors import IllegalArgumentException, NoSuchElementException
from ...plans.order import checkpointed, needs_ranges, range_count
from .maps import FrameMap

#: kind -> (backwards, base rows come first among equal keys)
KINDS = {"floor": (False, True), "lower": (False, False), "ceiling": (True, True), "higher": (True, False)}


def nearest(probes: DataFrame, probe_key: str, base: DataFrame, base_key: str, kind: str, name: str = "found", by: list[str] = (), by_ranges: bool | None = None) -> DataFrame:
    """Adds to each probe the nearest key of base: lower (<), floor (<=), ceiling (>=) or higher (>); null where there is none.

    Both sides are sorted together once, and each probe takes the last base key before it. With
    `by`, within equal values of those columns. Without, large inputs are dealt out by ranges of the
    key; each range is then given the last base key of those before it.
    """
    backwards, base_first = KINDS[kind]
    key = probes.schema[probe_key].dataType
    rows = probes.withColumns({"_k": F.col(probe_key), "_base": F.lit(None).cast(key), "_side": F.lit(1)})
    others = base.select(*by, F.col(base_key).cast(key).alias("_k")).distinct().withColumns({"_base": F.col("_k"), "_side": F.lit(0)})
    both = rows.unionByName(others, allowMissingColumns=True)
    sort = [F.desc("_k") if backwards else F.asc("_k"), F.asc("_side") if base_first else F.desc("_side")]
    last = lambda w: F.last("_base", ignorenulls=True).over(w.orderBy(*sort).rowsBetween(Window.unboundedPreceding, 0))
    if by:
        out = both.withColumn(name, last(Window.partitionBy(*by)))
    elif not (needs_ranges(both) if by_ranges is None else by_ranges):
        out = both.withColumn(name, last(Window.partitionBy()))
    else:
        parts = range_count(both)
        dealt = checkpointed(both.repartitionByRange(parts, F.desc("_k") if backwards else F.asc("_k")).withColumn("_range", F.spark_partition_id()))
        ends = dealt.groupBy("_range").agg((F.min if backwards else F.max)("_base").alias("_end"))
        carried = ends.select("_range", F.last("_end", ignorenulls=True).over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)).alias("_carried"))
        out = dealt.join(F.broadcast(carried), "_range").withColumn(name, F.coalesce(last(Window.partitionBy("_range")), "_carried")).drop("_range", "_carried")
    return out.where("_side = 1").drop("_k", "_base", "_side")


@dataclass(frozen=True)
class Fence:
    """A window of keys and the direction in which it is read."""

    low: object = None
    low_in: bool = True
    high: object = None
    high_in: bool = True
    descending: bool = False

    def __post_init__(self):
        if self.low is not None and self.high is not None and self.low > self.high:
            raise IllegalArgumentException("fromKey > toKey")

    def holds(self, key) -> bool:
        above = self.low is None or key > self.low or (self.low_in and key == self.low)
        return above and (self.high is None or key < self.high or (self.high_in and key == self.high))

    def condition(self, key: str = "key") -> Column:
        out = F.lit(True)
        if self.low is not None:
            out = out & ((F.col(key) >= F.lit(self.low)) if self.low_in else (F.col(key) > F.lit(self.low)))
        if self.high is not None:
            out = out & ((F.col(key) <= F.lit(self.high)) if self.high_in else (F.col(key) < F.lit(self.high)))
        return out

    def narrowed(self, low=None, low_in: bool = True, high=None, high_in: bool = True) -> Fence:
        """A window within this one; what would widen it is refused."""
        if low is not None and not (self.holds(low) or (not low_in and low == self.low) or (not low_in and low == self.high and self.high_in)):
            raise IllegalArgumentException("key out of range")
        if high is not None and not (self.holds(high) or (not high_in and high == self.high) or (not high_in and high == self.low and self.low_in)):
            raise IllegalArgumentException("key out of range")
        return Fence(self.low if low is None else low, self.low_in if low is None else low_in, self.high if high is None else high, self.high_in if high is None else high_in, self.descending)

    def turned(self) -> Fence:
        return replace(self, descending=not self.descending)


class NavigableMap(FrameMap):
    """A map in the order of its keys; a range or descending view shares its table."""

    def __init__(self, df: DataFrame | None, fence: Fence = Fence(), backing: NavigableMap | None = None):
        self._fence, self._backing = fence, backing
        if backing is None:
            super().__init__(df)
        else:
            self._frozen = False

    @staticmethod
    def of(spark: SparkSession, entries: dict, schema: str = "key int, value string") -> NavigableMap:
        return NavigableMap(spark.createDataFrame(list(entries.items()), schema))

    @property
    def df(self) -> DataFrame:
        source = self._df if self._backing is None else self._backing.df
        return source.where(self._fence.condition())

    @property
    def version(self) -> int:
        return self._version if self._backing is None else self._backing.version

    @version.setter
    def version(self, n: int) -> None:
        self._version = n

    def _set(self, df: DataFrame) -> None:
        if self._backing is None:
            super()._set(df)
        else:
            outside = self._backing.df.where(~self._fence.condition())
            self._backing._set(outside.select("key", "value").unionByName(df.select("key", "value")))

    def _inside(self, key) -> None:
        if not self._fence.holds(key):
            raise IllegalArgumentException("key out of range")

    def put(self, key, value):
        self._inside(key)
        return super().put(key, value)

    def put_if_absent(self, key, value):
        self._inside(key)
        return super().put_if_absent(key, value)

    def _order(self, backwards: bool = False) -> Column:
        return F.desc("key") if backwards != self._fence.descending else F.asc("key")

    def _rows(self) -> DataFrame:
        return self.df.orderBy(self._order())

    def comparator(self) -> Column:
        return self._order()

    def _edge(self, last: bool):
        return self.df.orderBy(self._order(last)).first()

    def first_key(self):
        if (row := self._edge(False)) is None:
            raise NoSuchElementException("the map is empty")
        return row["key"]

    def last_key(self):
        if (row := self._edge(True)) is None:
            raise NoSuchElementException("the map is empty")
        return row["key"]

    first, last = first_key, last_key

    def first_entry(self):
        return self._edge(False)

    def last_entry(self):
        return self._edge(True)

    def poll_first_entry(self):
        row = self._edge(False)
        if row is not None:
            self.remove(row["key"])
        return row

    def poll_last_entry(self):
        row = self._edge(True)
        if row is not None:
            self.remove(row["key"])
        return row

    def _near(self, key, kind: str):
        backwards, inclusive = KINDS[kind]
        up = backwards != self._fence.descending
        c, k = F.col("key"), F.lit(key)
        condition = (c >= k if inclusive else c > k) if up else (c <= k if inclusive else c < k)
        return self.df.where(condition).orderBy(F.asc("key") if up else F.desc("key")).first()

    def nearest(self, probes: DataFrame, probe_key: str, kind: str, name: str = "found", by_ranges: bool | None = None) -> DataFrame:
        """The nearest key of this view for every row of `probes` at once, in the view's direction and within its window."""
        seen = {"floor": "ceiling", "ceiling": "floor", "lower": "higher", "higher": "lower"}[kind] if self._fence.descending else kind
        return nearest(probes, probe_key, self.df, "key", seen, name, by_ranges=by_ranges)

    def floor_entry(self, key):
        return self._near(key, "floor")

    def lower_entry(self, key):
        return self._near(key, "lower")

    def ceiling_entry(self, key):
        return self._near(key, "ceiling")

    def higher_entry(self, key):
        return self._near(key, "higher")

    def floor_key(self, key):
        return (row := self.floor_entry(key)) and row["key"]

    def lower_key(self, key):
        return (row := self.lower_entry(key)) and row["key"]

    def ceiling_key(self, key):
        return (row := self.ceiling_entry(key)) and row["key"]

    def higher_key(self, key):
        return (row := self.higher_entry(key)) and row["key"]

    floor, lower, ceiling, higher = floor_key, lower_key, ceiling_key, higher_key

    def _view(self, fence: Fence) -> NavigableMap:
        return type(self)(None, fence, self if self._backing is None else self._backing)

    def sub_map(self, start, end, start_in: bool = True, end_in: bool = False) -> NavigableMap:
        low, high = ((end, end_in), (start, start_in)) if self._fence.descending else ((start, start_in), (end, end_in))
        if low[0] > high[0]:
            raise IllegalArgumentException("fromKey > toKey")
        return self._view(self._fence.narrowed(*low, *high))

    def head_map(self, end, inclusive: bool = False) -> NavigableMap:
        return self._view(self._fence.narrowed(low=end, low_in=inclusive) if self._fence.descending else self._fence.narrowed(high=end, high_in=inclusive))

    def tail_map(self, start, inclusive: bool = True) -> NavigableMap:
        return self._view(self._fence.narrowed(high=start, high_in=inclusive) if self._fence.descending else self._fence.narrowed(low=start, low_in=inclusive))

    def descending_map(self) -> NavigableMap:
        return self._view(self._fence.turned())

    sub_set, head_set, tail_set, descending_set, reversed = sub_map, head_map, tail_map, descending_map, descending_map

    def navigable_key_set(self) -> DataFrame:
        return self._rows().select("key")

    def to_sorted_list(self) -> list:
        return [r["key"] for r in self._rows().select("key").collect()]


class NavigableSet(NavigableMap):
    """An ordered set: the keys of an ordered map whose values are all true."""

    @staticmethod
    def of(spark: SparkSession, *keys, schema: str = "int") -> NavigableSet:
        return NavigableSet(spark.createDataFrame([(k, True) for k in dict.fromkeys(keys)], f"key {schema}, value boolean"))

    def add(self, key) -> bool:
        self._inside(key)
        return super().put(key, True) is None

    def contains(self, key) -> bool:
        return self.contains_key(key)
