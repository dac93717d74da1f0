"""Lists: rows with a dense place `pos` from 0 and a `value`."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ...errors import IndexOutOfBoundsException, NoSuchElementException, UnsupportedOperationException
from ...functions.comparators import Comparator, natural_order
from ...functions.hashes import list_hash
from ...plans.order import Key, numbered
from ..seq import Seq, col, true
from .handle import Handle


def add_all(a: DataFrame, b: DataFrame) -> DataFrame:
    """a, then b behind it."""
    size = a.agg(F.count("*").alias("n")).scalar()
    return a.select("pos", "value").unionByName(b.select((F.col("pos") + size).alias("pos"), "value"))


def renumbered(df: DataFrame) -> DataFrame:
    return numbered(df.withColumnRenamed("pos", "_old"), [Key("_old")], "pos").select("pos", "value")


def retain_all(a: DataFrame, b: DataFrame) -> DataFrame:
    """What of a is in b; repeated values stay repeated."""
    return renumbered(a.join(b.select("value").distinct(), "value", "left_semi"))


def remove_all(a: DataFrame, b: DataFrame) -> DataFrame:
    return renumbered(a.join(b.select("value").distinct(), "value", "left_anti"))


def index_of(a: DataFrame, value) -> DataFrame:
    """One row: the first place of the value, -1 if it isn't there."""
    return a.where(F.col("value") == F.lit(value)).agg(F.coalesce(F.min("pos"), F.lit(-1).cast("long")).alias("result"))


def last_index_of(a: DataFrame, value) -> DataFrame:
    return a.where(F.col("value") == F.lit(value)).agg(F.coalesce(F.max("pos"), F.lit(-1).cast("long")).alias("result"))


def remove_at(a: DataFrame, place: int | Column) -> DataFrame:
    place = place if isinstance(place, Column) else F.lit(place)
    return a.where(F.coalesce(F.col("pos") != place, F.lit(True))).select((F.col("pos") - F.coalesce((F.col("pos") > place).cast("long"), F.lit(0))).alias("pos"), "value")


def remove_first(a: DataFrame, value, last: bool = False) -> DataFrame:
    """Without the first (or last) row that has the value."""
    where = a.where(F.col("value") == F.lit(value)).agg((F.max if last else F.min)("pos").alias("p")).scalar()
    return remove_at(a, where)


def insert_at(a: DataFrame, place: int, value) -> DataFrame:
    new = a.sparkSession.range(1).select(F.lit(place).cast("long").alias("pos"), F.lit(value).cast(a.schema["value"].dataType).alias("value"))
    return a.select((F.col("pos") + (F.col("pos") >= place).cast("long")).alias("pos"), "value").unionByName(new)


def set_at(a: DataFrame, place: int, value) -> DataFrame:
    return a.withColumn("value", F.when(F.col("pos") == place, F.lit(value)).otherwise(F.col("value")))


def sub_list(a: DataFrame, start: int, end: int) -> DataFrame:
    return a.where((F.col("pos") >= start) & (F.col("pos") < end)).select((F.col("pos") - start).alias("pos"), "value")


def reversed_list(a: DataFrame) -> DataFrame:
    size = a.agg(F.count("*").alias("n")).scalar()
    return a.select((size - 1 - F.col("pos")).alias("pos"), "value")


def sorted_list(a: DataFrame, by: Comparator | None = None) -> DataFrame:
    """Stable."""
    by = by or natural_order("value")
    keys = {f"_k{i}": p.expr for i, p in enumerate(by.parts)}
    order = [Key(f"_k{i}", p.desc, p.nulls_first) for i, p in enumerate(by.parts)] + [Key("_old")]
    return numbered(a.withColumnRenamed("pos", "_old").withColumns(keys), order, "pos").select("pos", "value")


def equal(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: the same values at the same places."""
    both = a.select("pos", F.col("value").alias("_a"), F.lit(1).alias("_ha")).join(b.select("pos", F.col("value").alias("_b"), F.lit(1).alias("_hb")), "pos", "full_outer")
    return both.agg((F.count_if(F.col("_ha").isNull() | F.col("_hb").isNull() | ~F.col("_a").eqNullSafe(F.col("_b"))) == 0).alias("result"))


class FrameList(Handle):
    @classmethod
    def of(cls, spark: SparkSession, *values, schema: str = "int") -> FrameList:
        return cls(spark.createDataFrame(list(enumerate(values)), f"pos long, value {schema}"))

    @classmethod
    def from_seq(cls, seq: Seq, value: str = "value") -> FrameList:
        return cls(seq.with_position("pos").select("pos", F.col(value).alias("value")))

    def stream(self) -> Seq:
        return Seq(self.df, ["pos"])

    def _rows(self) -> DataFrame:
        return self.df.orderBy("pos").select("value")

    def to_list(self) -> list:
        return [r[0] for r in self._rows().collect()]

    def _check(self, place: int, size: int) -> None:
        if not 0 <= place < size:
            raise IndexOutOfBoundsException(f"index {place}, size {size}")

    def get(self, place: int):
        row = self.df.where(F.col("pos") == place).select("value").first()
        if row is None:
            self._check(place, self.size())
        return row[0]

    def set(self, place: int, value):
        old = self.get(place)
        self._set(set_at(self.df, place, value))
        return old

    def add(self, value, place: int | None = None) -> None:
        size = self.size()
        place = size if place is None else place
        self._check(place, size + 1)
        self._set(insert_at(self.df, place, value))

    add_last = add

    def add_first(self, value) -> None:
        self.add(value, 0)

    def add_all(self, other: FrameList) -> None:
        self._set(add_all(self.df, other.df))

    def remove_at(self, place: int):
        old = self.get(place)
        self._set(remove_at(self.df, place))
        return old

    def remove(self, value) -> bool:
        there = self.index_of(value) >= 0
        if there:
            self._set(remove_first(self.df, value))
        return there

    def retain_all(self, other: Handle) -> None:
        self._set(retain_all(self.df, other.df))

    def remove_all(self, other: Handle) -> None:
        self._set(remove_all(self.df, other.df))

    def remove_if(self, condition) -> None:
        self._set(renumbered(self.df.where(~true(condition))))

    def index_of(self, value) -> int:
        return index_of(self.df, value).first()[0]

    def last_index_of(self, value) -> int:
        return last_index_of(self.df, value).first()[0]

    def contains(self, value) -> bool:
        return self.index_of(value) >= 0

    def sort(self, by: Comparator | None = None) -> None:
        self._set(sorted_list(self.df, by))

    def replace_all(self, value) -> None:
        self._set(self.df.withColumn("value", col(value)))

    def get_first(self):
        row = self.df.orderBy("pos").select("value").first()
        if row is None:
            raise NoSuchElementException("the list is empty")
        return row[0]

    def get_last(self):
        row = self.df.orderBy(F.desc("pos")).select("value").first()
        if row is None:
            raise NoSuchElementException("the list is empty")
        return row[0]

    def remove_first(self):
        value = self.get_first()
        self._set(remove_at(self.df, 0))
        return value

    def remove_last(self):
        value = self.get_last()
        self._set(remove_at(self.df, self.size() - 1))
        return value

    def equals(self, other: FrameList) -> bool:
        return equal(self.df, other.df).first()[0]

    def hash_code(self) -> int:
        return list_hash(self.df).first()[0]

    def sub_list(self, start: int, end: int) -> ListView:
        if not 0 <= start <= end <= self.size():
            raise IndexOutOfBoundsException(f"[{start}, {end})")
        return ListView(self, lambda df: sub_list(df, start, end), lambda i: i + start)

    def reversed(self) -> ListView:
        return ListView(self, reversed_list, lambda i: self.size() - 1 - i)

    def list_iterator(self, place: int = 0) -> ListCursor:
        return ListCursor(self, place)


class ListView(FrameList):
    """A window on a list; reads follow it, set() writes through."""

    def __init__(self, backing: FrameList, derive, place):
        self._backing, self._derive, self._place, self._frozen = backing, derive, place, False

    @property
    def df(self) -> DataFrame:
        return self._derive(self._backing.df)

    @property
    def version(self) -> int:
        return self._backing.version

    def set(self, place: int, value):
        self._check(place, self.size())
        return self._backing.set(self._place(place), value)

    def _set(self, df: DataFrame) -> None:
        raise UnsupportedOperationException("structural changes go to the backing list")


class ListCursor:
    """Moves both ways over a list; add, set and remove act where it stands."""

    def __init__(self, backing: FrameList, place: int):
        self._list, self._next, self._last = backing, place, None

    def has_next(self) -> bool:
        return self._next < self._list.size()

    def has_previous(self) -> bool:
        return self._next > 0

    def next(self):
        if not self.has_next():
            raise NoSuchElementException("no next element")
        self._last, self._next = self._next, self._next + 1
        return self._list.get(self._last)

    def previous(self):
        if not self.has_previous():
            raise NoSuchElementException("no previous element")
        self._next -= 1
        self._last = self._next
        return self._list.get(self._last)

    def set(self, value) -> None:
        self._list.set(self._last, value)

    def remove(self) -> None:
        self._list.remove_at(self._last)
        self._next -= self._last < self._next
        self._last = None

    def add(self, value) -> None:
        self._list.add(value, self._next)
        self._next += 1
        self._last = None
