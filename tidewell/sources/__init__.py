"""Sources of sequences: literals, frames, ranges, recurrences, suppliers, concatenation."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from itertools import islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..errors import IllegalArgumentException, IllegalStateException
from ..operators.seq import Seq, true
from ..plans.order import Key, numbered

LONG_MAX = 2**63 - 1


def empty(spark: SparkSession, schema: str = "value int") -> Seq:
    return Seq(spark.createDataFrame([], f"_o0 long, {schema}"), [Key("_o0")], 0, 0)


def of_values(spark: SparkSession, values, schema: str = "value int") -> Seq:
    """A literal sequence; rows are tuples, or plain values for one column."""
    rows = [(i, *(v if isinstance(v, tuple) else (v,))) for i, v in enumerate(values)]
    return Seq(spark.createDataFrame(rows, f"_o0 long, {schema}"), [Key("_o0")], len(rows), len(rows))


def of(spark: SparkSession, *values, schema: str = "value int") -> Seq:
    return of_values(spark, values, schema)


def of_frame(df: DataFrame, order_by: str | list[str] | list[Key], size: int | None = None) -> Seq:
    """Any DataFrame in the order of columns that are unique together."""
    return Seq(df, order_by, None, size)


of_range = of_frame


def from_rows(spark: SparkSession, rows: Callable[[], Iterable], schema: str = "value int", size_hint: int | None = None, budget: int | None = None, parallel: bool = False, close: Callable[[], None] | None = None) -> Seq:
    """A source of one's own: rows() gives values or tuples one after the other. It runs in one task, when the rows are
    asked for, and streams in batches; `size_hint`, `budget` and `close` are what the sequence tells or does."""
    declared = T.StructType([T.StructField("_o0", T.LongType()), *spark.createDataFrame([], schema).schema])
    arrow = to_arrow_schema(declared)

    def run(batches):
        if not any(b.num_rows for b in batches):
            return
        numbered_rows = ((n, *(r if isinstance(r, tuple) else (r,))) for n, r in enumerate(rows()))
        while held := list(islice(numbered_rows, 10_000)):
            yield pa.RecordBatch.from_arrays([pa.array(list(v), f.type) for v, f in zip(zip(*held), arrow)], schema=arrow)

    return Seq(spark.range(0, 1, 1, 1).mapInArrow(run, declared), [Key("_o0")], budget, size_hint, parallel, [close] if close else [])


def parquet(spark: SparkSession, path: str, order_by: str | list[str]) -> Seq:
    return of_frame(spark.read.parquet(path), order_by)


def of_nullable(seq: Seq, column: str) -> Seq:
    """Without the rows whose value is null."""
    return seq.filter(F.col(column).isNotNull())


def int_range(spark: SparkSession, start: int, end: int) -> Seq:
    """[start, end); empty if start >= end."""
    n = max(0, end - start)
    return Seq(spark.range(start, max(start, end)).select(F.col("id").alias("value"), F.col("id").alias("_o0")), [Key("_o0")], n, n)


def int_range_closed(spark: SparkSession, start: int, end: int) -> Seq:
    """[start, end], up to the largest long; empty if start > end."""
    if end < LONG_MAX:
        return int_range(spark, start, end + 1)
    n = end - start + 1
    ids = spark.range(0, max(0, n)).select((F.lit(start) + F.col("id")).alias("value"), F.col("id").alias("_o0"))
    return Seq(ids, [Key("_o0")], max(0, n), max(0, n))


class Unbounded:
    """A source without end; it has to be bounded before rows can be made."""

    def __init__(self, make: Callable[[int], Seq], spark: SparkSession):
        self._make, self.spark, self._used = make, spark, False

    def limit(self, n: int) -> Seq:
        if n < 0:
            raise IllegalArgumentException(str(n))
        if self._used:
            raise IllegalStateException("stream has already been operated upon or closed")
        self._used = True
        return self._make(n)

    def take_while(self, condition, most: int | None = None) -> Seq:
        """Grows the source until the condition fails once, or `most` rows have been tried (none: without end)."""
        n = 1024
        while most is None or n <= most:
            if self._make(n).has_match(~true(condition)):
                return self.limit(n).take_while(condition)
            n *= 2
        raise IllegalStateException(f"no row among {most} fails the condition")

    def find_first(self, condition, most: int | None = None) -> DataFrame:
        n = 1024
        while most is None or n <= most:
            if self._make(n).has_match(condition):
                return self.limit(n).filter(condition).find_first()
            n *= 2
        raise IllegalStateException(f"no row among {most} meets the condition")

    def count(self) -> int:
        raise IllegalStateException("the source is unbounded; limit it first")

    to_list = frame = count


def iterate(spark: SparkSession, seed: str, step: str, has_next: str | None = None, kind: str = "bigint") -> Unbounded | Seq:
    """seed, step(seed), ... with `x` as the value in the SQL of step and has_next; bounded if has_next is given.

    A recursive query: each step needs the one before, so rows are made one after the other. Where
    a closed form is known, use generate().
    """

    def rows(where: str, most: int) -> Seq:
        df = spark.sql(f"WITH RECURSIVE t(i, x) MAX RECURSION LEVEL {most + 2} AS (SELECT 0L, CAST({seed} AS {kind}) UNION ALL SELECT i + 1, CAST({step} AS {kind}) FROM t WHERE {where}) SELECT i AS _o0, x AS value FROM t")
        return Seq(df, [Key("_o0")], most, None)

    if has_next is None:
        return Unbounded(lambda n: rows(f"i < {n - 1}", n).limit(n), spark)
    df = spark.sql(f"WITH RECURSIVE t(i, x) MAX RECURSION LEVEL 1000000 AS (SELECT 0L, CAST({seed} AS {kind}) UNION ALL SELECT i + 1, CAST({step} AS {kind}) FROM t WHERE {has_next}) SELECT i AS _o0, x AS value FROM t WHERE {has_next}")
    return Seq(df, [Key("_o0")])


def generate(spark: SparkSession, value: Callable[[Column], Column]) -> Unbounded:
    """value(i) for i = 0, 1, ...; unbounded until limited. As a stream: streaming.generated()."""

    def make(n: int) -> Seq:
        df = spark.range(n).select(value(F.col("id")).alias("value"), F.col("id").alias("_o0"))
        return Seq(df, [Key("_o0")], n, n)

    return Unbounded(make, spark)


def concat(a: Seq, b: Seq) -> Seq:
    """a, then b. Both sets of close handlers are kept; the parallel flag is off."""
    orders = (a._order, b._order)
    width = max(len(o) for o in orders)
    bound = None if a.budget() is None or b.budget() is None else a.budget() + b.budget()
    size = None if a.size_hint() is None or b.size_hint() is None else a.size_hint() + b.size_hint()
    closers = [*a._closers, *b._closers]
    names, sides = a.columns, []
    for branch, (s, order) in enumerate(zip((a, b), orders)):
        df = s._take()
        if any(k.desc for k in order) or width > 1 or len(order) < width:
            df = numbered(df, order, "_place")
            places = [F.col("_place").alias("_o1")]
        else:
            places = [F.col(order[0].name).alias("_o1")]
        sides.append(df.select(*names, F.lit(branch).alias("_o0"), *places))
    return Seq(sides[0].unionByName(sides[1]), [Key("_o0"), Key("_o1")], bound, size, False, closers)


class Builder:
    """Collects values, then builds a sequence, once."""

    def __init__(self, spark: SparkSession, schema: str = "value int"):
        self._spark, self._schema, self._values, self._built = spark, schema, [], False

    def add(self, value) -> Builder:
        if self._built:
            raise IllegalStateException("builder has already been built")
        self._values.append(value)
        return self

    accept = add

    def build(self) -> Seq:
        if self._built:
            raise IllegalStateException("builder has already been built")
        self._built = True
        return of_values(self._spark, self._values, self._schema)
