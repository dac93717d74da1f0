"""Gatherers: stateful transforms of a sequence, one row to none or many."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, replace

import pyarrow as pa
from pyspark.sql import Column, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..errors import IllegalArgumentException, UnsupportedOperationException
from ..plans.order import Key, numbered, sort_columns
from .seq import Seq, col

#: Rows of a stretch within which sliding windows and prefix sums are made by one task.
STRETCH = 1 << 16


@dataclass
class Built:
    """A gatherer made of DataFrame operations."""

    apply: Callable[[Seq], Seq]

    def and_then(self, following) -> Built:
        return Built(lambda seq: following.apply(self.apply(seq)))


def _positive(n: int) -> int:
    if n <= 0:
        raise IllegalArgumentException(f"{n} is not positive")
    return n


def window_fixed(n: int, value="value", name: str = "window") -> Built:
    """Windows of n rows one after the other; the last may be shorter."""
    _positive(n)

    def apply(seq: Seq) -> Seq:
        placed = numbered(seq._take(), seq._order, "_p")
        rows = placed.groupBy(F.floor(F.col("_p") / n).alias("_o0")).agg(F.sort_array(F.collect_list(F.struct("_p", col(value).alias("v")))).alias("w"))
        return seq._next(rows.select(F.transform("w", lambda x: x["v"]).alias(name), "_o0"), [Key("_o0")])

    return Built(apply)


def _stretched(seq: Seq, overlap: int):
    """Rows with their places, cut into stretches, longer than the overlap, that also hold the `overlap` rows before them (those are marked)."""
    stretch = max(STRETCH, overlap + 1)
    placed = numbered(seq._take(), seq._order, "_p").withColumn("_s", F.floor(F.col("_p") / stretch))
    own = placed.withColumn("_lead", F.lit(False))
    if not overlap:
        return own
    late = placed.where(F.col("_p") % stretch >= stretch - overlap).withColumn("_s", F.col("_s") + 1).withColumn("_lead", F.lit(True))
    return own.unionByName(late)


def window_sliding(n: int, value="value", name: str = "window") -> Built:
    """Each run of n neighbouring rows; fewer rows than n give none."""
    _positive(n)

    def apply(seq: Seq) -> Seq:
        frame = Window.partitionBy("_s").orderBy("_p").rowsBetween(1 - n, 0)
        rows = _stretched(seq, n - 1).withColumn(name, F.collect_list(col(value)).over(frame))
        return seq._next(rows.where(~F.col("_lead") & (F.size(name) == n)).select(name, F.col("_p").alias("_o0")), [Key("_o0")])

    return Built(apply)


def fold(initial, step: Callable[[Column, Column], Column], value="value", name: str = "value") -> Built:
    """One row: the left fold in encounter order; no rows give the initial value. The values meet in one row; an associative fold is an aggregate: use aggregated()."""
    return Built(lambda seq: seq._next(seq.reduce(value, step, initial).select(F.col("result").alias(name), F.lit(0).alias("_o0")), [Key("_o0")], 1, 1))


def aggregated(initial, merge: Callable[[Column], Column], combine: Callable[[Column, Column], Column], value="value", name: str = "value") -> Built:
    """fold() for a step that is known as an aggregate: partial results in every task."""
    lit = initial if isinstance(initial, Column) else F.lit(initial)

    def apply(seq: Seq) -> Seq:
        got = merge(col(value))
        return seq._next(seq._take().agg(F.when(got.isNull(), lit).otherwise(combine(lit, got)).alias(name)).withColumn("_o0", F.lit(0)), [Key("_o0")], 1, 1)

    return Built(apply)


def scan_sum(initial: int, value="value", name: str = "value", emit_initial: bool = True) -> Built:
    """Running sums, the initial value first: sums within stretches on top of the sums of the stretches before."""

    def apply(seq: Seq) -> Seq:
        spark = seq._df.sparkSession
        rows = _stretched(seq, 0).withColumn("_v", col(value))
        totals = rows.groupBy("_s").agg(F.sum("_v").alias("_t"))
        before = totals.select("_s", F.coalesce(F.sum("_t").over(Window.orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_b"))
        running = F.sum("_v").over(Window.partitionBy("_s").orderBy("_p").rowsBetween(Window.unboundedPreceding, 0))
        out = rows.join(before, "_s").select((F.lit(initial) + F.col("_b") + running).alias(name), (F.col("_p") + 1).alias("_o0"))
        if emit_initial:
            out = spark.range(1).select(F.lit(initial).alias(name), F.col("id").alias("_o0")).unionByName(out)
        return seq._next(out, [Key("_o0")])

    return Built(apply)


def scan(initial, step: Callable[[Column, Column], Column], value="value", name: str = "value") -> Built:
    """Prefixes of any left fold, the initial value first; the values meet in one row."""

    def apply(seq: Seq) -> Seq:
        first = F.array(initial if isinstance(initial, Column) else F.lit(initial))
        df = seq.reduce(value, lambda acc, x: F.array_append(acc, step(F.element_at(acc, -1), x)), first)
        return seq._next(df.select(F.posexplode("result").alias("_o0", name)), [Key("_o0")])

    return Built(apply)


@dataclass
class Gatherer:
    """A gatherer in Python: initializer() -> state; integrator(state, row) -> generator of output rows, whose return value False stops; finisher(state) -> output rows.

    Rows are tuples of the sequence's columns; outputs are values of the schema. An ordered gatherer sees
    the whole sequence, streamed in order through one task in constant memory (what makes the rows runs in
    tasks before that); others run on every partition side by side, and their outputs stand where the row
    stood that was read last, those of a finisher behind all.
    """

    integrator: Callable
    schema: str = "value long"
    initializer: Callable = lambda: None
    finisher: Callable | None = None
    combiner: Callable | None = None
    ordered: bool = True

    def has_combiner(self) -> bool:
        return self.combiner is not None

    def combine(self, a, b):
        if self.combiner is None:
            raise UnsupportedOperationException("the gatherer has no combiner")
        return self.combiner(a, b)

    def run(self, rows: Iterator[tuple]) -> Iterator[tuple]:
        state = self.initializer()
        for row in rows:
            if (yield from self.integrator(state, row)) is False:
                break
        if self.finisher:
            yield from self.finisher(state)

    def and_then(self, following: Gatherer) -> Gatherer:
        """The outputs of this one go into the following one; its stop ends both."""
        both = lambda a, b: (self.combine(a[0], b[0]), following.combine(a[1], b[1]))
        joined = Gatherer(lambda s, r: iter(()), following.schema, combiner=both if self.has_combiner() and following.has_combiner() else None, ordered=self.ordered or following.ordered)
        joined.run = lambda rows: following.run(self.run(rows))
        return joined

    def apply(self, seq: Seq) -> Seq:
        df, order, names = seq._take(), seq._order, seq.columns
        hidden = [] if self.ordered else [k.name for k in order]
        place = f"_o{len(hidden)}"
        declared = T.StructType([*df.sparkSession.createDataFrame([], self.schema).schema, *(T.StructField(n, df.schema[n].dataType) for n in hidden), T.StructField(place, T.LongType())])
        arrow = to_arrow_schema(declared)
        run = self.run

        def stream(batches):
            last = [None] * len(hidden)

            def rows():
                nonlocal last
                for batch in batches:
                    keys = zip(*(batch.column(h).to_pylist() for h in hidden)) if hidden else ((),) * batch.num_rows
                    for row, last in zip(zip(*(batch.column(n).to_pylist() for n in names)), keys):  # noqa: B020
                        yield row
                if finisher:
                    last = [None] * len(hidden)

            held = []
            for n, out in enumerate(run(rows())):
                held.append((*out, *last, n))
                if len(held) == 10_000:
                    yield _batch(held, arrow)
                    held = []
            if held:
                yield _batch(held, arrow)

        finisher = self.finisher is not None
        if self.ordered:
            out = df.repartition(1).sortWithinPartitions(*sort_columns(order)).select(*names).mapInArrow(stream, declared)
            return seq._next(out, [Key(place)])
        last_of_all = [replace(k, nulls_first=False) if finisher else k for k in order]
        return seq._next(df.mapInArrow(stream, declared), [*(replace(k, name=h) for k, h in zip(last_of_all, hidden)), Key(place)])


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(v), f.type) for v, f in zip(zip(*rows), schema)], schema=schema)


def of(integrator: Callable, schema: str) -> Gatherer:
    """A stateless gatherer: integrator(state, row) yields outputs; tasks run side by side."""
    return Gatherer(integrator, schema, ordered=False)


def of_sequential(initializer: Callable, integrator: Callable, schema: str, finisher: Callable | None = None) -> Gatherer:
    return Gatherer(integrator, schema, initializer, finisher)


def map_concurrent(most: int, function: Callable, columns: list[str], schema: str) -> Built:
    """function(row) with at most `most` calls at once in a task; outputs stand where their inputs stood. For calls that wait; what Columns express belongs in map()."""
    _positive(most)

    def apply(seq: Seq) -> Seq:
        df = seq._take().select(*columns, *[k.name for k in seq._order])
        hidden = [k.name for k in seq._order]
        own = df.sparkSession.createDataFrame([], schema).schema
        declared = T.StructType([*own, *(df.schema[h] for h in hidden)])
        arrow = to_arrow_schema(declared)

        def run(batches):
            with ThreadPoolExecutor(most) as pool:
                for batch in batches:
                    rows = list(zip(*(batch.column(c).to_pylist() for c in columns)))
                    if not rows:
                        continue
                    size = max(1, min(64, len(rows) // (4 * most)))  # rows that a thread takes at a time
                    slices = [rows[i : i + size] for i in range(0, len(rows), size)]
                    outs = [out for part in pool.map(lambda rows: [function(r) for r in rows], slices) for out in part]
                    made = [pa.array(list(v), f.type) for v, f in zip(zip(*outs), arrow)]
                    yield pa.RecordBatch.from_arrays([*made, *(batch.column(h).cast(arrow.field(h).type) for h in hidden)], schema=arrow)

        return seq._next(df.mapInArrow(run, declared))

    return Built(apply)
