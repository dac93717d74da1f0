"""Seq: a lazy, single-use, ordered sequence of rows on a DataFrame.

The order is carried by hidden columns and rows are only sorted where an operation observes it.
Conditions and values are Columns or SQL text, so Catalyst sees them all.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import replace
from functools import reduce as fold_left

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..errors import CONSUMED, IllegalArgumentException, IllegalStateException, NoSuchElementException
from ..functions.collectors import Collector, Context, exact_double_sum, expanded
from ..functions.comparators import Comparator, natural_order
from ..plans.order import Key, numbered, sort_columns


def col(c: Column | str) -> Column:
    return F.expr(c) if isinstance(c, str) else c


def true(c: Column | str) -> Column:
    """A condition where null counts as false."""
    return F.coalesce(col(c), F.lit(False))


#: Up to so many rows are found by a top-k rather than by numbering.
TOP_K = 10_000

NUMBERS = ("tinyint", "smallint", "int", "bigint", "float", "double")


class Seq:
    def __init__(self, df: DataFrame, order: list[Key] | list[str] | str, bound: int | None = None, size: int | None = None, parallel: bool = False, closers: list | None = None):
        order = [order] if isinstance(order, str) else order
        self._order = [k if isinstance(k, Key) else Key(k) for k in order]
        hidden = {k.name: f"_o{i}" for i, k in enumerate(self._order)}
        if not all(k.name.startswith("_o") for k in self._order):
            df = df.withColumns({h: F.col(n) for n, h in hidden.items()})
            self._order = [Key(hidden[k.name], k.desc, k.nulls_first) for k in self._order]
        self._df, self._bound, self._size, self._parallel, self._closers, self._used = df, bound, size, parallel, closers if closers is not None else [], False

    # Lifecycle

    def _take(self) -> DataFrame:
        if self._used:
            raise IllegalStateException(CONSUMED)
        self._used = True
        return self._df

    def _next(self, df: DataFrame, order: list[Key] | None = None, bound: int | None = None, size: int | None = None) -> Seq:
        return Seq(df, self._order if order is None else order, bound, size, self._parallel, self._closers)

    @property
    def columns(self) -> list[str]:
        return [c for c in self._df.columns if c not in {k.name for k in self._order}]

    def budget(self) -> int | None:
        """The most rows there can be, as far as the plan tells."""
        return self._bound

    def size_hint(self) -> int | None:
        return self._size

    def is_parallel(self) -> bool:
        return self._parallel

    def parallel(self) -> Seq:
        out = self._next(self._take(), bound=self._bound, size=self._size)
        out._parallel = True
        return out

    def sequential(self) -> Seq:
        out = self._next(self._take(), bound=self._bound, size=self._size)
        out._parallel = False
        return out

    def unordered(self) -> Seq:
        return self._next(self._take(), bound=self._bound, size=self._size)

    def on_close(self, handler: Callable[[], None]) -> Seq:
        out = self._next(self._take(), bound=self._bound, size=self._size)
        out._closers = [*self._closers, handler]
        return out

    def close(self) -> None:
        """Runs the handlers in the order of their registration, each once."""
        self._used = True
        handlers, self._closers = self._closers, []
        for h in handlers:
            h()

    # Rows one by one

    def filter(self, condition) -> Seq:
        return self._next(self._take().where(col(condition)), bound=self._bound)  # a null drops the row anyway; a bare condition reaches the scan

    def map(self, **values) -> Seq:
        hidden = [k.name for k in self._order]
        return self._next(self._take().select(*[col(v).alias(n) for n, v in values.items()], *hidden), bound=self._bound, size=self._size)

    def flat_map(self, array, name: str = "value", keep: list[str] = ()) -> Seq:
        """Each row's array, item by item in order; rows with null or empty arrays give none."""
        n = len(self._order)
        df = self._take().select(*keep, *[k.name for k in self._order], F.posexplode(col(array)).alias(f"_o{n}", name))
        return self._next(df, [*self._order, Key(f"_o{n}")])

    def map_multi(self, *pushes: tuple, name: str = "value") -> Seq:
        """Pushes (condition, value) for each row, in this order."""
        items = F.array(*[F.when(true(c), F.struct(col(v).alias("v"))) for c, v in pushes])
        return self.flat_map(F.transform(F.filter(items, lambda x: x.isNotNull()), lambda x: x["v"]), name)

    def peek(self, **changed) -> Seq:
        """A tap that may change the rows' columns as they pass."""
        return self._next(self._take().withColumns({n: col(v) for n, v in changed.items()}), bound=self._bound, size=self._size)

    def observe(self, name: str, *metrics: Column) -> Seq:
        return self._next(self._take().observe(name, *metrics), bound=self._bound, size=self._size)

    def gather(self, gatherer) -> Seq:
        return gatherer.apply(self)

    # Order and slices

    def place(self) -> Column:
        """A value that compares as the order does (orders by one direction only)."""
        names = [F.col(k.name) for k in self._order]
        return names[0] if len(names) == 1 else F.struct(*names)

    def _descending(self) -> bool:
        return any(k.desc for k in self._order)

    def _uniform(self) -> bool:
        return len({k.desc for k in self._order}) == 1

    def distinct(self, *columns: str) -> Seq:
        """The first row of each distinct value."""
        columns = columns or tuple(self.columns)
        df = self._take()
        if set(columns) == set(self.columns) and len(self._order) == 1:
            key = self._order[0]
            first = F.max if key.desc else F.min
            return self._next(df.groupBy(*columns).agg(first(key.name).alias(key.name)), bound=self._bound)
        first = Window.partitionBy(*columns).orderBy(*sort_columns(self._order))
        return self._next(df.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n"), bound=self._bound)

    def sorted(self, by: Comparator | str | None = None) -> Seq:
        """Stable: equal rows keep their order."""
        df = self._take()
        by = by or self.columns[0]
        parts = by.parts if isinstance(by, Comparator) else natural_order(by).parts
        n = len(self._order)
        added = {f"_o{n + i}": p.expr for i, p in enumerate(parts)}
        keys = [Key(f"_o{n + i}", p.desc, p.nulls_first) for i, p in enumerate(parts)]
        return self._next(df.withColumns(added), [*keys, *self._order], bound=self._bound, size=self._size)

    def reversed(self) -> Seq:
        return self._next(self._take(), [k.flipped() for k in self._order], bound=self._bound, size=self._size)

    def _checked(self, n: int) -> int:
        if n < 0:
            raise IllegalArgumentException(str(n))
        return n

    def limit(self, n: int) -> Seq:
        self._checked(n)
        size = None if self._size is None else min(n, self._size)
        return self._next(self._take().orderBy(*sort_columns(self._order)).limit(n), bound=n if self._bound is None else min(n, self._bound), size=size)

    def skip(self, n: int) -> Seq:
        """Without the first n rows. Few: all rows behind the last of them, which a top-k finds; else by places, numbered by ranges where rows are many."""
        self._checked(n)
        less = lambda x: None if x is None else max(0, x - n)
        df = self._take()
        if n == 0:
            return self._next(df, bound=self._bound, size=self._size)
        if n <= TOP_K and self._uniform():
            first = df.select(*[k.name for k in self._order]).orderBy(*sort_columns(self._order)).limit(n)
            last = first.agg((F.min if self._descending() else F.max)(self._mark()).alias("e"), F.count("*").alias("n"))
            edge = last.select(F.when(F.col("n") == n, F.col("e"))).scalar()
            kept = self._mark() < edge if self._descending() else self._mark() > edge
            return self._next(df.where(kept), bound=less(self._bound), size=less(self._size))
        return self._next(numbered(df, self._order, "_place").where(F.col("_place") >= n).drop("_place"), bound=less(self._bound), size=less(self._size))

    def _mark(self) -> Column:
        """place() as a struct, which also tells where nulls stand: they compare as smallest, or by a flag where the order has them at the other end."""
        parts = []
        for k in self._order:
            if k.nulls_first is not None and k.nulls_first == k.desc:
                parts.append(F.col(k.name).isNull().alias(f"{k.name}_null"))
            parts.append(F.col(k.name))
        return F.struct(*parts)

    def _cut(self, condition, before: bool) -> Seq:
        df = self._take()
        bad = df.where(~true(condition))
        if self._uniform():
            edge = bad.agg((F.max if self._descending() else F.min)(self._mark()).alias("e")).scalar()
            ahead = self._mark() > edge if self._descending() else self._mark() < edge
            kept = F.coalesce(ahead, edge.isNull())
            return self._next(df.where(kept if before else ~kept), bound=self._bound)
        placed = numbered(df, self._order, "_place")
        edge = placed.where(~true(condition)).agg(F.min("_place").alias("e")).scalar()
        kept = F.coalesce(F.col("_place") < edge, edge.isNull())
        return self._next(placed.where(kept if before else ~kept).drop("_place"), bound=self._bound)

    def take_while(self, condition) -> Seq:
        """The rows before the first that fails; found by one aggregate, not by numbering rows."""
        return self._cut(condition, True)

    def drop_while(self, condition) -> Seq:
        return self._cut(condition, False)

    def with_position(self, name: str = "pos", by_ranges: bool | None = None) -> DataFrame:
        """The rows with their dense place from 0."""
        return numbered(self._take(), self._order, name, by_ranges).drop(*[k.name for k in self._order])

    # Results

    def frame(self) -> DataFrame:
        """The rows without the hidden order."""
        return self._take().drop(*[k.name for k in self._order])

    def ordered_frame(self) -> DataFrame:
        df = self._take()
        return df.orderBy(*sort_columns(self._order)).drop(*[k.name for k in self._order])

    def to_list(self) -> tuple:
        """All rows in order; of one column its values. For results that fit the driver."""
        rows = self.ordered_frame().collect()
        return tuple(r[0] for r in rows) if rows and len(rows[0]) == 1 else tuple(rows)

    to_array = to_list

    def iterator(self) -> Iterator:
        rows = self.ordered_frame().toLocalIterator()

        def run():
            yield from rows
            raise NoSuchElementException("no more elements")

        return run()

    def for_each(self, action: Callable) -> None:
        self.frame().foreachPartition(lambda rows: [action(r) for r in rows] and None)

    def for_each_ordered(self, action: Callable) -> None:
        for row in self.ordered_frame().toLocalIterator():
            action(row)

    def _context(self) -> Context:
        df = self._df
        types = dict(df.dtypes)
        numeric = all(types[k.name] in NUMBERS for k in self._order)
        turn = lambda k, back: -F.col(k.name) if k.desc != back else F.col(k.name)
        pack = lambda cs: cs[0] if len(cs) == 1 else F.struct(*cs)
        if numeric:
            return Context(pack([turn(k, False) for k in self._order]), pack([turn(k, True) for k in self._order]))
        return Context(self.place())

    def _collected(self, collectors: dict) -> tuple[DataFrame, Context]:
        """The rows as the collectors need them, numbered or expanded, and what they may use."""
        context, df = self._context(), self._take()
        if context.back is None and any(c.numbers for c in collectors.values()):
            df = numbered(df, self._order, "_place")
            context = Context(F.col("_place"), -F.col("_place"))
        if expands := [e for c in collectors.values() for e in c.expands]:
            df, context = expanded(df, expands), replace(context, branch=0)
        return df, context

    def aggregate(self, **columns: Column | Callable[[Context], Column]) -> DataFrame:
        """One row of aggregates; a callable gets the context (places of rows)."""
        context = self._context()
        return self._take().agg(*[(c(context) if callable(c) and not isinstance(c, Column) else c).alias(n) for n, c in columns.items()])

    def collect(self, **collectors: Collector) -> DataFrame:
        """One row: what each collector makes of all rows."""
        df, context = self._collected(collectors)
        return df.agg(*[c.of(context).alias(n) for n, c in collectors.items()])

    def grouping_by(self, key: dict | str, sort: bool = False, **collectors: Collector) -> DataFrame:
        """A row for each key with what each collector makes of its rows; sort: ordered by key."""
        df, context = self._collected(collectors)
        keys = {n: col(e) for n, e in key.items()} if isinstance(key, dict) else {key: F.col(key)}
        df = df.withColumns({f"_k_{n}": e for n, e in keys.items()})
        there = {f"_there{i}": c.present(context) for i, c in enumerate(collectors.values()) if c.present is not None}
        out = df.groupBy(*[F.col(f"_k_{n}").alias(n) for n in keys]).agg(*[c.of(context).alias(n) for n, c in collectors.items()], *[c.alias(n) for n, c in there.items()])
        if there:
            out = out.where(" OR ".join(there)).drop(*there) if len(there) == len(collectors) else out.drop(*there)
        return out.orderBy(*keys) if sort else out

    def partitioning_by(self, condition, name: str = "key", **collectors: Collector) -> DataFrame:
        """Two rows always, false first: what each collector makes of the rows that fail and that meet the condition. Two rows that no collector
        sees stand for the sides, so a side without rows gets what the collector gives for none."""
        df, context = self._collected(collectors)
        sides = df.sparkSession.range(2).select((F.col("id") == 1).alias("_k"), F.lit(False).alias("_real"))
        rows = df.withColumns({"_k": true(condition), "_real": F.lit(True)}).unionByName(sides, allowMissingColumns=True)
        context = replace(context, where=F.col("_real"))
        return rows.groupBy(F.col("_k").alias(name)).agg(*[c.of(context).alias(n) for n, c in collectors.items()]).orderBy(name)

    def count(self) -> int:
        return self.frame().count()

    def sum_int(self, value) -> DataFrame:
        return self.aggregate(result=F.coalesce(F.sum(col(value).cast("long")), F.lit(0).cast("long")))

    def sum_double(self, value) -> DataFrame:
        return self.aggregate(result=F.coalesce(exact_double_sum(col(value)), F.lit(0.0)))

    def average(self, value) -> DataFrame:
        """Null for no rows."""
        return self.aggregate(result=exact_double_sum(col(value)) / F.nullif(F.count(col(value)), F.lit(0)))

    def find_first(self) -> DataFrame:
        return self.limit(1).frame()

    find_any = find_first

    def any_match(self, condition) -> DataFrame:
        return self.aggregate(result=F.coalesce(F.bool_or(true(condition)), F.lit(False)))

    def all_match(self, condition) -> DataFrame:
        return self.aggregate(result=F.coalesce(F.bool_and(true(condition)), F.lit(True)))

    def none_match(self, condition) -> DataFrame:
        return self.aggregate(result=~F.coalesce(F.bool_or(true(condition)), F.lit(False)))

    def has_match(self, condition) -> bool:
        """Eager: stops at the first match."""
        return not self._take().where(col(condition)).isEmpty()

    def reduce(self, value, step: Callable[[Column, Column], Column], identity=None) -> DataFrame:
        """A left fold in encounter order. Values meet in one row: for known reductions use collect() with an aggregate. Without identity, null for no rows."""

        def fold(c: Context) -> Column:
            rows = F.transform(F.sort_array(F.collect_list(F.struct(c.place.alias("o"), col(value).alias("v")))), lambda x: x["v"])
            if identity is not None:
                return F.aggregate(rows, F.lit(identity) if not isinstance(identity, Column) else identity, step)
            return F.when(F.size(rows) > 0, F.aggregate(F.slice(rows, 2, F.greatest(F.size(rows), F.lit(1))), F.get(rows, F.lit(0)), step))

        return self.aggregate(result=fold)

    def min(self, key, *columns: str) -> DataFrame:
        """The row of the smallest key, of equals the first; no rows give none."""
        return self.sorted(natural_order(key)).limit(1).frame().select(*(columns or self.columns))

    def max(self, key, *columns: str) -> DataFrame:
        """The row of the largest key, of equals the first."""
        names = columns or self.columns
        return self.sorted(natural_order(key).reversed()).limit(1).frame().select(*names)

    def collect_python(self, supplier: Callable, accumulate: Callable, combine: Callable):
        """The mutable reduction: a container per task, combined in task order on the driver; rows in order within tasks."""
        df = self._take().repartitionByRange(*sort_columns(self._order)).sortWithinPartitions(*sort_columns(self._order)).drop(*[k.name for k in self._order])

        def run(i, rows):
            box = supplier()
            for r in rows:
                box = accumulate(box, r)
            yield i, box

        boxes = [b for _, b in sorted(df.rdd.mapPartitionsWithIndex(run).collect(), key=lambda x: x[0])]
        return fold_left(combine, boxes) if boxes else supplier()

