"""Collectors: aggregate expressions that compose.

A collector turns a value column and the frame's order into an aggregate expression and says what it
gives for no rows. It runs in Seq.collect() (all rows) or under grouping_by() (each key).
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace
from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CONCURRENT, UNORDERED, IDENTITY_FINISH = "concurrent", "unordered", "identity_finish"


def _col(c) -> Column:
    return F.expr(c) if isinstance(c, str) else c


@dataclass(frozen=True)
class Context:
    """What a collector may use: the place of a row (compares as the order does), the same backwards if the order is by numbers, and the rows it is
    limited to: by a condition and, where rows were expanded, by the flat_mapping that made them (0: none, the rows themselves)."""

    place: Column
    back: Column | None = None
    where: Column | None = None
    branch: int | None = None

    def _mine(self) -> Column | None:
        both = [c for c in (self.where, None if self.branch is None else F.col("_branch") == self.branch) if c is not None]
        return F.coalesce(both[0] & both[1] if len(both) == 2 else both[0], F.lit(False)) if both else None

    def only(self, c: Column) -> Column:
        return c if (mine := self._mine()) is None else F.when(mine, c)

    def counted(self) -> Column:
        return F.lit(True) if (mine := self._mine()) is None else mine


@dataclass(frozen=True)
class Collector:
    """`expands`: (branch, branch whose rows are expanded, array) of each flat_mapping within. `numbers`: needs places that can be turned round.
    `drops_empty`: a group without rows for it has no result, and `present` says which have."""

    aggregate: Callable[[Context], Column]
    empty: Column | None = None
    characteristics: frozenset = frozenset()
    expands: tuple = ()
    numbers: bool = False
    drops_empty: bool = False
    present: Callable[[Context], Column] | None = None

    def has(self, characteristic: str) -> bool:
        return characteristic in self.characteristics

    def of(self, context: Context) -> Column:
        out = self.aggregate(context)
        return out if self.empty is None else F.coalesce(out, self.empty)


def _in_order(context: Context, value: Column) -> Column:
    """The values as an array in encounter order."""
    rows = F.sort_array(F.collect_list(context.only(F.struct(context.place.alias("o"), value.alias("v")))))
    return F.transform(rows, lambda x: x["v"])


def to_list(value="value") -> Collector:
    return Collector(lambda c: _in_order(c, _col(value)), characteristics=frozenset({IDENTITY_FINISH}))


to_unmodifiable_list = to_list


def to_set(value="value") -> Collector:
    """Distinct values, sorted so that the result is the same each time."""
    return Collector(lambda c: F.sort_array(F.collect_set(c.only(_col(value)))), characteristics=frozenset({IDENTITY_FINISH, UNORDERED}))


to_unmodifiable_set = to_set


def joining(delimiter: str = "", prefix: str = "", suffix: str = "", value="value") -> Collector:
    """No rows: prefix and suffix."""
    return Collector(lambda c: F.concat(F.lit(prefix), F.array_join(_in_order(c, _col(value).cast("string")), delimiter), F.lit(suffix)), F.lit(prefix + suffix))


def counting() -> Collector:
    return Collector(lambda c: F.count_if(c.counted()), F.lit(0).cast("long"))


def wrapped_int(total: Column) -> Column:
    """A 64-bit sum narrowed to 32 bits as two's complement."""
    return F.shiftright(F.shiftleft(total, 32), 32).cast("int")


def summing_long(value) -> Collector:
    return Collector(lambda c: F.sum(c.only(_col(value).cast("long"))), F.lit(0).cast("long"))


def summing_int(value) -> Collector:
    return Collector(lambda c: wrapped_int(F.coalesce(F.sum(c.only(_col(value).cast("long"))), F.lit(0).cast("long"))))


#: Digits of exact sums: how many, the bits of each, and the power of two that the lowest counts.
DIGITS, DIGIT_BITS, LOWEST = 8, 24, -96


def exact_double_sum(value: Column) -> Column:
    """The sum of any doubles, the same whatever the partitioning; null for no values.

    Doubles that stand for decimals of up to six places are summed as these decimals. Others are cut into
    whole digits of 2^24 (from 2^-96 up to 2^95). Digits are summed as longs, so nothing is lost until
    their sums are put together, from the highest down. What lies outside that range (also infinities and
    NaN) is summed as doubles.
    """
    x = value.cast("double")
    millionths = F.rint(x * F.lit(1e6))
    decimal = (F.abs(millionths) < F.lit(2.0**53)) & (millionths / F.lit(1e6) == x)
    units = F.when(decimal, millionths)
    parts = [F.rint(units * F.lit(2.0 ** (-18 * k))) for k in range(4)]
    tally = F.lit(0).cast("decimal(38,0)")
    for k in range(3):
        part = parts[k] - parts[k + 1] * F.lit(2.0**18) if k < 2 else parts[k]
        tally = (tally + (F.coalesce(F.sum(part.cast("long")), F.lit(0)).cast("decimal(20,0)") * F.lit(2 ** (18 * k)).cast("decimal(12,0)"))).cast("decimal(38,0)")
    as_decimals = (tally.cast("decimal(38,6)") * F.lit("0.000001").cast("decimal(6,6)")).cast("decimal(38,6)").cast("double")
    fits = F.abs(x) < F.lit(2.0**95)  # NaN counts as larger
    inside = F.when(fits & ~decimal, x)
    whole = [F.rint(inside * F.lit(2.0 ** -(LOWEST + DIGIT_BITS * k))) for k in range(DIGITS + 1)]
    zero = F.lit(0).cast("long")
    sums = [F.coalesce(F.sum((whole[k] - whole[k + 1] * F.lit(2.0**DIGIT_BITS)).cast("long")), zero) for k in range(DIGITS)]
    digits, carry = [], zero
    for s in sums[:-1]:
        total = s + carry
        digits.append(total.bitwiseAND(F.lit(2**DIGIT_BITS - 1).cast("long")))
        carry = F.shiftright(total, DIGIT_BITS)
    digits.append(sums[-1] + carry)
    out = F.lit(0.0)
    for k in reversed(range(DIGITS)):
        out = out + digits[k].cast("double") * F.lit(2.0 ** (LOWEST + DIGIT_BITS * k))
    for other in (inside - whole[0] * F.lit(2.0**LOWEST), F.when(~fits, x)):
        out = out + F.coalesce(F.sum(other), F.lit(0.0))
    return F.when(F.count(x) > 0, as_decimals + out)


def _double_sum(value: Column, scale: int | None) -> Column:
    return exact_double_sum(value) if scale is None else F.sum(value.cast(f"decimal(18,{scale})")).cast("double")


def summing_double(value, scale: int | None = None) -> Collector:
    """The exact sum; with a scale, of the values rounded to so many places."""
    return Collector(lambda c: _double_sum(c.only(_col(value)), scale), F.lit(0.0))


def averaging_int(value) -> Collector:
    return Collector(lambda c: F.avg(c.only(_col(value).cast("long"))), F.lit(0.0))


averaging_long = averaging_int


def averaging_double(value, scale: int | None = None) -> Collector:
    return Collector(lambda c: _double_sum(c.only(_col(value)), scale) / F.nullif(F.count(c.only(_col(value))), F.lit(0)), F.lit(0.0))


def min_by(key, value) -> Collector:
    """The value of the smallest key; of equals the first met. No rows: null."""
    return Collector(lambda c: F.min_by(_col(value), c.only(F.struct(_col(key).alias("k"), c.place.alias("o")))))


def max_by(key, value) -> Collector:
    """The value of the largest key; of equals the first met. No rows: null."""
    return Collector(lambda c: F.max_by(_col(value), c.only(F.struct(_col(key).alias("k"), c.back.alias("o")))), numbers=True)


def reducing(value, merge: Callable[[Column], Column], identity=None, with_identity: Callable[[Column, Column], Column] | None = None) -> Collector:
    """A reduction that is known as an aggregate (merge: e.g. F.sum, F.max). With an identity, that is folded in once, and is the result for no rows."""

    def aggregate(c: Context) -> Column:
        got = merge(c.only(_col(value)))
        if identity is None:
            return got
        return F.when(got.isNull(), _lit(identity)).otherwise(with_identity(_lit(identity), got) if with_identity else got)

    return Collector(aggregate)


def folding(value, identity, step: Callable[[Column, Column], Column], finish: Callable[[Column], Column] | None = None) -> Collector:
    """A left fold in encounter order with any step: the group's values are gathered in one row first, so a group has to fit a task."""
    return Collector(lambda c: F.aggregate(_in_order(c, _col(value)), _lit(identity), step, finish) if finish else F.aggregate(_in_order(c, _col(value)), _lit(identity), step))


def _lit(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def mapping(value, downstream: Callable[[Column], Collector]) -> Collector:
    return downstream(_col(value))


def filtering(condition, downstream: Collector) -> Collector:
    """Limits the rows of each group; groups without any stay (but keys of to_map(), which then have no value)."""

    def within(c: Context) -> Context:
        here = F.coalesce(_col(condition), F.lit(False))
        return replace(c, where=here if c.where is None else c.where & here)

    present = downstream.present
    if downstream.drops_empty:
        present = lambda c: F.count_if(c.counted()) > 0 if downstream.present is None else downstream.present(c)
    return replace(downstream, aggregate=lambda c: downstream.aggregate(within(c)), present=present and (lambda c: present(within(c))))


_branches = count(1)


def flat_mapping(array, downstream: Callable[[Column], Collector]) -> Collector:
    """Expands an array of each row for the downstream alone; groups whose arrays are all empty stay.

    The items become rows of a branch of their own beside the rows that they come from, so collectors
    side by side, within each other or around this one each see their own rows.
    """
    branch = next(_branches)
    inner = downstream(F.col(f"_item{branch}"))
    expands = ((branch, 0, _col(array)), *((b, branch if parent == 0 else parent, a) for b, parent, a in inner.expands))

    def aggregate(c: Context) -> Column:
        at = F.col(f"_at{branch}")
        place = F.struct(c.place.alias("row"), at.alias("item"))
        back = None if c.back is None else F.struct(c.back.alias("row"), (-at).alias("item"))
        return inner.aggregate(replace(c, place=place, back=back, branch=branch))

    return replace(inner, aggregate=aggregate, expands=expands)


def expanded(df: DataFrame, expands) -> DataFrame:
    """The rows (branch 0) and, beside them, the items of each flat_mapping, with their places in their arrays."""
    df = df.withColumn("_branch", F.lit(0))
    for branch, parent, array in expands:
        one = lambda b, at, item: F.struct(b.alias("b"), at.alias("at"), item.alias("item"))
        items = F.transform(array, lambda x, i: one(F.lit(branch), i.cast("int"), x))  # noqa: B023  used at once
        own = F.array(one(F.col("_branch"), F.lit(None).cast("int"), F.get(array, F.lit(-1))))  # a null of the items' type
        both = F.when((F.col("_branch") == parent) & array.isNotNull(), F.concat(own, items)).otherwise(own)
        df = df.withColumn("_row", F.explode(both)).withColumns({"_branch": F.col("_row.b"), f"_at{branch}": F.col("_row.at"), f"_item{branch}": F.col("_row.item")}).drop("_row")
    return df


def collecting_and_then(downstream: Collector, finish: Callable[[Column], Column]) -> Collector:
    return replace(downstream, aggregate=lambda c: finish(downstream.of(c)), empty=None, characteristics=downstream.characteristics - {IDENTITY_FINISH})


def teeing(one: Collector, two: Collector, merge: Callable[[Column, Column], Column]) -> Collector:
    return Collector(lambda c: merge(one.of(c), two.of(c)), expands=one.expands + two.expands, numbers=one.numbers or two.numbers)


def summarizing(value, kind: str) -> Collector:
    """count, sum, min, max, average as a struct; kind: int, long or double. No rows: the extremes of the type as min and max, average 0."""
    top = {"int": (2**31 - 1, -(2**31)), "long": (2**63 - 1, -(2**63)), "double": (float("inf"), float("-inf"))}[kind]

    def aggregate(c: Context) -> Column:
        x = c.only(_col(value).cast(kind))
        seen = F.when(~F.isnan(x), x) if kind == "double" else x
        total = F.coalesce(exact_double_sum(x), F.lit(0.0)) if kind == "double" else F.coalesce(F.sum(x.cast("long")), F.lit(0).cast("long"))
        n = F.count(x)
        lowest, highest = (F.coalesce(f(seen), F.lit(t).cast(kind)) for f, t in ((F.min, top[0]), (F.max, top[1])))
        return F.struct(n.alias("count"), total.alias("sum"), lowest.alias("min"), highest.alias("max"), F.coalesce(total / F.nullif(n, F.lit(0)), F.lit(0.0)).alias("average"))

    return Collector(aggregate)


def to_map(value, merge: Callable[[Column], Column] | None = None) -> Collector:
    """One value for each key. Without a merge function a second value for a key is an error; with one (an aggregate), values are merged in encounter order."""
    if merge is not None:
        return Collector(lambda c: merge(_in_order(c, _col(value))), drops_empty=True)
    return Collector(lambda c: F.when(F.count_if(c.counted()) > 1, F.raise_error(F.lit("Duplicate key"))).otherwise(F.first(c.only(_col(value)), ignorenulls=True)), drops_empty=True)


def custom(value, supplier: Column, accumulate: Callable[[Column, Column], Column], finish: Callable[[Column], Column] | None = None, characteristics=()) -> Collector:
    """A collector of one's own: supplier, accumulator and finisher over the group's values in encounter order."""
    return replace(folding(value, supplier, accumulate, finish), characteristics=frozenset(characteristics))
