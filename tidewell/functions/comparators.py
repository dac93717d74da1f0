"""Comparators as lists of sort keys, composable like functions."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Part:
    expr: Column
    desc: bool = False
    nulls_first: bool | None = None  # None: nulls are not expected; they stand where Spark puts them


@dataclass(frozen=True)
class Comparator:
    parts: tuple[Part, ...]

    def reversed(self) -> Comparator:
        """Flips every direction and where nulls stand."""
        return Comparator(tuple(replace(p, desc=not p.desc, nulls_first=None if p.nulls_first is None else not p.nulls_first) for p in self.parts))

    def then(self, other: Comparator | Column | str) -> Comparator:
        return Comparator(self.parts + (other if isinstance(other, Comparator) else comparing(other)).parts)

    then_comparing = then

    def columns(self) -> list[Column]:
        out = []
        for p in self.parts:
            first = (not p.desc) if p.nulls_first is None else p.nulls_first
            out.append((p.expr.desc_nulls_first() if first else p.expr.desc_nulls_last()) if p.desc else (p.expr.asc_nulls_first() if first else p.expr.asc_nulls_last()))
        return out

    def compare(self, a, b) -> int:
        """Compares two plain values by the first part; for use outside Spark."""
        flip = -1 if self.parts[0].desc else 1
        if a is None or b is None:
            first = bool(self.parts[0].nulls_first)
            return 0 if a is b else (-1 if (a is None) == first else 1)
        return flip * ((a > b) - (a < b))

    __call__ = compare


def _col(key) -> Column:
    return F.expr(key) if isinstance(key, str) else key


def natural_order(key: Column | str = "value") -> Comparator:
    return Comparator((Part(_col(key)),))


def reverse_order(key: Column | str = "value") -> Comparator:
    return natural_order(key).reversed()


def comparing(key: Column | str, by: Comparator | None = None) -> Comparator:
    """By a key; `by` may turn its direction or place its nulls."""
    part = by.parts[0] if by else Part(_col(key))
    return Comparator((replace(part, expr=_col(key)),))


def comparing_int(key) -> Comparator:
    return comparing(_col(key).cast("int"))


def comparing_long(key) -> Comparator:
    return comparing(_col(key).cast("long"))


def comparing_double(key) -> Comparator:
    """Total order of doubles: -0.0 before 0.0, NaN last."""
    x = _col(key).cast("double")
    sign = F.when(x.cast("string") == "-0.0", 0).otherwise(1)
    return Comparator((Part(x), Part(sign)))


def nulls_first(by: Comparator) -> Comparator:
    return Comparator(tuple(replace(p, nulls_first=True) for p in by.parts))


def nulls_last(by: Comparator) -> Comparator:
    return Comparator(tuple(replace(p, nulls_first=False) for p in by.parts))


def comparing_by_key(by: Comparator | None = None) -> Comparator:
    return comparing("key", by)


def comparing_by_value(by: Comparator | None = None) -> Comparator:
    return comparing("value", by)
