"""Optional: a value that may be absent, as a plain object and as nullable columns."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import NoSuchElementException, NullPointerException


@dataclass(frozen=True)
class Optional:
    value: Any = None

    @staticmethod
    def empty() -> Optional:
        return Optional()

    @staticmethod
    def of(value) -> Optional:
        if value is None:
            raise NullPointerException("null value")
        return Optional(value)

    @staticmethod
    def of_nullable(value) -> Optional:
        return Optional(value)

    def is_present(self) -> bool:
        return self.value is not None

    def is_empty(self) -> bool:
        return self.value is None

    def get(self):
        if self.value is None:
            raise NoSuchElementException("No value present")
        return self.value

    def or_else(self, other):
        return other if self.value is None else self.value

    def or_else_get(self, supplier: Callable):
        return supplier() if self.value is None else self.value

    def or_get(self, supplier: Callable[[], Optional]) -> Optional:
        return supplier() if self.value is None else self

    def or_else_throw(self, error: Callable[[], Exception] | None = None):
        if self.value is None:
            raise error() if error else NoSuchElementException("No value present")
        return self.value

    def if_present(self, action: Callable) -> None:
        if self.value is not None:
            action(self.value)

    def if_present_or_else(self, action: Callable, otherwise: Callable) -> None:
        otherwise() if self.value is None else action(self.value)

    def map(self, f: Callable) -> Optional:
        return self if self.value is None else Optional(f(self.value))

    def flat_map(self, f: Callable[[Any], Optional]) -> Optional:
        return self if self.value is None else f(self.value)

    def filter(self, p: Callable) -> Optional:
        return self if self.value is None or p(self.value) else Optional()

    def __hash__(self) -> int:
        return 0 if self.value is None else hash(self.value)

    def __str__(self) -> str:
        return "Optional.empty" if self.value is None else f"Optional[{self.value}]"


def of_nullable(c: Column, there: Column) -> Column:
    """The column's value where `there` holds, else absent."""
    return F.when(there, c)


def is_present(c: Column) -> Column:
    return c.isNotNull()


def is_empty(c: Column) -> Column:
    return c.isNull()


def mapped(c: Column, f: Callable[[Column], Column]) -> Column:
    """f of the value where there is one."""
    return F.when(c.isNotNull(), f(c))


def flat_mapped(c: Column, f: Callable[[Column], Column]) -> Column:
    """f of the value, itself absent or not, where there is one."""
    return mapped(c, f)


def or_else(c: Column, other) -> Column:
    return F.coalesce(c, other if isinstance(other, Column) else F.lit(other))


def or_else_throw(c: Column, message: str = "No value present") -> Column:
    return F.when(c.isNull(), F.raise_error(F.lit(message))).otherwise(c)


def filtered(c: Column, condition: Column) -> Column:
    return F.when(condition, c)


def equal(a: Column, b: Column) -> Column:
    return a.eqNullSafe(b)


def to_string(c: Column) -> Column:
    return F.when(c.isNull(), F.lit("Optional.empty")).otherwise(F.concat(F.lit("Optional["), c.cast("string"), F.lit("]")))
