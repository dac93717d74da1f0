"""Hash codes of values and collections, 32 bits as in two's complement, made by aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MASK = 0xFFFFFFFF
_WHOLE = ("tinyint", "smallint", "int", "bigint")


def _long(n: int) -> Column:
    return F.lit(n).cast("long")


def value_hash(c: Column, kind: str) -> Column:
    """Whole numbers are their own hash (their lowest 32 bits), others that of their text; null has 0."""
    own = c.cast("long") if kind in _WHOLE else F.crc32(c.cast("string").cast("binary"))
    return F.coalesce(own.bitwiseAND(_long(MASK)), _long(0))


def _times(a: Column, b: Column) -> Column:
    """a * b modulo 2^32 without overflow of 64 bits."""
    high = (a * F.shiftright(b, 16)).bitwiseAND(_long(0xFFFF)) * _long(1 << 16)
    return (high + a * b.bitwiseAND(_long(0xFFFF))).bitwiseAND(_long(MASK))


def power(base: int, n: Column) -> Column:
    """base^n modulo 2^32, by the bits of n."""
    steps = F.array(*[F.struct(_long(1 << k).alias("bit"), _long(pow(base, 1 << k, 1 << 32)).alias("p")) for k in range(48)])
    return F.aggregate(steps, _long(1), lambda acc, x: F.when(n.bitwiseAND(x["bit"]) != 0, _times(acc, x["p"])).otherwise(acc))


def signed(c: Column) -> Column:
    low = c.bitwiseAND(_long(MASK))
    return F.when(low >= 1 << 31, low - (1 << 32)).otherwise(low).cast("int")


def _sum(c: Column) -> Column:
    """The sum modulo 2^32, by halves, so that 64 bits do for any number of rows."""
    high, low = (F.coalesce(F.sum(x), _long(0)) for x in (F.shiftright(c, 16), c.bitwiseAND(_long(0xFFFF))))
    return (high.bitwiseAND(_long(0xFFFF)) * _long(1 << 16) + low).bitwiseAND(_long(MASK))


def list_hash(df: DataFrame) -> DataFrame:
    """One row, result: the fold h = 31 * h + hash(value) from 1 over the values by `pos`. A place's share is divided by a power of 31 (which is odd, so there is an
    inverse) and all are multiplied by 31^(n - 1) in the end: they are summed in any order, before their number is known."""
    share = _times(value_hash(F.col("value"), dict(df.dtypes)["value"]), power(pow(31, -1, 1 << 32), F.col("pos")))
    total = df.agg(_sum(share).alias("s"), F.count("*").alias("n"))
    return total.select(signed(_times(F.col("s"), power(31, F.greatest(F.col("n") - 1, _long(0)))) + power(31, F.col("n"))).alias("result"))


def set_hash(df: DataFrame, column: str = "value") -> DataFrame:
    """One row, result: the sum of the values' hashes."""
    return df.agg(signed(_sum(value_hash(F.col(column), dict(df.dtypes)[column]))).alias("result"))


def map_hash(df: DataFrame) -> DataFrame:
    """One row, result: the sum of the entries' hashes, of key and value joined by exclusive or."""
    kinds = dict(df.dtypes)
    return df.agg(signed(_sum(value_hash(F.col("key"), kinds["key"]).bitwiseXOR(value_hash(F.col("value"), kinds["value"])))).alias("result"))


def plain_hash(x) -> int:
    """value_hash() of a plain value."""
    from zlib import crc32

    if x is None:
        return 0
    return x & MASK if isinstance(x, int) and not isinstance(x, bool) else crc32((str(x).lower() if isinstance(x, bool) else str(x)).encode())
