"""Registration of queries with their oracle SQL, and the tables in their natural order."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.seq import Seq

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: Columns that are unique together and tell the order of each table.
ORDER = {"region": ["r_regionkey"], "nation": ["n_nationkey"], "customer": ["c_custkey"], "supplier": ["s_suppkey"], "part": ["p_partkey"], "orders": ["o_orderkey"], "events": ["event_id"], "documents": ["doc_id"], "conversations": ["conv_id", "turn"], "embeddings": ["vec_id"]}


class Tables:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def df(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def seq(self, name: str, *columns: str) -> Seq:
        """The table as a sequence; with columns, only those."""
        df = self.df(name)
        order = ORDER.get(name) or [c for c in df.columns]
        if columns:
            df = df.select(*dict.fromkeys([*columns, *order]))
        out = Seq(df, order)
        return out.map(**{c: F.col(c) for c in columns}) if columns else out


def query(name: str, sql: str | None = None):
    """Registers a function of Tables as a query; sql: the same in the oracle's dialect."""

    def register(make: Callable[[Tables], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: make(Tables(spark, sf_dir))
        if sql:
            ORACLES[name] = sql
        return make

    return register
