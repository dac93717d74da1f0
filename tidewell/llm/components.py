"""Connected components of an edge table, in Spark, by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, stored


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, root) for every node of `edges` (a long, b long): root is the smallest id that the node reaches.

    Large-star and small-star steps (Kiveris et al., "Connected Components in MapReduce and Beyond")
    alternate until the edge set no longer changes: O(log^2 n) rounds, each a few shuffles of at most
    as many edges as before. A hub's edges are only joined (which Spark can split) and reduced by
    min(), never gathered. Every round is written to the shared folder.
    """

    def large(e: DataFrame) -> DataFrame:
        both = e.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(e.select(F.col("b").alias("u"), F.col("a").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        return both.where("v > u").join(low, "u").select(F.col("v").alias("a"), F.col("m").alias("b"))

    def small(e: DataFrame) -> DataFrame:
        down = e.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        low = down.groupBy("u").agg(F.min("v").alias("m"))
        moved = down.join(low, "u")
        return moved.where("v <> m").select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(low.select(F.col("u").alias("a"), F.col("m").alias("b")))

    def state(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b") % 1_000_000_007)).first())

    now = stored(edges.select("a", "b").where("a <> b").distinct(), name)
    was = state(now)
    while was[0]:
        new = stored(small(large(now).distinct()).where("a <> b").distinct(), name)
        discard(now)
        now, is_ = new, state(new)
        if is_ == was:
            break
        was = is_
    roots = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
