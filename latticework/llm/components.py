"""Connected components by alternating stars: every node ends up beside the least node of its component."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from latticework.llm.common import stored


def components(edges: DataFrame, name: str = "components", most_rounds: int = 60) -> DataFrame:
    """edges: a, b long. Returns node, component (the least node); nodes without an edge aren't there.

    Each round is a few joins and groupings by node, written to the shared folder; a node's links are never
    gathered in one row, and as both sides of a join are plain tables, Spark splits a hub's links among tasks. Rounds grow with the logarithm of the longest path.
    """
    now = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    now, seen = stored(now, name), None
    for _ in range(most_rounds):
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = stored(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), name)
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        large = stored(large, name)
        least = stored(large.groupBy("a").agg(F.min("b").alias("m")), name)
        small = large.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        small = stored(small.unionByName(least.select("a", F.col("m").alias("b"))).distinct(), name)
        sum_ = tuple(small.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.xxhash64("b", "a").cast("decimal(38,0)"))).first())
        now = small
        if sum_ == seen:
            break
        seen = sum_
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
