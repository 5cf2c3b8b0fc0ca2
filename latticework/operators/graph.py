"""Graphs as edge tables: reachability, least fixpoints, alias chains, strongly connected components."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from latticework.sources.shared import stored

#: Steps of a propagation between two writes to the shared folder; rounds after which what was found is written as one table.
HOPS, ROUNDS = 3, 8


def reachable(edges: DataFrame, seeds: DataFrame, most_rounds: int = 1000) -> DataFrame:
    """Nodes that a path of edges (a to b) leads to from the seeds, with the length of the shortest; seeds have 0.

    A join of the newest nodes with the edges each round, written to the shared folder; stops when none is new.
    """
    edges = edges.select("a", "b").distinct()
    seen = front = stored(seeds.select(F.col(seeds.columns[0]).alias("node")).distinct().withColumn("depth", F.lit(0)), "reachable")
    for depth in range(1, most_rounds + 1):
        new = front.join(edges, front["node"] == edges["a"]).select(F.col("b").alias("node")).distinct()
        front = stored(new.join(seen, "node", "left_anti").withColumn("depth", F.lit(depth)), "reachable")
        if front.isEmpty():
            return seen
        seen = seen.unionByName(front)
        if depth % ROUNDS == 0:
            seen = stored(seen, "reachable")
    raise RuntimeError(f"no fixpoint in {most_rounds} rounds")


def affected(calls: DataFrame, seeds: DataFrame) -> DataFrame:
    """The least fixpoint of 'is a seed, or calls (a calls b) something affected', with the distance to a seed."""
    return reachable(calls.select(F.col("b").alias("a"), F.col("a").alias("b")), seeds)


def chased(aliases: DataFrame, most_hops: int = 1000) -> DataFrame:
    """Where each alias leads at last: name, final, hops. aliases: name, target, one row for each name.

    A chain that comes back to a name it has passed stops at that name. Stops when no chain is open.
    """
    aliases = aliases.select("name", "target")
    step = aliases.select(F.col("name").alias("_name"), F.col("target").alias("_target"))
    now = aliases.select("name", F.col("target").alias("final"), F.array("name").alias("passed"), F.lit(1).alias("hops"), F.lit(False).alias("done"))
    for _ in range(most_hops):
        back = F.array_contains("passed", F.col("final"))
        going = now.where("not done").join(step, F.col("final") == F.col("_name"), "left")
        ended = F.col("_target").isNull() | back
        moved = going.select("name", F.when(ended, F.col("final")).otherwise(F.col("_target")).alias("final"), F.when(ended, F.col("passed")).otherwise(F.concat("passed", F.array("final"))).alias("passed"), F.when(ended, F.col("hops")).otherwise(F.col("hops") + 1).alias("hops"), ended.alias("done"))
        now = stored(now.where("done").unionByName(moved), "chased")
        if now.where("not done").isEmpty():
            return now.select("name", "final", "hops")
    raise RuntimeError(f"chains still open after {most_hops} hops")


def strong_components(edges: DataFrame, most_rounds: int = 1000) -> DataFrame:
    """node, component (the least node of it) of all nodes in cycles: each pass colours nodes by the greatest node
    that reaches them, and takes from each colour those that reach its source; what is left goes on.
    """
    left = stored(edges.where("a <> b").select("a", "b").distinct(), "scc")
    found, n_edges = None, left.count()
    for _ in range(most_rounds):
        while True:  # nodes without a way in or out are in no cycle
            trimmed = left.join(left.select(F.col("b").alias("a")).distinct(), "a", "left_semi").join(left.select(F.col("a").alias("b")).distinct(), "b", "left_semi")
            trimmed, n_before = stored(trimmed, "scc"), n_edges
            left, n_edges = trimmed, trimmed.count()
            if n_edges == n_before:
                break
        if not n_edges:
            break
        colour = left.select(F.col("a").alias("node"), F.col("a").alias("colour")).distinct()
        while True:
            after = colour
            for _ in range(HOPS):  # several steps between two writes
                pushed = left.join(after, left["a"] == after["node"]).groupBy(F.col("b").alias("node")).agg(F.max("colour").alias("pushed"))
                after = after.join(pushed, "node", "left").select("node", F.greatest("colour", F.coalesce("pushed", "colour")).alias("colour"))
            after = stored(after.join(colour.withColumnRenamed("colour", "was"), "node").select("node", "colour", (F.col("colour") > F.col("was")).alias("changed")), "scc")
            changed = not after.where("changed").isEmpty()
            colour = after.drop("changed")
            if not changed:
                break
        inside = left.join(colour.select(F.col("node").alias("a"), F.col("colour").alias("ca")), "a").join(colour.select(F.col("node").alias("b"), F.col("colour").alias("cb")), "b").where("ca = cb")
        inside = stored(inside.select("a", "b", F.col("ca").alias("colour")), "scc")
        seen = front = stored(inside.where("b = colour").select(F.col("b").alias("node"), "colour").distinct(), "scc")
        while not front.isEmpty():
            new = inside.join(front, (inside["b"] == front["node"]) & (inside["colour"] == front["colour"])).select(inside["a"].alias("node"), inside["colour"]).distinct()
            front = stored(new.join(seen, ["node", "colour"], "left_anti"), "scc")
            seen = seen.unionByName(front)
        seen = stored(seen, "scc")
        found = seen if found is None else found.unionByName(seen)
        left = stored(left.join(seen.select(F.col("node").alias("a")), "a", "left_anti").join(seen.select(F.col("node").alias("b")), "b", "left_anti"), "scc")
        n_edges = left.count()
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    if found is None:
        return edges.select(F.col("a").alias("node"), F.col("a").alias("component")).limit(0)
    size = found.groupBy("colour").agg(F.count("*").alias("n"), F.min("node").alias("component")).where("n > 1")
    return found.join(size, "colour").select("node", "component")


def ancestry(edges: DataFrame, most_depth: int = 1000) -> DataFrame:
    """node, ancestor, depth for all paths a to b, each pair at its least depth; a node in a cycle is its own ancestor.
    Stops when no pair is new.
    """
    edges = edges.select("a", "b").distinct()
    step = edges.select(F.col("a").alias("_a"), F.col("b").alias("_b"))
    seen = front = stored(edges.select(F.col("a").alias("node"), F.col("b").alias("ancestor"), F.lit(1).alias("depth")), "ancestry")
    for depth in range(2, most_depth + 1):
        new = front.join(step, F.col("ancestor") == F.col("_a")).select("node", F.col("_b").alias("ancestor")).distinct()
        front = stored(new.join(seen, ["node", "ancestor"], "left_anti").withColumn("depth", F.lit(depth)), "ancestry")
        if front.isEmpty():
            return seen
        seen = seen.unionByName(front)
        if depth % ROUNDS == 0:
            seen = stored(seen, "ancestry")
    raise RuntimeError(f"ancestors still open at depth {most_depth}")
