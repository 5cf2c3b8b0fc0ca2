"""Digests rolled up a tree: a node's digest covers its own content and its children's digests, in order of their names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def leaf_digest(name: Column, content: Column) -> Column:
    return F.sha2(F.concat_ws("|", name.cast("string"), content.cast("string")).cast("binary"), 256)


def rolled_up(children: DataFrame, parent: str, name: str, digest: str) -> DataFrame:
    """For each parent the digest of its children's sorted `name=digest` texts. Children of one parent are few
    thousand at most in a tree of files; wider levels are to be split into levels of their own.
    """
    each = F.concat_ws("=", F.col(name).cast("string"), F.col(digest))
    return children.groupBy(parent).agg(F.sha2(F.array_join(F.array_sort(F.collect_list(each)), "\n").cast("binary"), 256).alias("digest"), F.count("*").alias("children"))


def reconciled(old: DataFrame, new: DataFrame, key: str, digest: str) -> DataFrame:
    """key and state (reused, rebuilt, added, removed) of every node of two trees."""
    o, n = old.select(key, F.col(digest).alias("_o")), new.select(key, F.col(digest).alias("_n"))
    state = F.when(F.col("_o").isNull(), "added").when(F.col("_n").isNull(), "removed").when(F.col("_o") == F.col("_n"), "reused").otherwise("rebuilt")
    return o.join(n, key, "full").select(key, state.alias("state"))
