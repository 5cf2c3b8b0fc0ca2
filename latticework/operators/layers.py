"""Tables against tables: layers over a base, what is stale, multiset differences, spans that overlap, trees of dotted names."""

from __future__ import annotations

from bisect import bisect_left

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def overlaid(base: DataFrame, layer: DataFrame, key: str, deleted: str) -> DataFrame:
    """What is seen through a layer: its rows stand before the base's of that key, those marked deleted hide it; no mark is none."""
    return base.join(layer, key, "left_anti").unionByName(layer.where(~F.coalesce(deleted, F.lit(False))).select(*base.columns))


def changed(now: DataFrame, known: DataFrame, key: str, digest: str) -> DataFrame:
    """Keys that are new, or whose digest isn't the known one."""
    return now.join(known, [key, digest], "left_anti").select(key)


def both_ways(old: DataFrame, new: DataFrame) -> DataFrame:
    """Rows that one table has oftener than the other: side (old or new), the columns, and how many more."""
    columns = new.columns
    times = old.select(*columns, F.lit(-1).alias("n")).unionByName(new.select(*columns, F.lit(1).alias("n"))).groupBy(*columns).agg(F.sum("n").alias("n")).where("n <> 0")
    return times.select(F.when(F.col("n") > 0, "new").otherwise("old").alias("side"), *columns, F.abs("n").cast("long").alias("n"))


def overlapping(edits: DataFrame, group: str, number: str, start: str, end: str) -> DataFrame:
    """Pairs of a group's edits, by number, whose half-open spans share a place. A group's edits are few: those of one file."""
    x, y = edits.alias("x"), edits.alias("y")
    met = (F.col(f"x.{group}") == F.col(f"y.{group}")) & (F.col(f"x.{number}") < F.col(f"y.{number}")) & (F.col(f"x.{start}") < F.col(f"y.{end}")) & (F.col(f"y.{start}") < F.col(f"x.{end}"))
    return x.join(y, met).select(F.col(f"x.{group}").alias(group), F.col(f"x.{number}").alias("first"), F.col(f"y.{number}").alias("second"))


def claimed(edits: DataFrame, group: str, start: str, end: str, order: list[str]) -> DataFrame:
    """The rows with `kept`: whether a span was free when its turn came. Spans (half-open) of a group are gone through by `order`,
    which names a row within its group; one is kept if it overlaps none that was kept before it. Empty spans and rows without a group, start or end
    overlap nothing and are kept.

    Spans that overlap none before them begin a new run, and runs don't touch each other: a run is a group of its own, so that
    a wide group is as many tasks' work as it has runs. Within a run the kept spans are a sorted list.
    """
    real = F.coalesce(F.col(start) < F.col(end), F.lit(False)) & F.col(group).isNotNull()
    place = W.partitionBy(group).orderBy(start, end, *order)
    reach = F.max(end).over(place.rowsBetween(W.unboundedPreceding, -1))
    rows = edits.where(real).withColumn("_new", F.coalesce(F.col(start) >= reach, F.lit(True)).cast("long")).withColumn("_run", F.sum("_new").over(place))
    rows = rows.repartition(group, "_run").sortWithinPartitions(group, "_run", *order)

    columns = list(edits.columns)

    def keep(batches):
        now, kept = None, []
        for b in batches:
            out = []
            for g, run, a, z in zip(*(b.column(k).to_pylist() for k in (group, "_run", start, end))):
                if (g, run) != now:
                    now, kept = (g, run), []
                i = bisect_left(kept, (a,))
                free = (i == len(kept) or kept[i][0] >= z) and (i == 0 or kept[i - 1][1] <= a)
                if free:
                    kept.insert(i, (a, z))
                out.append(free)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in columns), pa.array(out, pa.bool_())], [*columns, "kept"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in edits.schema)
    return rows.mapInArrow(keep, f"{fields}, kept boolean").unionByName(edits.where(~real).withColumn("kept", F.lit(True)))


def prefixes(name: Column) -> Column:
    """a.b.c -> [a, a.b, a.b.c]."""
    parts = F.split(name, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "."))


def package_tree(names: DataFrame, column: str) -> DataFrame:
    """node, parent (NULL at the top), depth, members (names at or below it) of the tree that dotted names make."""
    nodes = names.where(F.col(column).isNotNull()).select(F.explode(prefixes(F.col(column))).alias("node")).groupBy("node").agg(F.count("*").alias("members"))
    parent = F.when(F.col("node").contains("."), F.regexp_replace("node", r"\.[^.]*$", ""))
    return nodes.select("node", parent.alias("parent"), (F.size(F.split("node", r"\.")) - 1).alias("depth"), "members")


def longest_prefix(names: DataFrame, column: str, vocabulary: DataFrame, word: str) -> DataFrame:
    """The rows with `unit`: the longest word of the vocabulary that the dotted name is, or is below; NULL for none."""
    words = vocabulary.select(F.col(word).alias("unit")).distinct()
    keys = names.select(column).distinct()
    met = keys.withColumn("unit", F.explode(prefixes(F.col(column)))).join(words, "unit")
    return names.join(met.groupBy(column).agg(F.max_by("unit", F.length("unit")).alias("unit")), column, "left")
