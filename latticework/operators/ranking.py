"""Elections, top-k texts and running attributions, as aggregates that combine before the shuffle where they can."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def first_by(df: DataFrame, keys: list[str], order: list[str], values: list[str]) -> DataFrame:
    """Of each key the row that comes first; a hot key is combined before the shuffle."""
    picked = F.min_by(F.struct(*values), F.struct(*order)).alias("_v")
    return df.groupBy(*keys).agg(picked).select(*keys, "_v.*")


def top_text(df: DataFrame, keys: list[str], order: list[str], text: Column, k: int = 3) -> DataFrame:
    """The first k texts of each key joined by commas, and how many more there are.

    Spark cuts each task's rows to k of a key before the shuffle that ranks them.
    """
    ranked = df.withColumn("_t", text).withColumn("_r", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where(F.col("_r") <= k)
    shown = ranked.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_r", "_t"))), lambda x: x["_t"]), ", ").alias("shown"))
    both = df.groupBy(*keys).agg(F.count("*").alias("n")).join(shown, keys)
    more = F.concat("shown", F.lit(" +"), (F.col("n") - k).cast("string"), F.lit(" more"))
    return both.select(*keys, "n", F.when(F.col("n") > k, more).otherwise(F.col("shown")).alias("shown"))
