"""The driver's tables as relations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from latticework.plans.relation import Relation

ANCHORS = {
    "region": ("r_regionkey",), "nation": ("n_nationkey",), "customer": ("c_custkey",), "supplier": ("s_suppkey",), "part": ("p_partkey",), "orders": ("o_orderkey",),
    "lineitem": ("l_orderkey", "l_linenumber"), "events": ("event_id",), "documents": ("doc_id",), "conversations": ("conv_id", "turn"), "pages": ("page_id",),
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def relation(spark: SparkSession, sf_dir: str, name: str, *columns: str, evidence: str | None = None) -> Relation:
    df = table(spark, sf_dir, name)
    return Relation.of(df.select(*columns) if columns else df, ANCHORS[name], evidence=evidence)
