"""The queries of the operators, each over its whole table, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from latticework.llm import additive, audit, fingerprint, htmltext, jaccard, langid, packing, pieces, quality, sharding, spelling, substrings, toxicity
from latticework.llm.common import held_out, table
from latticework.llm.oracles import oracle_sql  # noqa: F401


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.shuffle_into_shards(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", held_out().alias("held_out"), "score", "predicted", "evidence", "similarity")


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_join(table(spark, sf_dir, "documents"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = langid.identify(docs, langid.learn(langid.teaching(docs)))
    return out.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pieces.coded(table(spark, sf_dir, "documents"))
    return out.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_ids"), F.crc32("ids").alias("ids_crc32"), F.crc32(F.col("decoded").cast("binary")).alias("decoded_crc32"), "exact")


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substrings.dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op7_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fingerprint.edited_and_next(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_chars", F.sha2(F.col("edited_text").cast("binary"), 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint", "near_edited", "near_next")


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = packing.packed(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op9_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmltext.extract(table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(table(spark, sf_dir, "documents"))


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_variants(table(spark, sf_dir, "documents"))


def op12_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = additive.classified(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", held_out().alias("held_out"), "score", "predicted")


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.filter_audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_sharding": op1_sharding,
        "op2_toxicity": op2_toxicity,
        "op3_jaccard_join": op3_jaccard_join,
        "op4_language_id": op4_language_id,
        "op5_sentencepiece": op5_sentencepiece,
        "op6_suffix_dedup": op6_suffix_dedup,
        "op7_fingerprints": op7_fingerprints,
        "op8_packing": op8_packing,
        "op9_html_extraction": op9_html_extraction,
        "op10_quality": op10_quality,
        "op11_spelling": op11_spelling,
        "op12_quality_model": op12_quality_model,
        "op13_filter_audit": op13_filter_audit,
    }
