"""New names for symbols, refused where they would change what a name means: joins of references' scope chains with what those scopes declare."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from latticework.catalog.code import Code
from latticework.functions.names import is_identifier

#: Reasons in the order in which they are looked at.
REASONS = ("symbol-resolves-uniquely", "new-name-differs", "valid-identifier", "no-scope-name-conflict", "captured-by-inner-scope", "captures-outer-name")


def conflicts(code: Code, proposals: DataFrame) -> DataFrame:
    """symbol_id, new_name, reason (one of REASONS, or '' for names that go through) of every proposal (symbol_id, new_name).

    captured-by-inner-scope: between a reference of the symbol and its own scope, a scope declares the new name, so that
    the reference would read that one. captures-outer-name: where the symbol is seen, the new name is read from a scope further
    out, or is a builtin, and would be read from the symbol. Repeated proposals are judged each; NULL is no symbol and no name.
    """
    rows = proposals.select("symbol_id", "new_name").withColumn("_id", F.monotonically_increasing_id())
    known = code.symbols.groupBy("symbol_id").agg(F.count("*").alias("times"), F.min("file_path").alias("file_path"), F.min("scope_id").alias("scope_id"), F.min("name").alias("name"))
    asked = rows.join(known, "symbol_id", "left")
    declared = code.symbols.where("kind <> 'star'").select("file_path", F.col("scope_id").alias("scope"), F.col("name").alias("new_name")).distinct()
    one = asked.where("times = 1").select("_id", "symbol_id", "new_name", "file_path", "scope_id")
    same = one.join(declared.withColumnRenamed("scope", "scope_id"), ["file_path", "scope_id", "new_name"], "left_semi").select("_id", F.lit("no-scope-name-conflict").alias("what"))
    plain = code.refs.where("not startswith(kind, 'attribute-')").select("file_path", "ord", "name", "chain", "bound")
    # The scopes from each reference outwards to the one that the symbol is declared in.
    met = one.join(plain.select("file_path", "ord", "chain", F.col("bound").alias("symbol_id")), ["file_path", "symbol_id"])
    between = met.select("_id", "file_path", "new_name", F.explode(F.slice("chain", F.lit(1), F.array_position("chain", F.col("scope_id")).cast("int") - 1)).alias("scope"))
    inner = between.join(declared, ["file_path", "scope", "new_name"], "left_semi").select("_id", F.lit("captured-by-inner-scope").alias("what"))
    # References to the new name from at or below the symbol's scope that are bound further out, or to nothing in the file.
    others = one.join(plain.select("file_path", "chain", F.col("name").alias("new_name"), "bound"), ["file_path", "new_name"])
    others = others.withColumn("at", F.array_position("chain", F.col("scope_id"))).where("at > 0")
    owner = code.symbols.groupBy("file_path", F.col("symbol_id").alias("bound")).agg(F.min("scope_id").alias("bound_scope"))
    others = others.join(owner, ["file_path", "bound"], "left").withColumn("from", F.array_position("chain", F.col("bound_scope")))
    outer = others.where("bound is null or from > at").select("_id", F.lit("captures-outer-name").alias("what"))
    found = same.unionByName(inner).unionByName(outer).groupBy("_id").agg(F.min(F.array_position(F.array(*map(F.lit, REASONS)), F.col("what"))).alias("first"))
    out = asked.join(found, "_id", "left")
    reason = F.when(F.coalesce("times", F.lit(0)) != 1, REASONS[0]).when(F.col("new_name") == F.col("name"), REASONS[1]).when(~is_identifier(F.col("new_name")), REASONS[2])
    return out.select("symbol_id", "new_name", reason.when(F.col("first").isNotNull(), F.element_at(F.array(*map(F.lit, REASONS)), F.col("first").cast("int"))).otherwise(F.lit("")).alias("reason"))
