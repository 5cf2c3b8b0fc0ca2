"""Filter interaction audit: what each filter removes under every order, from one count for each set of failed filters."""

from __future__ import annotations

from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

COUNTS = ["n", "good", "toxic"]


def failures(text: Column) -> dict[str, Column]:
    """The filters that look at one text, and when a text fails each; words are runs without white space."""
    words = F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")
    return {
        "A": F.size(words) < 50,
        "B": 100 * F.size(F.array_distinct(words)) < 65 * F.size(words),
        "C": 100 * F.length(F.regexp_replace(text, "[^A-Z]+", "")) > 5 * F.length(text),
        "D": text.rlike("[#$%&*|]"),
    }


def masks(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """part, mask, n, good, toxic: documents of each part by the set of filters they fail (bit 0: A, ..., bit 4: E), and how many
    of them `labels` calls good or toxic.

    A null text is empty, a null part the empty string; a null id is without a label, is no copy (E) and makes none. Rows repeated under
    one id count each, and are no copies of each other. An id that `labels` has several times has each label that one of its rows has.
    An empty table gives no rows; other columns' names don't matter.

    A text travels as its SHA-256. The join with the labels also settles repeated rows; rows without an id go past it. Copies within a
    part are added up before their digests meet, so that a text that a third of all rows have is one row a part and label.
    """
    text = F.coalesce(docs[text_col], F.lit(""))
    mask = sum((fails.cast("int") * (1 << i) for i, fails in enumerate(failures(F.col("text")).values())), F.lit(0))
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), F.coalesce(docs[part_col], F.lit("")).alias("part"), text.alias("text"))
    rows = rows.select("doc_id", "part", F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("digest"), mask.alias("mask"))
    known = labels.where(labels["doc_id"].isNotNull()).groupBy(labels["doc_id"].cast("long").alias("doc_id"))
    known = known.agg(F.max((F.col("quality") == 1).cast("long")).alias("good"), F.max((F.col("toxic") == 1).cast("long")).alias("toxic"))
    alike, nothing = ["digest", "part", "mask", "good", "toxic"], F.lit(0).cast("long")
    named = rows.where("doc_id IS NOT NULL").join(known, "doc_id", "left").fillna(0, ["good", "toxic"])
    named = named.groupBy("doc_id", *alike).agg(F.count("*").alias("n")).select(*alike, "n", nothing.alias("without"), F.struct("doc_id", "n").alias("first"))
    nameless = rows.where("doc_id IS NULL").select("digest", "part", "mask", nothing.alias("good"), nothing.alias("toxic"), F.lit(1).cast("long").alias("n"))
    rows = named.unionByName(nameless.select(*alike, "n", F.col("n").alias("without"), F.lit(None).cast("struct<doc_id: bigint, n: bigint>").alias("first")))
    rows = rows.groupBy(*alike).agg(F.sum("n").alias("n"), F.sum("without").alias("without"), F.min("first").alias("first"))
    least = rows.groupBy("digest").agg(F.min("first.doc_id").alias("least"))
    rows = rows.join(least, "digest")
    firsts = F.col("without") + F.when(F.col("first.doc_id") == F.col("least"), F.col("first.n")).otherwise(0)
    both = F.explode(F.array(F.struct(F.col("mask"), firsts.alias("n")), F.struct((F.col("mask") + 16).alias("mask"), (F.col("n") - firsts).alias("n"))))
    rows = rows.select("part", "good", "toxic", both.alias("both")).select("part", "both.*", "good", "toxic").where("n > 0")
    return rows.groupBy("part", "mask").agg(F.sum("n").alias("n"), *(F.sum(F.col("n") * F.col(k)).alias(k) for k in COUNTS[1:]))


def with_bit_added(values: Column, bit: int) -> Column:
    """One step of the zeta transform: to each set that has the bit, what the array has for the set without it is added."""
    return F.transform(values, lambda x, at: F.when(at.bitwiseAND(F.lit(bit)) > 0, x + F.get(values, at.bitwiseXOR(F.lit(bit)))).otherwise(x))


def orders(names: str) -> str:
    """Every order of the filters, step by step: the filter, and the sets of those before and after it, as an SQL expression."""
    rows = []
    for order in permutations(range(len(names))):
        before = 0
        for step, own in enumerate(order, 1):
            rows.append(f"struct('{''.join(names[i] for i in order)}' AS filter_order, {step} AS step, {own} AS own, {before} AS before, {before | 1 << own} AS after)")
            before |= 1 << own
    return f"array({', '.join(rows)})"


def audit(counts: DataFrame, names: str = "ABCDE") -> DataFrame:
    """What every filter does at its step of every order, for each part of `counts` (part, mask, n, good, toxic; masks distinct).

    A part's counts by mask (at most 2 ** len(names)) become sums over subsets; those of the complement of a set of filters are what
    survives the set, and each step is the difference of two of them. shapley: what the filter removes, over all orders together.
    """
    k, full = len(names), (1 << len(names)) - 1
    by_mask = F.map_from_entries(F.collect_list(F.struct("mask", F.struct(*COUNTS))))
    rows = counts.groupBy("part").agg(by_mask.alias("by_mask"))
    for c in COUNTS:
        known = F.transform_values("by_mask", lambda _, v: v.getField(c))  # noqa: B023
        rows = rows.withColumn("known", known).withColumn(c, F.transform(F.sequence(F.lit(0), F.lit(full)), lambda m: F.coalesce(F.try_element_at("known", m), F.lit(0).cast("long"))))
        for i in range(k):
            rows = rows.withColumn(c, with_bit_added(F.col(c), 1 << i))
    left = lambda c, gone: F.get(F.col(c), F.lit(full) - gone)
    removed_by = []
    for i in range(k):
        rest = [s for s in range(full + 1) if not s >> i & 1]
        removed_by.append(sum((factorial(s.bit_count()) * factorial(k - 1 - s.bit_count()) * (left("n", F.lit(s)) - left("n", F.lit(s | 1 << i))) for s in rest), F.lit(0).cast("long")))
    rows = rows.withColumn("removed_by", F.array(*removed_by))
    rows = rows.select("part", *COUNTS, "removed_by", F.explode(F.expr(orders(names))).alias("o")).select("part", *COUNTS, "removed_by", "o.*")
    lost = lambda c: left(c, F.col("before")) - left(c, F.col("after"))
    bit = F.col("after") - F.col("before")
    fails = left("n", F.lit(0)) - left("n", bit)
    alone = left("n", F.lit(full) - bit) - left("n", F.lit(full))
    return rows.select(
        "part", "filter_order", "step", left("n", F.col("after")).alias("kept"), lost("n").alias("removed"), (fails - lost("n")).alias("redundant"),
        alone.alias("unique_fails"), lost("good").alias("good_lost"), lost("toxic").alias("toxic_lost"), F.get(F.col("removed_by"), F.col("own")).alias("shapley"),
    )


def filter_audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The audit of the five filters over `docs`, see `masks` for rows and texts."""
    return audit(masks(docs, labels))
