"""Rules: relations rendered as findings, several parts under one name, and what a baseline leaves of them."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from latticework.plans.errors import AuthoringError, UnknownField
from latticework.plans.evidence import LEVELS
from latticework.plans.relation import EVIDENCE, Relation

SLOT = re.compile(r"\{(\w+)\}")


def rendered(template: str, types: dict[str, str]) -> Column:
    """The template with each {field} replaced; NULL reads None, booleans True and False."""
    parts, at = [], 0
    for m in SLOT.finditer(template):
        if m[1] not in types:
            raise UnknownField(f"the message reads {m[1]!r}; there are: {', '.join(sorted(types))}")
        text = F.initcap(F.col(m[1]).cast("string")) if types[m[1]] == "boolean" else F.col(m[1]).cast("string")
        parts += [F.lit(template[at : m.start()]), F.coalesce(text, F.lit("None"))]
        at = m.end()
    return F.concat(*parts, F.lit(template[at:]))


@dataclass(frozen=True)
class Part:
    relation: Relation
    message: str
    path: str
    line: str | None = None


@dataclass(frozen=True)
class Rule:
    name: str
    parts: tuple[Part, ...] = field(default_factory=tuple)

    def findings(self) -> DataFrame:
        """rule, path, line, message, confidence; all parts' rows, none merged."""
        out = None
        for p in self.parts:
            types = {c: t for c, t in p.relation.df.dtypes if c in p.relation.fields}
            line = F.col(p.line).cast("int") if p.line else F.lit(1)
            sure = F.element_at(F.array(*map(F.lit, LEVELS)), F.col(EVIDENCE).cast("int") + 1)
            rows = p.relation.df.select(F.lit(self.name).alias("rule"), F.col(p.path).cast("string").alias("path"), line.alias("line"), rendered(p.message, types).alias("message"), sure.alias("confidence"))
            out = rows if out is None else out.unionByName(rows)
        if out is None:
            raise AuthoringError(f"the rule {self.name!r} has no part")
        return out


def identity() -> Column:
    """What a finding is but for its line numbers."""
    return F.concat_ws("|", "rule", "path", F.regexp_replace("message", r"\s*\(line \d+\)", ""))


def ordered(findings: DataFrame) -> DataFrame:
    """As they are told: by path, line, rule and message."""
    return findings.orderBy("path", "line", "rule", "message")


def beyond_baseline(findings: DataFrame, baseline: DataFrame) -> DataFrame:
    """Of each identity, the last findings beyond its count in the baseline; baseline: identity, count."""
    order = W.partitionBy("identity").orderBy("path", "line", "message")
    rows = findings.withColumn("identity", identity()).join(baseline.select("identity", F.col("count").alias("_known")), "identity", "left")
    return rows.withColumn("_n", F.row_number().over(order)).where(F.col("_n") > F.coalesce("_known", F.lit(0))).drop("_n", "_known")


def fixed_since(findings: DataFrame, baseline: DataFrame) -> DataFrame:
    """Identities of which the baseline has more than there are now, and how many more."""
    now = findings.withColumn("identity", identity()).groupBy("identity").agg(F.count("*").alias("now"))
    both = baseline.join(now, "identity", "left").withColumn("fixed", F.col("count") - F.coalesce("now", F.lit(0)))
    return both.where("fixed > 0").select("identity", "fixed")
