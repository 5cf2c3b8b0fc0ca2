"""Expressions that carry a confidence: a value column, a confidence column, and whether it matched at all.

Confidence is an INT from 0 to 3. A conjunction is as sure as its least sure part; a disjunction as its least sure
satisfied part. Values of predicates are never NULL, so `not_` can't lose rows.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field as dataclass_field

from pyspark.sql import Column
from pyspark.sql import functions as F

from latticework.functions.glob import glob_column, glob_to_regex

UNKNOWN, HEURISTIC, INFERRED, DECLARED = 0, 1, 2, 3
LEVELS = ("unknown", "heuristic", "inferred", "declared")


@dataclass(frozen=True)
class Expr:
    """value; confidence; matched (false: compares false with everything); kind of value: bool, str, num, array or any."""

    value: Column
    confidence: Column
    matched: Column
    kind: str = "any"
    op: str = "read"
    reads: tuple[str, ...] = ()
    inputs: tuple[Expr, ...] = ()
    detail: dict[str, str] = dataclass_field(default_factory=dict)

    def eq(self, other) -> Expr:
        return compare("eq", self, other, lambda a, b: a.eqNullSafe(b))

    def ne(self, other) -> Expr:
        return compare("ne", self, other, lambda a, b: ~a.eqNullSafe(b))

    def is_in(self, *values) -> Expr:
        listed = [v for v in values if v is not None]
        inside = F.coalesce(self.value.isin(*listed), F.lit(False)) if listed else F.lit(False)
        if None in values:
            inside = inside | self.value.isNull()
        return self.tested("is_in", inside, values=", ".join(map(str, values)))

    def matches(self, pattern: str | Expr) -> Expr:
        """Shell glob over the whole string; `*` crosses every character. The pattern may be each row's own; NULL matches nothing."""
        if isinstance(pattern, Expr):
            return compare("matches", self, pattern, lambda a, b: F.coalesce(F.regexp_like(a, glob_column(b)), F.lit(False)))
        return self.tested("matches", F.coalesce(self.value.rlike(glob_to_regex(pattern)), F.lit(False)), pattern=pattern)

    def startswith(self, *prefixes: str) -> Expr:
        hit = F.lit(False)
        for p in prefixes:
            hit = hit | F.coalesce(self.value.startswith(p), F.lit(False))
        return self.tested("startswith", hit, prefixes=", ".join(prefixes))

    def endswith(self, suffix: str) -> Expr:
        return self.tested("endswith", F.coalesce(self.value.endswith(suffix), F.lit(False)), suffix=suffix)

    def is_true(self) -> Expr:
        return self.tested("is_true", truthy(self))

    def is_within(self, prefix) -> Expr:
        """Equal to the dotted prefix, or below it."""
        p = constant(prefix)
        return compare("is_within", self, p, within)

    def any_other_than(self, other) -> Expr:
        o = constant(other)
        return compare("any_other_than", self, o, lambda a, b: F.coalesce(F.exists(a, lambda x: ~x.eqNullSafe(b)), F.lit(False)))

    def any_outside(self, prefix) -> Expr:
        p = constant(prefix)
        return compare("any_outside", self, p, lambda a, b: F.coalesce(F.exists(a, lambda x: ~within(x, b)), F.lit(False)))

    def attr(self, name: str) -> Expr:
        """A field of a struct; a missing struct gives NULL at no confidence."""
        return Expr(self.value.getField(name), F.when(self.value.isNull(), UNKNOWN).otherwise(self.confidence), self.matched, "any", "attr", self.reads, (self,), {"name": name})

    def at(self, level: int) -> Expr:
        """The value if it is known at exactly this level, else unmatched; the assertion itself is sure."""
        held = self.confidence == level
        return Expr(F.when(held, self.value), F.lit(DECLARED), held, self.kind, "at", self.reads, (self,), {"level": LEVELS[level]})

    def how_sure(self) -> Expr:
        return Expr(self.confidence, F.lit(DECLARED), F.lit(True), "num", "confidence", self.reads, (self,))

    def tested(self, op: str, test: Column, **detail: str) -> Expr:
        return Expr(self.matched & test, self.confidence, F.lit(True), "bool", op, self.reads, (self,), detail)

    def __and__(self, other: Expr) -> Expr:
        return all_of(self, other)

    def __or__(self, other: Expr) -> Expr:
        return any_of(self, other)

    def __invert__(self) -> Expr:
        return not_(self)


def within(value: Column, prefix: Column) -> Column:
    return F.coalesce((value == prefix) | value.startswith(F.concat(prefix, F.lit("."))), F.lit(False))


def field(name: str, kind: str = "any", confidence: str | None = None) -> Expr:
    return Expr(F.col(name), F.col(confidence).cast("int") if confidence else F.lit(DECLARED), F.lit(True), kind, "read", (name,))


def constant(value, level: int = DECLARED) -> Expr:
    if isinstance(value, Expr):
        return value
    kind = {bool: "bool", str: "str", int: "num", float: "num"}.get(type(value), "any")
    return Expr(F.lit(value), F.lit(level), F.lit(True), kind, "const", (), (), {"value": str(value)})


def opaque(op: str, function: Callable[..., Column], *inputs: Expr, kind: str = "any") -> Expr:
    """Any column function of other expressions' values."""
    return Expr(function(*(x.value for x in inputs)), meet(inputs), matched(inputs), kind, op, reads_of(inputs), inputs)


def compare(op: str, left: Expr, right, test: Callable[[Column, Column], Column]) -> Expr:
    right = constant(right)
    both = (left, right)
    return Expr(matched(both) & test(left.value, right.value), meet(both), F.lit(True), "bool", op, reads_of(both), both)


def truthy(e: Expr) -> Column:
    test = {"bool": e.value, "str": e.value != "", "num": e.value != 0, "array": F.size(e.value) > 0 if e.kind == "array" else None}.get(e.kind)
    return e.matched & F.coalesce(test if test is not None else e.value.isNotNull(), F.lit(False))


def meet(parts) -> Column:
    return F.least(*(e.confidence for e in parts)) if len(parts) > 1 else parts[0].confidence if parts else F.lit(DECLARED)


def matched(parts) -> Column:
    out = F.lit(True)
    for e in parts:
        out = out & e.matched
    return out


def reads_of(parts) -> tuple[str, ...]:
    return tuple(sorted({r for e in parts for r in e.reads}))


def all_of(*parts: Expr) -> Expr:
    value = F.lit(True)
    for e in parts:
        value = value & truthy(e)
    return Expr(value, meet(parts), F.lit(True), "bool", "all_of", reads_of(parts), parts)


def any_of(*parts: Expr) -> Expr:
    """Confidence is the least of the satisfied parts', of all parts' where none is; no parts are false."""
    value = F.lit(False)
    for e in parts:
        value = value | truthy(e)
    held = [F.when(truthy(e), e.confidence) for e in parts]
    satisfied = F.least(*held) if len(held) > 1 else held[0] if held else F.lit(None).cast("int")
    return Expr(value, F.coalesce(satisfied, meet(parts)), F.lit(True), "bool", "any_of", reads_of(parts), parts)


def not_(e: Expr) -> Expr:
    return Expr(~truthy(e), e.confidence, F.lit(True), "bool", "not", e.reads, (e,))


def weakened_when(predicate: Expr, level: int) -> Expr:
    """Always true; no surer than `level` where the predicate holds."""
    sure = F.when(truthy(predicate), F.least(predicate.confidence, F.lit(level))).otherwise(predicate.confidence)
    return Expr(F.lit(True), sure, F.lit(True), "bool", "weakened_when", predicate.reads, (predicate,), {"level": LEVELS[level]})


def why(e: Expr) -> Column:
    """The derivation as JSON text: operation, value, confidence, what it reads, and its inputs' derivations."""
    value = F.when(e.matched, F.coalesce(e.value.cast("string"), F.lit("null"))).otherwise("<unmatched>")
    own = F.to_json(F.struct(F.lit(e.op).alias("op"), value.alias("value"), F.element_at(F.array(*map(F.lit, LEVELS)), e.confidence.cast("int") + 1).alias("confidence"), F.lit(",".join(e.reads)).alias("reads")))
    inputs = F.concat_ws(",", *(why(x) for x in e.inputs)) if e.inputs else F.lit("")
    return F.concat(F.expr("''"), F.substring(own, F.lit(1), F.length(own) - 1), F.lit(',"inputs":['), inputs, F.lit("]}"))
