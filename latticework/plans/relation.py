"""Relations: DataFrames whose rows have an anchor, an order and a confidence, with the operations that keep those right."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from latticework.plans.errors import AuthoringError, DerivedField, MutationPrecondition, UnknownField, UnplannableMutation
from latticework.plans.evidence import DECLARED, UNKNOWN, Expr, truthy, why
from latticework.plans.kept import Kept

EVIDENCE = "_ev"


def fresh(df: DataFrame, name: str) -> str:
    """The name, or one behind it that no column has."""
    while name in df.columns:
        name += "_"
    return name


#: How far an expression reads: its row's own fields, or what was looked up in the whole project.
FILE, PROJECT = "file", "project"


@dataclass(frozen=True)
class Relation:
    """df: rows with the hidden column _ev. anchor: columns that name what a row is about. order: columns that order rows. fields: what later steps may read."""

    df: DataFrame
    anchor: tuple[str, ...]
    order: tuple[str, ...]
    fields: tuple[str, ...]
    lineage: tuple[str, ...] = ()
    looked_up: frozenset[str] = frozenset()

    @staticmethod
    def of(df: DataFrame, anchor: str | tuple[str, ...], order: tuple[str, ...] | None = None, evidence: str | None = None) -> Relation:
        """A base relation; evidence names a column with each row's own confidence, else rows are declared."""
        anchor = (anchor,) if isinstance(anchor, str) else tuple(anchor)
        sure = F.coalesce(F.col(evidence).cast("int"), F.lit(DECLARED)) if evidence else F.lit(DECLARED)
        return Relation(df.withColumn(EVIDENCE, sure), anchor, tuple(order or anchor), tuple(df.columns), (f"scan({', '.join(anchor)})",))

    def _known(self, *names: str) -> None:
        for n in names:
            if n not in self.fields:
                raise UnknownField(f"no field {n!r} here; there are: {', '.join(sorted(self.fields))}", field=n)

    def reach(self, e: Expr) -> str:
        return PROJECT if self.looked_up & set(e.reads) else FILE

    def where(self, e: Expr) -> Relation:
        """Rows for which the expression holds; a row is then no surer than the expression."""
        self._known(*e.reads)
        kept = self.df.where(truthy(e)).withColumn(EVIDENCE, F.least(F.col(EVIDENCE), e.confidence))
        return replace(self, df=kept, lineage=(*self.lineage, f"where({e.op})"))

    def with_field(self, name: str, e: Expr) -> Relation:
        """One more field; drops no row, and a row is then no surer than the field."""
        if name in self.fields:
            raise DerivedField(f"the field {name!r} is there already", field=name)
        self._known(*e.reads)
        df = self.df.withColumns({name: F.when(e.matched, e.value), EVIDENCE: F.least(F.col(EVIDENCE), e.confidence)})
        return replace(self, df=df, fields=(*self.fields, name), lineage=(*self.lineage, f"with_field({name})"), looked_up=self.looked_up | ({name} if self.reach(e) == PROJECT else set()))

    def with_why(self, name: str, e: Expr) -> Relation:
        """The derivation of an expression for each row, as JSON text."""
        self._known(*e.reads)
        return replace(self, df=self.df.withColumn(name, why(e)), fields=(*self.fields, name))

    def project(self, *names: str) -> Relation:
        """Later steps may read these fields only; anchor and order stay underneath."""
        self._known(*names)
        return replace(self, fields=names, lineage=(*self.lineage, f"project({', '.join(names)})"))

    def with_membership(self, name: str, key: str, members: DataFrame, kept: Kept | None = None) -> Relation:
        """A boolean field: the key is among the first column of `members`. NULL is in no set. Never adds rows. A set that others ask
        for too is stored once, where `kept` is given.
        """
        self._known(key)
        if name in self.fields:
            raise DerivedField(f"the field {name!r} is there already", field=name)
        column = members.columns[0]
        own = fresh(self.df, "_member")
        members = members.select(F.col(column).alias("member")).where("member is not null").distinct()
        members = (kept.once(members, "set") if kept else members).select(F.col("member").alias(own))
        df = self.df.join(members, F.col(key) == F.col(own), "left").withColumn(name, F.col(own).isNotNull()).drop(own)
        return replace(self, df=df, fields=(*self.fields, name), lineage=(*self.lineage, f"in_set({key})"), looked_up=self.looked_up | {name})

    def with_lookup(self, name: str, key: str, table: DataFrame, confidence: str | None = None) -> Relation:
        """Fields `name` and `name`_conf from a table of key, value (and a confidence): absent is NULL at no confidence.

        Of several rows of a key the least value counts, so that no row becomes two. The table may be about another entity than
        the row's own: any key field will do.
        """
        self._known(key)
        k, v = table.columns[:2]
        sure = F.col(confidence).cast("int") if confidence else F.lit(DECLARED)
        own = fresh(self.df, "_key")
        one = table.groupBy(F.col(k).alias(own)).agg(F.min(F.struct(F.col(v).alias("v"), sure.alias("s"))).alias("_one"))
        table = one.select(own, F.col("_one.v").alias(name), F.col("_one.s").alias(f"{name}_conf"))
        df = self.df.join(table, F.col(key) == F.col(own), "left").withColumn(f"{name}_conf", F.coalesce(f"{name}_conf", F.lit(UNKNOWN))).drop(own)
        return replace(self, df=df, fields=(*self.fields, name, f"{name}_conf"), lineage=(*self.lineage, f"lookup({name})"), looked_up=self.looked_up | {name, f"{name}_conf"})

    def follow(self, target: Relation, on: dict[str, str]) -> Relation:
        """The rows of `target` that these rows lead to, each once, as first reached in these rows' order.

        The confidence is that of the first path. Rows are first grouped by what they lead to, which combines before the
        shuffle, so that a target which very many rows reach is no single task's work.
        """
        self._known(*on)
        for c in on.values():
            target._known(c)
        keys = [F.col(c).alias(f"_on{i}") for i, c in enumerate(on)]
        mine = self.df.select(*keys, F.struct(*(F.col(c).alias(f"s{i}") for i, c in enumerate(self.order))).alias("_from"), F.col(EVIDENCE).alias("_before"))
        # The first row of each key stands for all of them: targets are then joined once, not once for each path.
        mine = mine.groupBy(*(f"_on{i}" for i in range(len(on)))).agg(F.min_by("_before", "_from").alias("_before"), F.min("_from").alias("_from"))
        rows = target.df.select(F.struct("*").alias("_row"), *(F.col(c).alias(f"_to{i}") for i, c in enumerate(on.values())))
        met = None
        for i in range(len(on)):
            same = F.col(f"_on{i}") == F.col(f"_to{i}")
            met = same if met is None else met & same
        path = mine.join(rows, met).withColumn("_at", F.struct("_from", *(F.col("_row")[c].alias(f"t{i}") for i, c in enumerate(target.order))))
        # Whole rows with a boxed order: the least path of each anchor.
        anchors = [F.col("_row")[c].alias(f"_a{i}") for i, c in enumerate(target.anchor)]
        first = path.groupBy(*anchors).agg(F.min_by("_row", "_at").alias("_row"), F.min_by("_before", "_at").alias("_before"), F.min(F.struct("_from")).alias("_reached"))
        df = first.select("_row.*", "_before").withColumn(EVIDENCE, F.least(F.col(EVIDENCE), F.col("_before"))).drop("_before")
        return Relation(df, target.anchor, target.order, target.fields, (*self.lineage, f"follow({', '.join(on.values())})"))

    def frame(self, evidence: str | None = "evidence") -> DataFrame:
        """The fields, and the confidence under that name."""
        extra = [F.col(EVIDENCE).cast("int").alias(evidence)] if evidence else []
        return self.df.select(*self.fields, *extra)


def decisions(relation: Relation, name: str, floor: int, preconditions: dict[str, Expr], origin: str = "query") -> DataFrame:
    """What becomes of a change proposed for every row: reason is '' for those that go through, else the first that fails.

    A row below the floor of confidence is refused before any precondition is looked at; intent_id names the rest.
    """
    if not name.isidentifier():
        raise UnplannableMutation(f"no change can be called {name!r}", mutation=name)
    reason = F.when(F.col(EVIDENCE) < floor, F.lit("below-floor"))
    for label, e in preconditions.items():
        if e.kind not in ("bool", "any"):
            raise MutationPrecondition(f"the precondition {label!r} isn't true or false of a row", precondition=label)
        relation._known(*e.reads)
        reason = reason.when(~truthy(e), F.lit(label))
    anchor = F.concat_ws("/", *(F.col(c).cast("string") for c in relation.anchor))
    df = relation.df.withColumn("reason", reason.otherwise(F.lit("")))
    return df.select(*relation.fields, F.col(EVIDENCE).cast("int").alias("evidence"), "reason", F.when(F.col("reason") == "", F.concat_ws(":", F.lit(origin), F.lit(name), anchor)).alias("intent_id"))
