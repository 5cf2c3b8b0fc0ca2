"""Boundaries between units of a project: imports judged by where a name comes from, a census of units, allowances that nothing uses."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from latticework.catalog.code import Code
from latticework.functions.names import module_of
from latticework.operators.layers import longest_prefix
from latticework.operators.ranking import first_by
from latticework.plans.evidence import DECLARED, HEURISTIC, all_of, not_
from latticework.plans.evidence import field as read
from latticework.plans.relation import Relation
from latticework.plans.rules import Part, Rule


@dataclass(frozen=True)
class Boundaries:
    """allow: for each unit those it may import. unconstrained: units that aren't judged. root: the package whose parts the units are;
    without one each module's first name is its root. strict: every unit must be declared.
    """

    allow: dict[str, tuple[str, ...]] = field(default_factory=dict)
    unconstrained: tuple[str, ...] = ()
    root: str | None = None
    strict: bool = True

    @property
    def declared(self) -> list[str]:
        return sorted({*self.allow, *self.unconstrained})

    @property
    def words(self) -> list[str]:
        """All units that are named: the vocabulary of longest prefixes."""
        return sorted({*self.allow, *(d for ds in self.allow.values() for d in ds), *self.unconstrained})

    def table(self, code: Code, rows: list, fields: str) -> DataFrame:
        return code.sources.sparkSession.createDataFrame(rows, fields)

    def beneath(self, module: Column, top: Column) -> Column:
        """What stands below the root; NULL for the root itself and outside it."""
        return F.when(module.startswith(F.concat(top, F.lit("."))), F.substr(module, F.length(top) + 2))

    def with_unit(self, code: Code, df: DataFrame, module: str, top: str, name: str) -> DataFrame:
        """df with the unit of a module: the longest named one that it is or is below, else its first name beneath the root."""
        rows = df.withColumn("_below", self.beneath(F.col(module), F.col(top)))
        found = longest_prefix(rows, "_below", self.table(code, [(w,) for w in self.words], "word string"), "word")
        return found.withColumn(name, F.coalesce("unit", F.substring_index("_below", ".", 1))).drop("unit", "_below")

    def files(self, code: Code) -> DataFrame:
        """file_path, module, top, importer of every file below a root."""
        top = F.lit(self.root) if self.root else F.substring_index("module", ".", 1)
        rows = code.raw["files"].where("not has_errors").select("file_path", "module").withColumn("top", top)
        return self.with_unit(code, rows, "module", "top", "importer").where("importer is not null")

    def imports(self, code: Code) -> DataFrame:
        """Imports in units that have an allow list, one row for each: dep, detail, violates, exercises. An import is charged to the unit that
        defines the name, however many packages pass it on; where that is unknown or outside the root, to the unit it is imported from.
        """
        own = self.files(code).join(self.table(code, [(u,) for u in self.allow], "importer string"), "importer")
        rows = code.symbols.where("kind in ('import', 'star')").select("file_path", "ord", "symbol_id", "name", "line", "imported_from", "import_confidence").join(own, "file_path")
        rows = rows.join(code.definitions, "symbol_id", "left").withColumn("origin", module_of(F.col("definition")))
        rows = self.with_unit(code, self.with_unit(code, rows, "imported_from", "top", "literal"), "origin", "top", "defined")
        rows = rows.withColumn("dep", F.coalesce("defined", "literal"))
        rows = rows.withColumn("detail", F.when(~F.col("defined").eqNullSafe(F.col("literal")) & F.col("defined").isNotNull(), "via re-export").otherwise("via"))
        pairs = self.table(code, [(u, d, True) for u, ds in self.allow.items() for d in ds], "importer string, dep string, allowed boolean")
        rows = rows.join(pairs, ["importer", "dep"], "left").withColumn("allowed", F.coalesce("allowed", F.lit(False)))
        crosses = F.coalesce(F.col("imported_from").isNotNull() & (F.col("dep") != F.col("importer")), F.lit(False))
        return rows.withColumn("violates", crosses & ~F.col("allowed")).withColumn("exercises", crosses & F.col("allowed")).drop("top", "origin", "allowed")

    def units(self, code: Code) -> DataFrame:
        """unit, declared, file_path, module: every unit with the file that stands for it, its __init__ or else the first."""
        if not self.strict:
            return self.table(code, [], "unit string, declared boolean, file_path string, module string, line int")
        first = first_by(self.files(code).withColumn("inner", ~F.col("file_path").endswith("__init__.py")), ["importer"], ["inner", "file_path", "module"], ["file_path", "module"])
        return first.select(F.col("importer").alias("unit"), F.col("importer").isin(self.declared).alias("declared"), "file_path", "module", F.lit(1).alias("line"))

    def allowances(self, code: Code) -> DataFrame:
        """importer, dep, exercised of every pair that is allowed."""
        pairs = self.table(code, [(u, d) for u, ds in self.allow.items() for d in ds], "importer string, dep string")
        used = self.imports(code).where("exercises").select("importer", "dep", F.lit(True).alias("exercised")).distinct()
        return pairs.join(used, ["importer", "dep"], "left").select("importer", "dep", F.coalesce("exercised", F.lit(False)).alias("exercised"), F.lit("pyproject.toml").alias("file_path"), F.lit(1).alias("line"))

    def rule(self, code: Code) -> Rule:
        """import-boundaries in three parts; without any configuration nothing is judged."""
        if not self.allow and not self.strict:
            return Rule("import-boundaries", ())
        judged = self.imports(code).withColumn("sure", F.when(F.col("import_confidence").isNotNull(), HEURISTIC).otherwise(DECLARED))
        crossing = Relation.of(judged, ("file_path", "ord"), evidence="sure").where(read("violates", "bool"))
        census = Relation.of(self.units(code), "module").where(all_of(not_(read("declared", "bool")), not_(read("unit").startswith("__"))))
        idle = Relation.of(self.allowances(code), ("importer", "dep")).where(not_(read("exercised", "bool")))
        return Rule("import-boundaries", (
            Part(crossing, "package '{importer}' may not import '{dep}' ({detail} '{imported_from}')", "file_path", "line"),
            Part(census, "package '{unit}' is not declared", "file_path", "line"),
            Part(idle, "'{importer}' may import '{dep}' but never does", "file_path", "line"),
        ))
