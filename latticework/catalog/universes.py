"""Symbols, references, imports, modules and scopes as relations, and the named steps from one to another."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from latticework.catalog.code import Code
from latticework.plans.errors import AmbiguousAnchor, UnknownFollow, UnknownUniverse, UnresolvedAnchor
from latticework.plans.relation import Relation

#: Candidates that an error names.
CANDIDATES = 10
#: From a universe by a step to another: own fields and those there that must be equal.
STEPS = {
    ("symbols", "references"): ("references", {"file_path": "file_path", "symbol_id": "symbol_id"}),
    ("symbols", "scope"): ("scopes", {"file_path": "file_path", "scope_id": "scope_id"}),
    ("symbols", "module"): ("modules", {"file_path": "file_path"}),
    ("symbols", "definition"): ("located", {"definition": "symbol_id"}),
    ("references", "symbol"): ("symbols", {"file_path": "file_path", "symbol_id": "symbol_id"}),
    ("references", "scope"): ("scopes", {"file_path": "file_path", "scope_id": "scope_id"}),
    ("references", "definition"): ("located", {"definition": "symbol_id"}),
    ("imports", "module"): ("modules", {"file_path": "file_path"}),
    ("imports", "target"): ("located", {"definition": "symbol_id"}),
    ("modules", "symbols"): ("symbols", {"file_path": "file_path"}),
    ("modules", "scopes"): ("scopes", {"file_path": "file_path"}),
    ("modules", "imports"): ("imports", {"file_path": "file_path"}),
    ("scopes", "symbols"): ("symbols", {"file_path": "file_path", "scope_id": "scope_id"}),
    ("scopes", "parent"): ("scopes", {"file_path": "file_path", "parent_id": "scope_id"}),
}


class Universes:
    """root: only files below this folder are seen, definitions are those of all files."""

    def __init__(self, code: Code, root: str = "") -> None:
        self.code, self.root = code, root

    def table(self, name: str) -> DataFrame:
        code = self.code
        if name in ("symbols", "imports", "located"):
            df = code.symbols.join(code.definitions, "symbol_id", "left").withColumn("definition", F.coalesce("definition", "symbol_id"))
            if name == "imports":
                df = df.where("kind in ('import', 'star')")
            if name == "located":  # of each id the first declaration, in whatever file
                return df.join(code.located.select("symbol_id", "file_path"), ["symbol_id", "file_path"], "left_semi")
        elif name == "references":
            df = code.uses
        elif name == "modules":
            df = code.raw["files"]
        elif name == "scopes":
            df = code.raw["scopes"].withColumn("parent_id", F.try_element_at("chain", F.lit(2)))
        else:
            raise UnknownUniverse(f"no universe {name!r}; there are: symbols, references, imports, modules, scopes", universe=name)
        return df.where(F.col("file_path").startswith(self.root)) if self.root else df

    def __getitem__(self, name: str) -> Relation:
        anchor = {"references": ("file_path", "ord"), "modules": ("file_path",), "scopes": ("file_path", "scope_id")}.get(name, ("symbol_id", "file_path"))
        df = self.table(name)
        return Relation.of(df, anchor, ("file_path", "ord") if "ord" in df.columns else ("file_path",))

    def follow(self, relation: Relation, universe: str, step: str) -> Relation:
        """The rows that a relation of that universe leads to by the step, each once, as first reached."""
        if (universe, step) not in STEPS:
            raise UnknownFollow(f"no step {step!r} from {universe}; there are: {', '.join(s for u, s in STEPS if u == universe)}", universe=universe, step=step)
        target, on = STEPS[universe, step]
        return relation.follow(self[target], on)

    def find_symbol(self, name: str) -> Relation:
        """Symbols of that name or id, or whose id ends in it."""
        s = self["symbols"]
        n = F.lit(name)
        met = (F.col("name") == n) | (F.col("symbol_id") == n) | F.col("symbol_id").endswith(f":{name}") | F.col("symbol_id").endswith(f".{name}")
        return Relation(s.df.where(met), s.anchor, s.order, s.fields, (*s.lineage, f"find({name})"))

    def references_to_binding(self, symbol_id: str) -> DataFrame:
        """References that the binding itself is read by, in its own file's scopes."""
        return self.table("references").where(F.col("symbol_id") == symbol_id).orderBy("file_path", "ord")

    def members(self, scope_id: str) -> DataFrame:
        return self.table("symbols").where(F.col("scope_id") == scope_id).orderBy("file_path", "ord")

    def document_symbols(self, file_path: str) -> DataFrame:
        return self.table("symbols").where(F.col("file_path") == file_path).orderBy("ord")

    def anchor(self, name: str) -> str:
        """The id of the one symbol of that name; none or several is an error that names candidates."""
        found = [r["symbol_id"] for r in self.find_symbol(name).df.select("symbol_id").distinct().orderBy("symbol_id").limit(CANDIDATES + 1).collect()]
        if len(found) == 1:
            return found[0]
        if found:
            raise AmbiguousAnchor(f"{name!r} names several symbols: {', '.join(found[:CANDIDATES])}", candidates=found[:CANDIDATES])
        like = self.table("symbols").where(F.lower("name").contains(name.rpartition(":")[2].rpartition(".")[2].lower()))
        near = [r["symbol_id"] for r in like.select("symbol_id").distinct().orderBy("symbol_id").limit(CANDIDATES).collect()]
        raise UnresolvedAnchor(f"no symbol {name!r}", candidates=near)
