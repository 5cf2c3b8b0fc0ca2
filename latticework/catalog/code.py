"""Code intelligence: names bound across scopes and files by joins, facts by fixpoints, rules as relations."""

from __future__ import annotations

from dataclasses import dataclass
from dataclasses import field as field_
from dataclasses import replace
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from latticework.catalog.members import all_members, containers, mutations, received
from latticework.functions.docstrings import documented
from latticework.functions.effects import Policy, impure_method
from latticework.functions.names import bare_type, conforms, forward_names, package_under, visibility
from latticework.operators.graph import affected, ancestry, chased, strong_components
from latticework.operators.intervals import innermost
from latticework.operators.ranking import first_by, top_text
from latticework.plans.evidence import HEURISTIC, all_of, any_of, field, not_, weakened_when
from latticework.plans.kept import Kept
from latticework.plans.relation import Relation
from latticework.plans.rules import Part, Rule
from latticework.sources.python_code import code_tables
from latticework.sources.shared import stored

#: Dynamic look-ups, builtin names, methods that change a list, decorators that promise a pure function.
DYNAMIC = ("getattr", "globals", "vars", "locals")
BUILTINS = tuple(sorted(n for n in dir(__builtins__ if not isinstance(__builtins__, dict) else __import__("builtins")) if not n.startswith("_"))) + ("__name__", "__file__", "__doc__")
LIST_MUTATORS = ("append", "extend", "insert", "remove", "pop", "clear", "sort", "reverse")
PURE_DECORATORS = ("functools.lru_cache", "lru_cache", "functools.cache", "cache", "property", "cached_property", "functools.cached_property")


@dataclass(frozen=True)
class Code:
    """The tables of a set of sources (path, content), each built when it is asked for."""

    sources: DataFrame
    kept: Kept = field_(default_factory=Kept, compare=False, repr=False)
    policy: Policy = field_(default_factory=Policy)

    @cached_property
    def raw(self) -> dict[str, DataFrame]:
        return code_tables(self.sources)

    @cached_property
    def symbols(self) -> DataFrame:
        """One row for each declaration; the second and later of a name in a scope are marked $2, $3. Stored: every rule reads them."""
        order = W.partitionBy("file_path", "scope_id", "name").orderBy("ord")
        n = F.row_number().over(order)
        apart = F.when(F.col("scope_kind") == "module", ":").otherwise(".")
        base = F.concat("scope_id", apart, "name")
        df = self.raw["declared"].withColumn("n", n).withColumn("symbol_id", F.when(F.col("n") > 1, F.concat(base, F.lit("$"), F.col("n").cast("string"))).otherwise(base))
        df = df.join(self.raw["files"].select("file_path", "module"), "file_path")
        df = df.select("file_path", "ord", "symbol_id", "name", "kind", visibility(F.col("name")).alias("visibility"), "line", "scope_id", "scope_kind", "docstring", "decorators", "annotation", "annotation_confidence", "imported_from", "import_confidence", "parameters", "module", (F.col("scope_kind") == "module").alias("is_module_level"))
        return stored(df, "code-symbols")

    @cached_property
    def located(self) -> DataFrame:
        """Of each symbol id the first declaration, by path."""
        return first_by(self.symbols, ["symbol_id"], ["file_path", "ord"], ["file_path", "name", "kind", "visibility", "module", "line", "scope_kind"])

    @cached_property
    def refs(self) -> DataFrame:
        """References bound to the innermost scope that declares their name; else to a builtin, else unresolved."""
        r = self.raw["refs"].where("kind <> 'imports'")
        plain = r.where("not startswith(kind, 'attribute-')")
        seen = plain.select("file_path", "ord", "name", F.posexplode("chain").alias("depth", "scope"))
        names = self.symbols.where("kind <> 'star'").select("file_path", F.col("scope_id").alias("scope"), "name", F.col("symbol_id").alias("bound"), F.col("kind").alias("bound_kind"), F.col("ord").alias("bound_ord"))
        bound = first_by(seen.join(names, ["file_path", "scope", "name"]), ["file_path", "ord"], ["depth", "bound_ord"], ["bound", "bound_kind"])
        root = self.raw["refs"].where("receiver is not null").select("file_path", "ord", F.col("receiver")[0].alias("name"), F.posexplode("chain").alias("depth", "scope"))
        rooted = first_by(root.join(names, ["file_path", "scope", "name"]), ["file_path", "ord"], ["depth", "bound_ord"], ["bound", "bound_kind"])
        rooted = rooted.select("file_path", "ord", F.col("bound").alias("root_id"), F.col("bound_kind").alias("root_kind"))
        attribute = F.startswith(F.col("kind"), F.lit("attribute-"))
        builtin = F.col("name").isin(*BUILTINS)
        df = r.join(bound, ["file_path", "ord"], "left").join(rooted, ["file_path", "ord"], "left").join(self.raw["files"].select("file_path", "module"), "file_path")
        symbol = F.when(attribute, F.concat(F.lit("<unresolved>."), "name")).when(F.col("bound").isNotNull(), F.col("bound")).when(builtin, F.concat(F.lit("<builtins>."), "name")).otherwise(F.col("name"))
        return df.withColumn("symbol_id", symbol).withColumn("resolved", ~attribute & (F.col("bound").isNotNull() | builtin))

    @cached_property
    def definitions(self) -> DataFrame:
        """symbol_id, definition: where each import leads at last, through any number of re-exports."""
        imports = self.symbols.where("kind = 'import'").select("symbol_id", "imported_from").distinct()
        imports = first_by(imports, ["symbol_id"], ["imported_from"], ["imported_from"])
        modules = self.raw["files"].select(F.col("module").alias("target")).distinct()
        whole = imports.join(modules, F.col("imported_from") == F.col("target"), "left")
        member = F.concat(F.regexp_replace("imported_from", r"\.[^.]*$", ""), F.lit(":"), F.substring_index("imported_from", ".", -1))
        known = self.symbols.where("is_module_level").select(F.col("symbol_id").alias("member")).distinct()
        steps = whole.withColumn("wanted", member).join(known, F.col("wanted") == F.col("member"), "left")
        steps = steps.select(F.col("symbol_id").alias("name"), F.coalesce("target", "member").alias("target")).where("target is not null")
        return stored(chased(steps).select(F.col("name").alias("symbol_id"), F.col("final").alias("definition")), "code-definitions")

    @cached_property
    def uses(self) -> DataFrame:
        """References with what they mean in the end: definition, and for module.attribute the attribute's symbol."""
        d = self.definitions
        direct = self.refs.join(d, "symbol_id", "left").withColumn("definition", F.coalesce("definition", "symbol_id"))
        both = direct.join(received(self.refs, self.members, self.containers, d), ["file_path", "ord"], "left")
        return stored(both.withColumn("definition", F.coalesce("through", "definition")).drop("through"), "code-uses")

    @cached_property
    def members(self) -> DataFrame:
        """container, name, member, own: what classes and modules declare, and what classes inherit."""
        return stored(all_members(self.symbols, self.ancestors), "code-members")

    @cached_property
    def containers(self) -> DataFrame:
        """symbol_id, container, sure: under what the attributes of a symbol are found."""
        return stored(containers(self.symbols, self.located, self.definitions, self.raw["files"], self.members), "code-containers")

    @cached_property
    def mutations(self) -> DataFrame:
        """symbol_id and three flags of each variable: written to, changed by a method, read where it may go on."""
        return stored(mutations(self.symbols, self.uses, LIST_MUTATORS), "code-mutations")

    @cached_property
    def call_sites(self) -> DataFrame:
        """Of everything that is called: n_calls, any_used, escapes (it is also read as a value), and the first three sites."""
        calls = self.uses.where("kind in ('call', 'attribute-call')").select(F.col("definition").alias("symbol_id"), "file_path", "line", "ord", "used")
        passed = self.uses.where("kind in ('read', 'attribute-read')").select(F.col("definition").alias("symbol_id"), F.lit(True).alias("escapes")).distinct()
        used = calls.groupBy("symbol_id").agg(F.bool_or("used").alias("any_used"))
        sites = top_text(calls, ["symbol_id"], ["file_path", "ord"], F.concat("file_path", F.lit(":"), F.col("line").cast("string")))
        out = sites.join(used, "symbol_id").join(passed, "symbol_id", "left")
        return out.select("symbol_id", F.col("n").alias("n_calls"), "any_used", F.coalesce("escapes", F.lit(False)).alias("escapes"), "shown")

    @cached_property
    def inline_scopes(self) -> DataFrame:
        """owner, scope_id, file_path: the scopes that run when a function does, its own and those below that are in no function or lambda of their own."""
        scopes = self.raw["scopes"].select("file_path", "scope_id", "kind", F.posexplode("chain").alias("depth", "at"))
        runs = self.raw["scopes"].where("kind in ('function', 'lambda')").select("file_path", F.col("scope_id").alias("at"), F.col("kind").alias("runs")).distinct()
        first = first_by(scopes.join(runs, ["file_path", "at"]), ["file_path", "scope_id"], ["depth"], ["at", "runs"])
        return first.where("runs = 'function'").select(F.col("at").alias("owner"), "scope_id", "file_path")

    @cached_property
    def file_flags(self) -> DataFrame:
        """Of each file that can be read: has_all, dynamic_access (it looks names up as it runs)."""
        listed = self.symbols.where("name = '__all__'").select("file_path", F.lit(True).alias("has_all")).distinct()
        dynamic = self.refs.where("kind = 'call'").where(F.col("name").isin(*DYNAMIC)).select("file_path", F.lit(True).alias("dynamic_access")).distinct()
        out = self.raw["files"].where("not has_errors").select("file_path", "module").join(listed, "file_path", "left").join(dynamic, "file_path", "left")
        return out.fillna(False, ["has_all", "dynamic_access"])

    @cached_property
    def importers(self) -> DataFrame:
        """Every import with what it means in the end: definition, symbol_id, file_path, line."""
        return self.symbols.where("kind = 'import'").select("symbol_id", "file_path", "line").join(self.definitions, "symbol_id")

    def references_to(self, definitions: DataFrame) -> DataFrame:
        """Uses of the given definitions (one column), and how each gets there: direct, import_alias, barrel, receiver_declared (by types that
        are written, or by none) or receiver_inferred (by a type that what is assigned tells).
        """
        wanted = definitions.select(F.col(definitions.columns[0]).alias("definition")).distinct()
        passed = self.symbols.where("kind = 'import' and file_path like '%__init__.py'").join(self.definitions, "symbol_id").select("definition", F.lit(True).alias("in_barrel")).distinct()
        found = self.uses.join(wanted, "definition").join(passed, "definition", "left")
        named = self.symbols.where("kind = 'import'").select(F.col("symbol_id").alias("bound"), "imported_from").distinct()
        found = found.join(first_by(named, ["bound"], ["imported_from"], ["imported_from"]), "bound", "left")
        straight = F.concat(F.regexp_replace("imported_from", r"\.[^.]*$", ""), F.lit(":"), F.substring_index("imported_from", ".", -1))
        receiver = F.when(F.coalesce("within", F.lit(False)), "direct").when(F.col("sure"), "receiver_declared").otherwise("receiver_inferred")
        how = F.when(F.col("symbol_id") == F.col("definition"), "direct").when(F.col("kind").startswith("attribute-"), receiver).when(F.col("in_barrel") & (straight != F.col("definition")), "barrel").otherwise("import_alias")
        return found.select("definition", "file_path", "line", "kind", how.alias("how"))

    def visible_at(self, places: DataFrame) -> DataFrame:
        """The names that can be read at each place (file_path, line): of each name the innermost scope's first declaration."""
        scopes = self.raw["scopes"].select("file_path", "scope_id", "chain", "start_line", "end_line")
        at = innermost(places.select("file_path", "line"), scopes, "file_path", "line", "start_line", "end_line", "scope_id")
        top = self.raw["files"].select("file_path", "module")
        at = at.join(top, "file_path").withColumn("scope_id", F.coalesce("innermost", "module"))
        chain = at.join(scopes.select("file_path", "scope_id", "chain"), ["file_path", "scope_id"]).select("file_path", "line", F.posexplode("chain").alias("depth", "scope_id"))
        kinds = self.raw["scopes"].select("file_path", "scope_id", F.col("kind").alias("scope"))
        chain = chain.join(kinds, ["file_path", "scope_id"]).where("depth = 0 or scope <> 'class'")
        names = self.symbols.where("kind <> 'star'").select("file_path", "scope_id", "name", "symbol_id", "ord")
        return first_by(chain.join(names, ["file_path", "scope_id"]), ["file_path", "line", "name"], ["depth", "ord"], ["symbol_id"])

    @cached_property
    def bases(self) -> DataFrame:
        """a is a class, b one of its bases, by its definition where that is among the sources, else by its text."""
        told = self.symbols.where("kind = 'class'").select(F.col("symbol_id").alias("a"), "file_path", F.explode("parameters").alias("text"))
        told = told.withColumn("root", F.substring_index("text", ".", 1)).withColumn("rest", F.when(F.col("text").contains("."), F.expr("substring(text, length(root) + 2)")))
        names = first_by(self.symbols.where("is_module_level and kind in ('import', 'class')"), ["file_path", "name"], ["ord"], ["symbol_id"]).withColumnRenamed("name", "root")
        found = told.join(names, ["file_path", "root"], "left").join(self.definitions, "symbol_id", "left")
        meant = F.coalesce("definition", "symbol_id")
        return found.select("a", F.when(meant.isNull(), F.col("text")).when(F.col("rest").isNotNull(), F.concat_ws(":", meant, F.col("rest"))).otherwise(meant).alias("b")).distinct()

    @cached_property
    def ancestors(self) -> DataFrame:
        """node, ancestor, depth of classes."""
        return ancestry(self.bases)

    @cached_property
    def descendants(self) -> DataFrame:
        """node, descendant, depth of classes."""
        return self.ancestors.select(F.col("ancestor").alias("node"), F.col("node").alias("descendant"), "depth")

    @cached_property
    def open_classes(self) -> DataFrame:
        """Classes of whose ancestors one is not among the sources, so that what they inherit isn't known: node."""
        known = self.located.where("kind = 'class'").select(F.col("symbol_id").alias("ancestor"))
        return self.ancestors.join(known, "ancestor", "left_anti").select("node").distinct()

    @cached_property
    def overrides(self) -> DataFrame:
        """Methods and the nearest ancestors' methods of that name."""
        methods = self.symbols.where("kind = 'method'").select(F.col("scope_id").alias("node"), "name", F.col("symbol_id").alias("method")).distinct()
        above = methods.select(F.col("node").alias("ancestor"), "name", F.col("method").alias("overridden"))
        met = methods.join(self.ancestors, "node").join(above, ["ancestor", "name"])
        return first_by(met, ["method"], ["depth", "overridden"], ["overridden"])

    @cached_property
    def calls(self) -> DataFrame:
        """Edges of the call graph: a, b."""
        made = self.uses.where("kind in ('call', 'attribute-call') and function_id is not null")
        return made.join(self.located.where("kind in ('function', 'method')").select(F.col("symbol_id").alias("definition")), "definition").select(F.col("function_id").alias("a"), F.col("definition").alias("b")).where("a <> b").distinct()

    @cached_property
    def observations(self) -> DataFrame:
        """What makes a function impure by itself: function_id, what, line, unsure (the receiver's kind isn't known)."""
        u = self.uses.where("function_id is not null")
        seen = lambda df, what, unsure=None: df.select("function_id", what.alias("what"), "line", (F.lit(False) if unsure is None else unsure).alias("unsure"))
        builtin = u.where(F.col("kind") == "call").where(F.col("name").isin(*self.policy.builtins) & F.col("bound").isNull())  # by a name that nothing in the file binds
        # What an import's name stands for, then the attributes behind it: the library's own name of what is called.
        imported = first_by(self.symbols.where("kind = 'import'"), ["symbol_id"], ["imported_from"], ["imported_from"])
        imported = imported.select(F.col("symbol_id").alias("import_id"), F.col("imported_from").alias("source"))
        calls = u.where("kind in ('call', 'attribute-call')").withColumn("import_id", F.when(F.col("kind") == "call", F.col("bound")).otherwise(F.col("root_id"))).join(imported, "import_id")
        rest = F.when(F.col("kind") == "call", F.array().cast("array<string>")).otherwise(F.concat(F.slice("receiver", 2, 1 << 20), F.array("name")))
        library = calls.withColumn("called", F.concat_ws(".", "source", F.array_join(rest, "."))).withColumn("called", F.regexp_replace("called", r"\.$", ""))
        library = library.where(F.col("called").isin(*self.policy.functions))
        rebound = u.where("kind = 'global'")
        written = u.where("kind = 'attribute-write' and root_kind in ('parameter', 'import')").where("receiver[0] not in ('self', 'cls')")
        types = first_by(self.symbols.where("annotation is not null"), ["symbol_id"], ["ord"], ["annotation"]).select(F.col("symbol_id").alias("root_id"), bare_type(F.col("annotation")).alias("receiver_type"))
        methods = u.where("kind = 'attribute-call'").join(types, "root_id", "left")
        kind = F.when(F.col("receiver")[0].isin("self", "cls"), "self").when(F.size("receiver") > 1, "unknown").otherwise(F.coalesce("root_kind", F.lit("unknown")))
        methods = methods.withColumn("receiver_kind", kind).where(F.coalesce("root_kind", F.lit("")) != "import").where(impure_method(F.col("name"), F.when(F.size("receiver") == 1, F.col("receiver_type")), F.col("receiver_kind"), self.policy))
        out = seen(builtin, F.concat(F.lit("builtin "), "name")).unionByName(seen(library, F.col("called"))).unionByName(seen(rebound, F.concat(F.lit("global "), "name")))
        return out.unionByName(seen(written, F.concat(F.lit("writes ."), "name"))).unionByName(seen(methods, F.concat(F.lit("method ."), "name"), F.col("receiver_kind") == "unknown"))

    @cached_property
    def stars(self) -> DataFrame:
        """Star imports with indexed (the module is among the sources), alone (in its file), used_names and name_count: each name
        that nothing in the file binds goes to the first star, in the file's order, whose module declares it in public.
        """
        files = self.raw["files"].groupBy("module").agg(F.max("file_path").alias("path"))  # of two files of one module the last
        star = self.symbols.where("kind = 'star'").withColumn("alone", F.count("*").over(W.partitionBy("file_path")) == 1)
        star = star.join(files.select(F.col("module").alias("imported_from"), F.col("path").alias("target")), "imported_from", "left").withColumn("indexed", F.col("target").isNotNull())
        surface = self.symbols.where("is_module_level and kind <> 'star' and not startswith(name, '_')").select(F.col("file_path").alias("target"), "name").distinct()
        loose = self.refs.where("not resolved and not startswith(kind, 'attribute-') and kind not in ('global', 'nonlocal') and not startswith(name, '_')").select("file_path", "name").distinct()
        met = star.where("indexed").select("file_path", "ord", "target").join(loose, "file_path").join(surface, ["target", "name"])
        first = met.groupBy("file_path", "name").agg(F.min("ord").alias("ord"))
        names = first.groupBy("file_path", "ord").agg(F.array_sort(F.collect_set("name")).alias("names"))
        out = star.join(names, ["file_path", "ord"], "left").withColumn("names", F.coalesce("names", F.array().cast("array<string>")))
        return out.withColumn("used_names", F.array_join("names", ", ")).withColumn("name_count", F.size("names")).drop("names", "target")

    @cached_property
    def rebinds(self) -> DataFrame:
        """Variables of a module that a function binds by `global`, with the innermost function around: function_id. Those in a lambda have none."""
        scopes = self.raw["scopes"].where("kind in ('function', 'lambda')").select("file_path", "scope_id", "start_line", "end_line")
        bound = self.symbols.where("kind = 'variable' and is_module_level").select("file_path", "ord", "symbol_id", "name", "line")
        at = innermost(bound, scopes, "file_path", "line", "start_line", "end_line", "scope_id").where("innermost is not null")
        owners = self.symbols.where("kind in ('function', 'method')").select("file_path", F.col("symbol_id").alias("function_id")).distinct()
        return at.withColumnRenamed("innermost", "function_id").join(owners, ["file_path", "function_id"])

    @cached_property
    def impure(self) -> DataFrame:
        """function, depth: impure functions, and how many calls away the effect is."""
        return affected(self.calls, self.observations.select("function_id")).select(F.col("node").alias("function"), "depth")

    @cached_property
    def module_imports(self) -> DataFrame:
        """a imports b as it is loaded, both among the sources: with the first file and line."""
        wanted = self.raw["refs"].where("kind = 'imports' and at_import").join(self.raw["files"].select("file_path", F.col("module").alias("a")), "file_path")
        modules = self.raw["files"].select(F.col("module").alias("b")).distinct()
        return first_by(wanted.join(modules, F.col("name") == F.col("b")), ["a", "b"], ["file_path", "line"], ["file_path", "line"])

    @cached_property
    def elsewhere(self) -> DataFrame:
        """definition, module, file_path: what is used, each once for a file."""
        return self.kept.once(self.uses.where("kind <> 'write'").select("definition", "module", "file_path").distinct(), "used-where")

    @cached_property
    def passed(self) -> DataFrame:
        """The imports of packages' __init__ files, with what they mean in the end."""
        return self.symbols.where("kind = 'import' and file_path like '%__init__.py'").join(self.definitions, "symbol_id")

    @cached_property
    def cycles(self) -> DataFrame:
        """node, component of modules that import each other."""
        return strong_components(self.module_imports.select("a", "b"))

    def relation(self, df: DataFrame, anchor: str = "symbol_id") -> Relation:
        return Relation.of(df, anchor, ("file_path", "ord") if "ord" in df.columns else None)


def over_exposed_export(code: Code, library: bool = False, public_roots: tuple[str, ...] = ()) -> Rule:
    """What a package's __init__ passes on and nobody outside the package uses. library and public_roots as in rules()."""
    inside = code.kept.once(code.passed.where(F.col("definition").startswith(F.concat(F.col("module"), F.lit(".")))), "exports")
    users = code.elsewhere.select("definition", F.col("module").alias("user")).distinct()
    outside = inside.select("definition", F.col("module").alias("owner")).join(users, "definition").where((F.col("user") != F.col("owner")) & ~F.col("user").startswith(F.concat("owner", F.lit(".")))).select(F.concat_ws("|", "owner", "definition").alias("key")).distinct()
    if library:
        within = F.lit(not public_roots)
        for root_ in public_roots:
            within = within | (F.col("module") == root_) | F.col("module").startswith(f"{root_}.")
        inside = inside.join(code.passed.where(within).select("definition").distinct(), "definition", "left_anti")
    exported = Relation.of(inside.withColumn("key", F.concat_ws("|", "module", "definition")), "symbol_id", ("file_path", "ord")).with_membership("outside", "key", outside)
    return Rule("over-exposed-export", (Part(exported.where(not_(field("outside", "bool"))), "'{name}' is exported by {module} but not used outside it", "file_path", "line"),))


def rules(code: Code, root: str | None = None, allow: dict[str, list[str]] | None = None, recorded: DataFrame | None = None, complete_docstrings: bool = False, library: bool = False, public_roots: tuple[str, ...] = ()) -> dict[str, Rule]:
    """The rules by name. root and allow: the package whose parts may import only what is allowed. recorded: public
    symbols known before (symbol_id), which arms the rule on new ones. complete_docstrings: all parameters must be told.
    library: what the packages below public_roots (or all packages) export is for others, and never over-exposed.
    """
    s = code.relation(code.symbols)
    callable_ = field("kind").is_in("function", "class", "method")
    public = field("visibility").eq("public")
    out = {"require-docstrings": Rule("require-docstrings", (Part(s.where(all_of(callable_, public, field("docstring").eq(None))), "{kind} '{name}' has no docstring", "file_path", "line"),))}

    dunder = field("name").startswith("__") & field("name").endswith("__")
    named = s.where(field("kind").is_in("function", "class", "method")).where(not_(dunder))
    stripped = F.regexp_replace("name", "^_+", "")
    upper = (F.col("kind") == "variable") & F.col("is_module_level") & stripped.rlike("^[A-Z][A-Z0-9_]*$")
    odd = named.df.where((stripped != "") & ~conforms(stripped, F.col("kind")) & ~upper)
    out["naming-conventions"] = Rule("naming-conventions", (Part(Relation(odd, named.anchor, named.order, named.fields), "{kind} '{name}' breaks the naming convention", "file_path", "line"),))

    r = code.relation(code.uses, "file_path")
    missing = r.where(all_of(not_(field("resolved", "bool")), not_(field("symbol_id").startswith("<unresolved>.")), field("kind").is_in("read", "call")))
    out["no-unresolved-refs"] = Rule("no-unresolved-refs", (Part(missing, "'{name}' is not defined", "file_path", "line"),))

    kept = code.kept
    dynamic = code.uses.where(F.col("name").isin(*DYNAMIC)).where("kind = 'call'").select("module")
    bound = code.refs.where("bound is not null and kind <> 'write'").select(F.col("bound").alias("used")).union(code.refs.where("root_id is not null").select("root_id"))
    # A file with __all__ passes its imports on by their names' texts; a dotted import binds no name of its own; quoted annotations read names.
    listed = code.symbols.where("name = '__all__'").select("file_path").distinct()
    quoted = code.symbols.where("annotation is not null").select("file_path", F.explode(forward_names(F.col("annotation"))).alias("name")).distinct()
    dotted = code.raw["refs"].where("kind = 'imports' and contains(name, '.')").select("file_path", "line", F.substring_index("name", ".", 1).alias("imported_from")).distinct()
    imports = code.symbols.where("kind = 'import' and not file_path like '%__init__.py' and not startswith(imported_from, '__future__') and import_confidence is null")
    imports = imports.join(listed, "file_path", "left_anti").join(quoted, ["file_path", "name"], "left_anti").join(dotted, ["file_path", "line", "imported_from"], "left_anti")
    unused = code.relation(imports).with_membership("used", "symbol_id", bound).with_membership("dynamic", "module", dynamic, kept)
    unused = unused.where(not_(field("used", "bool"))).where(weakened_when(field("dynamic", "bool"), HEURISTIC))
    out["unused-imports"] = Rule("unused-imports", (Part(unused, "'{name}' is imported but unused", "file_path", "line"),))

    elsewhere = code.elsewhere
    exports = code.symbols.where("kind = 'import' and file_path like '%__init__.py'").join(code.definitions, "symbol_id").select("definition").distinct()
    base = code.symbols.where("is_module_level and kind in ('function', 'class') and name <> 'main' and not file_path like '%__main__.py'")
    candidates = code.relation(base).with_membership("referenced", "symbol_id", elsewhere.select("definition")).with_membership("exported", "symbol_id", exports).with_membership("dynamic", "module", dynamic, kept)
    candidates = candidates.where(all_of(public, not_(field("exported", "bool"))))
    candidates = replace(candidates, df=kept.once(candidates.df, "candidates"))
    dead = candidates.where(not_(field("referenced", "bool"))).where(weakened_when(field("dynamic", "bool"), HEURISTIC))
    out["unused-public-symbol"] = Rule("unused-public-symbol", (Part(dead, "{kind} '{name}' is never used", "file_path", "line"),))

    origins = elsewhere.join(code.located.select(F.col("symbol_id").alias("definition")), "definition").groupBy("definition").agg(F.array_sort(F.collect_set("module")).alias("origins"))
    local = candidates.with_lookup("origins", "symbol_id", origins).where(field("referenced", "bool")).where(not_(field("origins", "array").any_other_than(field("module"))))
    out["over-exposed-module-symbol"] = Rule("over-exposed-module-symbol", (Part(local, "{kind} '{name}' is used only in {module}", "file_path", "line"),))

    if recorded is not None:
        fresh = local.with_membership("recorded", "symbol_id", recorded).where(not_(field("recorded", "bool")))
        out["born-private"] = Rule("born-private", (Part(fresh, "new {kind} '{name}' is used only in {module}: begin it with an underscore", "file_path", "line"),))

    passed = code.passed
    out["over-exposed-export"] = over_exposed_export(code, library, public_roots)

    # Imports, past the package of another part of the root, of what its __init__ exports; only one with __all__ is a barrel.
    barrels = code.symbols.where("file_path like '%__init__.py' and name = '__all__' and kind = 'variable'").select("file_path", F.col("module").alias("barrel"))
    exports_ = barrels.join(passed.select("file_path", "definition"), "file_path").select("barrel", "definition").distinct()
    top = F.lit(root) if root else F.substring_index("module", ".", 1)
    target, below = F.regexp_replace("imported_from", r"\.[^.]*$", ""), lambda c: package_under(c, F.col("top"))
    direct = code.symbols.where("kind = 'import' and not file_path like '%__init__.py' and import_confidence is null and contains(imported_from, '.')").join(code.definitions, "symbol_id")
    direct = direct.withColumn("top", top).withColumn("target", target).withColumn("part", below(F.col("target"))).where(F.col("part") != below(F.col("module")))
    past = direct.withColumn("barrel", F.concat_ws(".", "top", "part")).where("barrel <> target").withColumn("imported_name", F.substring_index("imported_from", ".", -1)).join(exports_, ["barrel", "definition"])
    out["barrel-only"] = Rule("barrel-only", (Part(code.relation(past), "import '{imported_name}' from {barrel}, not from {target}", "file_path", "line"),))

    test_path = F.col("file_path").rlike(r"(^|/)(tests?/|test_[^/]*\.py$)")
    tested = elsewhere.where(test_path).select("definition").distinct()
    shipped = elsewhere.where(~test_path).select("definition").distinct()
    only = Relation.of(base.where(~test_path), "symbol_id", ("file_path", "ord")).with_membership("tested", "symbol_id", tested).with_membership("shipped", "symbol_id", shipped)
    only = only.where(all_of(public, field("tested", "bool"), not_(field("shipped", "bool"))))
    out["test-only-production-code"] = Rule("test-only-production-code", (Part(only, "{kind} '{name}' is used by tests only", "file_path", "line"),))

    inner = code.located.where("visibility in ('protected', 'private')").select(F.col("symbol_id").alias("definition"), F.col("module").alias("owner"), F.col("name").alias("inner_name"), F.col("visibility").alias("how"))
    reached = code.relation(code.uses.join(inner, "definition").where("owner <> module"), "file_path")
    out["under-exposed-access"] = Rule("under-exposed-access", (Part(reached, "{how} '{inner_name}' of {owner} is used outside it", "file_path", "line"),))

    cycles = code.cycles
    members = cycles.groupBy("component").agg(F.array_join(F.array_sort(F.collect_set("node")), ", ").alias("members"))
    inside = code.module_imports.join(cycles.select(F.col("node").alias("a"), "component"), "a").join(cycles.select(F.col("node").alias("b"), F.col("component").alias("other")), "b").where("component = other")
    told = first_by(inside, ["component"], ["a", "line"], ["file_path", "line"]).join(members, "component")
    out["no-import-cycles"] = Rule("no-import-cycles", (Part(Relation.of(told, "component"), "modules import each other: {members}", "file_path", "line"),))

    starred = code.relation(code.stars)
    indexed, supplied = field("indexed", "bool"), field("name_count")
    several = weakened_when(field("alone", "bool").eq(False), HEURISTIC)
    hides = "'from {imported_from} import *' supplies "
    out["star-imports"] = Rule("star-imports", (
        Part(starred.where(not_(indexed)).where(weakened_when(not_(indexed), HEURISTIC)), "'from {imported_from} import *' of a module that isn't indexed", "file_path", "line"),
        Part(starred.where(all_of(indexed, supplied.eq(0))).where(several), hides + "nothing that is used", "file_path", "line"),
        Part(starred.where(all_of(indexed, supplied.eq(1))).where(several), hides + "only '{used_names}'", "file_path", "line"),
        Part(starred.where(all_of(indexed, not_(supplied.is_in(0, 1)))).where(several), hides + "{name_count} names: {used_names}", "file_path", "line"),
    ))

    functions = code.symbols.where("kind in ('function', 'method')").join(code.impure.withColumnRenamed("function", "symbol_id"), "symbol_id")
    reasons = top_text(code.observations, ["function_id"], ["line", "what"], F.concat("what", F.lit(" (line "), F.col("line").cast("string"), F.lit(")")))
    reasons = reasons.select(F.col("function_id").alias("symbol_id"), F.col("shown").alias("reasons"))
    unsure = code.observations.groupBy(F.col("function_id").alias("symbol_id")).agg(F.bool_and("unsure").alias("unsure"))
    impure = functions.join(reasons, "symbol_id", "left").join(unsure, "symbol_id", "left").withColumn("reason", F.coalesce("reasons", F.lit("calls an impure function"))).withColumn("unsure", F.coalesce("unsure", F.lit(False)))
    impure = code.relation(kept.once(impure, "impure")).where(weakened_when(field("unsure", "bool"), HEURISTIC))
    out["no-impure-functions"] = Rule("no-impure-functions", (Part(impure, "{kind} '{name}' is impure: {reason}", "file_path", "line"),))
    contract = Relation(impure.df.where(F.exists("decorators", lambda d: F.substring_index(d, "(", 1).isin(*PURE_DECORATORS))), impure.anchor, impure.order, impure.fields)
    out["pure-decorator-contracts"] = Rule("pure-decorator-contracts", (Part(contract, "{kind} '{name}' should be pure: {reason}", "file_path", "line"),))

    loaded = code.uses.where("at_import and kind in ('call', 'attribute-call')")
    effects = code.impure.select(F.col("function").alias("definition"), F.lit(True).alias("effect"))
    at_load = loaded.join(effects, "definition", "left").where(F.col("effect").isNotNull() | F.col("symbol_id").isin(*(f"<builtins>.{x}" for x in code.policy.builtins)))
    out["import-time-side-effects"] = Rule("import-time-side-effects", (Part(code.relation(at_load, "file_path"), "'{name}' runs when the module is imported", "file_path", "line"),))

    on_parameter = any_of(field("root_kind").eq("parameter"))
    own = not_(field("receiver_name").is_in("self", "cls"))
    refs = code.relation(code.uses.withColumn("receiver_name", F.col("receiver")[0]), "file_path")
    mutating = refs.where(all_of(on_parameter, own, field("kind").eq("attribute-call"), field("name").is_in(*code.policy.mutators)))
    writing = refs.where(all_of(on_parameter, own, field("kind").eq("attribute-write")))
    setting = refs.where(all_of(field("bound_kind").eq("parameter"), field("kind").eq("subscript-write")))
    out["no-argument-mutation"] = Rule("no-argument-mutation", (Part(mutating, "argument '{receiver_name}' is changed by .{name}()", "file_path", "line"), Part(writing, "argument '{receiver_name}' gets a new .{name}", "file_path", "line"), Part(setting, "argument '{name}' gets a new item", "file_path", "line")))

    module_level = code.symbols.where("is_module_level and kind = 'variable'").select(F.col("symbol_id").alias("module_variable")).distinct()
    inside = code.uses.where("function_id is not null")
    written = inside.where("kind in ('augment', 'subscript-write')").join(module_level, F.col("bound") == F.col("module_variable"))
    grown = inside.where("kind = 'attribute-call'").where(F.col("name").isin(*code.policy.mutators)).join(module_level, F.col("root_id") == F.col("module_variable")).withColumn("receiver_name", F.col("receiver")[0])
    foreign = inside.where("kind = 'attribute-write' and root_kind = 'import'").withColumn("receiver_name", F.col("receiver")[0])
    out["no-hidden-global-mutation"] = Rule("no-hidden-global-mutation", (
        Part(code.relation(written, "file_path"), "'{function_id}' writes into global '{name}'", "file_path", "line"),
        Part(code.relation(code.rebinds), "global '{name}' is bound anew in '{function_id}'", "file_path", "line"),
        Part(code.relation(grown, "file_path"), "global '{receiver_name}' is changed by .{name}()", "file_path", "line"),
        Part(code.relation(foreign, "file_path"), "'{function_id}' sets .{name} of the imported '{receiver_name}'", "file_path", "line"),
    ))

    made = code.uses.where("kind in ('call', 'attribute-call')").groupBy(F.col("definition").alias("symbol_id")).agg(F.count("*").alias("n_calls"), F.bool_or("used").alias("any_used"))
    passed_on = code.uses.where("kind in ('read', 'attribute-read')").select("definition")
    promised = ~F.regexp_replace("annotation", "[\"']", "").isin("None", "NoReturn") & ~F.col("name").rlike("^__.*__$")
    returning = code.symbols.where("kind in ('function', 'method')").where(promised)
    returning = code.relation(returning.join(made, "symbol_id").where("not any_used")).with_membership("passed_on", "symbol_id", passed_on)
    out["unused-return-value"] = Rule("unused-return-value", (Part(returning.where(not_(field("passed_on", "bool"))), "the result of '{name}' is never used in {n_calls} calls", "file_path", "line"),))

    signature = F.filter("parameters", lambda p: ~p.isin("self", "cls"))
    told = code.symbols.where("kind in ('function', 'method')").withColumn("told", documented(F.col("docstring"))).where(F.size("told") > 0)
    ghosts = told.withColumn("ghost", F.explode(F.array_except("told", signature)))
    parts = [Part(code.relation(ghosts), "'{name}' documents '{ghost}', which it doesn't take", "file_path", "line")]
    if complete_docstrings:
        lacking = told.withColumn("lacking", F.explode(F.array_except(signature, F.col("told"))))
        parts.append(Part(code.relation(lacking), "'{name}' doesn't document '{lacking}'", "file_path", "line"))
    out["docstring-drift"] = Rule("docstring-drift", tuple(parts))

    touched = code.mutations.where("has_write_ref or mutator_call or escaping_read").select("symbol_id")
    lists = code.relation(code.symbols.where("kind = 'variable' and scope_kind in ('function', 'lambda') and annotation = 'list' and annotation_confidence = 'inferred'")).with_membership("touched", "symbol_id", touched)
    out["prefer-tuple"] = Rule("prefer-tuple", (Part(lists.where(not_(field("touched", "bool"))).where(weakened_when(field("name").ne(None), HEURISTIC)), "'{name}' is never changed: a tuple would do", "file_path", "line"),))

    if root:
        pairs = [(a, b) for a, bs in (allow or {}).items() for b in bs]
        allowed = code.sources.sparkSession.createDataFrame(pairs, "importer string, dep string")
        package = lambda c: F.when(F.col(c).startswith(f"{root}."), F.substring_index(F.substring(c, len(root) + 2, 1000), ".", 1))
        crossing = code.module_imports.withColumn("importer", package("a")).withColumn("dep", package("b")).where("importer is not null and dep is not null and importer <> dep")
        bad = crossing.join(allowed, ["importer", "dep"], "left_anti")
        idle = allowed.join(crossing.select("importer", "dep").distinct(), ["importer", "dep"], "left_anti").withColumn("file_path", F.lit("pyproject.toml")).withColumn("line", F.lit(1))
        out["import-boundaries"] = Rule("import-boundaries", (Part(Relation.of(bad, ("a", "b")), "{importer} may not import {dep}", "file_path", "line"), Part(Relation.of(idle, ("importer", "dep")), "{importer} never imports {dep}", "file_path", "line")))
    return out
