"""Python sources as tables: declarations, scopes and raw references of each file, by one pass of the standard parser."""

from __future__ import annotations

import ast
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from latticework.sources.shared import stored

DECLARED_FIELDS = "file_path string, ord int, scope_id string, scope_kind string, name string, kind string, line int, docstring string, decorators array<string>, annotation string, annotation_confidence string, imported_from string, import_confidence string, parameters array<string>"
SCOPE_FIELDS = "file_path string, ord int, scope_id string, name string, kind string, chain array<string>, start_line int, end_line int"
REF_FIELDS = "file_path string, ord int, name string, kind string, line int, col int, scope_id string, chain array<string>, function_id string, at_import boolean, receiver array<string>, used boolean, escapes boolean"
FILE_FIELDS = "file_path string, module string, has_errors boolean"
FIELDS = {"declared": DECLARED_FIELDS, "scopes": SCOPE_FIELDS, "refs": REF_FIELDS, "files": FILE_FIELDS}

#: References of a shuffle's part, about; the session's setting that tells how many parts there are before Spark puts small ones together.
REFS_PER_PART, FIRST_PARTS = 50_000, "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
#: What imports a module by a text.
DYNAMIC_IMPORTS = ("__import__",)


def module_name(path: str, roots: tuple[str, ...] = ("src/", "lib/")) -> str:
    for r in roots:
        path = path.removeprefix(r)
    return path.removesuffix(".py").removesuffix("__init__").strip("/").replace("/", ".")


class Walk(ast.NodeVisitor):
    """One file's rows, in the order of its text. Names are bound later, by joins."""

    def __init__(self, path: str, module: str, package: bool) -> None:
        self.path, self.module, self.package = path, module, package
        self.rows: dict[str, list[tuple]] = {k: [] for k in FIELDS}
        self.stack: list[tuple[str, str]] = []  # scope id, kind
        self.function: str | None = None
        self.loose: set[int] = set()  # calls whose result nobody takes
        self.outer: list[dict[str, int]] = []  # of each open scope, the names it declares for another: that one's place
        self.known: set[tuple[str, str]] = set()  # scope and name of all declarations so far
        self.local: set[int] = set()  # names read where a tuple would do as well as a list

    def declare(self, name, kind, node, docstring=None, decorators=(), annotation=None, sure=None, source=None, parameters=None, place=-1, import_sure=None):
        scope, scope_kind = self.stack[self.outer[-1].get(name, place) if place == -1 else place]
        self.known.add((scope, name))
        self.rows["declared"].append((self.path, len(self.rows["declared"]), scope, scope_kind, name, kind, node.lineno, docstring, list(decorators), annotation, sure, source, import_sure, parameters))

    def refer(self, name, kind, node, receiver=None, used=True):
        chain = [s for i, (s, k) in enumerate(reversed(self.stack)) if i == 0 or k != "class"]
        at_import = all(k in ("module", "class") for _, k in self.stack)
        self.rows["refs"].append((self.path, len(self.rows["refs"]), name, kind, node.lineno, node.col_offset, self.stack[-1][0], chain, self.function, at_import, receiver, used, kind.endswith("read") and id(node) not in self.local))

    def enter(self, name, kind, node, bodies):
        top, top_kind = self.stack[-1] if self.stack else ("", "")
        scope = self.module if not self.stack else f"{top}{':' if top_kind == 'module' else '.'}{name}"
        self.stack.append((scope, kind))
        self.outer.append({})
        self.rows["scopes"].append((self.path, len(self.rows["scopes"]), scope, name, kind, [s for s, _ in reversed(self.stack)], getattr(node, "lineno", 1), getattr(node, "end_lineno", 1) or 1))
        before = self.function
        if kind in ("function", "lambda"):  # what a lambda does is done when it is called
            self.function = scope if kind == "function" else None
        for x in bodies:
            self.visit(x)
        self.function = before
        self.stack.pop()
        self.outer.pop()

    def visit_Module(self, node):
        self.enter(self.module, "module", node, node.body)

    def visit_ClassDef(self, node):
        self.declare(node.name, "class", node, ast.get_docstring(node), map(ast.unparse, node.decorator_list), parameters=[ast.unparse(b) for b in node.bases])
        for x in [*node.decorator_list, *node.bases, *node.keywords]:
            self.visit(x)
        self.enter(node.name, "class", node, [*getattr(node, "type_params", ()), *node.body])

    def visit_FunctionDef(self, node):
        a = node.args
        given = [*a.posonlyargs, *a.args, *filter(None, [a.vararg]), *a.kwonlyargs, *filter(None, [a.kwarg])]
        kind = "method" if self.stack[-1][1] == "class" else "function"
        self.declare(node.name, kind, node, ast.get_docstring(node), map(ast.unparse, node.decorator_list), node.returns and ast.unparse(node.returns), node.returns and "declared", None, [x.arg for x in given])
        for x in [*node.decorator_list, *a.defaults, *filter(None, a.kw_defaults), *filter(None, [node.returns]), *filter(None, (x.annotation for x in given))]:
            self.visit(x)
        self.enter(node.name, "function", node, [*getattr(node, "type_params", ()), *given, *node.body])

    visit_AsyncFunctionDef = visit_FunctionDef

    def visit_arg(self, node):
        self.declare(node.arg, "parameter", node, annotation=node.annotation and ast.unparse(node.annotation), sure=node.annotation and "declared")

    def visit_Lambda(self, node):
        a = node.args
        for x in [*a.defaults, *filter(None, a.kw_defaults)]:
            self.visit(x)
        given = [*a.posonlyargs, *a.args, *filter(None, [a.vararg]), *a.kwonlyargs, *filter(None, [a.kwarg])]
        self.enter(f"<lambda:{node.lineno}>", "lambda", node, [*given, node.body])

    def visit_TypeVar(self, node):
        self.declare(node.name, "type_parameter", node)
        if getattr(node, "bound", None):
            self.visit(node.bound)

    visit_ParamSpec = visit_TypeVarTuple = visit_TypeVar

    def visit_TypeAlias(self, node):
        self.declare(node.name.id, "variable", node, annotation="type", sure="declared")
        self.enter(node.name.id, "type_params", node, [*node.type_params, node.value])

    def visit_ExceptHandler(self, node):
        if node.type:
            self.visit(node.type)
        if node.name:
            self.declare(node.name, "variable", node)
            self.refer(node.name, "write", node)
        for x in node.body:
            self.visit(x)

    def captured(self, node):
        name = node.rest if isinstance(node, ast.MatchMapping) else node.name
        if name:
            self.declare(name, "variable", node)
            self.refer(name, "write", node)
        self.generic_visit(node)

    visit_MatchAs = visit_MatchStar = visit_MatchMapping = captured

    def visit_NamedExpr(self, node):
        """Inside comprehensions the name is bound in the scope around them."""
        place = len(self.stack) - 1
        while self.stack[place][1] == "comprehension":
            place -= 1
        place = self.outer[place].get(node.target.id, place)
        self.declare(node.target.id, "variable", node.target, place=place)
        self.refer(node.target.id, "write", node.target)
        self.visit(node.value)

    def comprehension(self, node):
        self.visit(node.generators[0].iter)
        parts = [x for g in node.generators for x in (g.target, *([g.iter] if g is not node.generators[0] else []), *g.ifs)]
        self.enter(f"<comp:{node.lineno}>", "comprehension", node, [*parts, *([node.key, node.value] if isinstance(node, ast.DictComp) else [node.elt])])

    visit_ListComp = visit_SetComp = visit_GeneratorExp = visit_DictComp = comprehension

    def visit_Import(self, node):
        for x in node.names:
            self.declare(x.asname or x.name.split(".")[0], "import", node, source=x.name if x.asname else x.name.split(".")[0])
            self.refer(x.name, "imports", node)

    def visit_ImportFrom(self, node):
        base = node.module or ""
        if node.level:
            parts = self.module.split(".") if self.module else []
            parts = parts[: len(parts) - node.level + (1 if self.package else 0)]
            base = ".".join([*parts, *([base] if base else [])])
        self.refer(base, "imports", node)
        for x in node.names:
            self.declare(x.asname or x.name, "star" if x.name == "*" else "import", node, source=base if x.name == "*" else f"{base}.{x.name}")

    def visit_Global(self, node):
        for name in node.names:
            self.refer(name, "global", node)
            self.outer[-1][name] = 0

    def visit_Nonlocal(self, node):
        for name in node.names:
            self.refer(name, "nonlocal", node)
            functions = [i for i, (_, k) in enumerate(self.stack[:-1]) if k in ("function", "lambda")]
            self.outer[-1][name] = next((i for i in reversed(functions) if (self.stack[i][0], name) in self.known), functions[-1] if functions else 0)

    def visit_Name(self, node):
        if isinstance(node.ctx, ast.Store):
            self.declare(node.id, "variable", node)
        self.refer(node.id, {ast.Load: "read", ast.Store: "write", ast.Del: "delete"}[type(node.ctx)], node)

    def member(self, target, annotation=None, sure=None):
        """self.x and cls.x, when first stored to, are members of the class around."""
        if isinstance(target, ast.Attribute) and isinstance(target.value, ast.Name) and target.value.id in ("self", "cls"):
            place = next((i for i in reversed(range(len(self.stack))) if self.stack[i][1] == "class"), None)
            if place is not None and (self.stack[place][0], target.attr) not in self.known:
                self.declare(target.attr, "variable", target, annotation=annotation, sure=sure, place=place)

    def visit_Assign(self, node):
        """A name or member that is given a list or what a call returns has its type inferred from that; parts of a tuple haven't."""
        kind = "list" if isinstance(node.value, (ast.List, ast.ListComp)) else ast.unparse(node.value.func) if isinstance(node.value, ast.Call) and dotted(node.value.func) else None
        for target in node.targets:
            before = len(self.rows["declared"])
            self.member(target)
            self.visit(target)
            if kind and isinstance(target, (ast.Name, ast.Attribute)):
                self.rows["declared"][before:] = [(*r[:9], kind, "inferred", *r[11:]) if r[5] == "variable" and r[9] is None else r for r in self.rows["declared"][before:]]
        self.visit(node.value)

    def visit_AugAssign(self, node):
        if isinstance(node.target, ast.Name):
            self.refer(node.target.id, "augment", node)
        else:
            self.visit(node.target)
        self.visit(node.value)

    def visit_AnnAssign(self, node):
        if isinstance(node.target, ast.Name):
            self.declare(node.target.id, "variable", node, annotation=ast.unparse(node.annotation), sure="declared")
        else:
            self.member(node.target, ast.unparse(node.annotation), "declared")
            self.visit(node.target)
        for x in [node.annotation, *filter(None, [node.value])]:
            self.visit(x)

    def visit_Expr(self, node):
        if isinstance(node.value, ast.Call):
            self.loose.add(id(node.value))
        self.generic_visit(node)

    def dynamic_import(self, node):
        """importlib.import_module("x") and __import__("x") import x, as far as can be told; they bind no name."""
        f, first = node.func, node.args[0] if node.args else None
        named = isinstance(f, ast.Name) and f.id in DYNAMIC_IMPORTS
        behind = isinstance(f, ast.Attribute) and f.attr == "import_module" and isinstance(f.value, ast.Name) and f.value.id == "importlib"
        if (named or behind) and isinstance(first, ast.Constant) and isinstance(first.value, str) and first.value:
            self.declare("<dynamic-import>", "import", node, source=first.value, import_sure="heuristic")

    def visit_Call(self, node):
        used = id(node) not in self.loose
        self.dynamic_import(node)
        if isinstance(node.func, ast.Name):
            self.refer(node.func.id, "call", node, used=used)
        elif isinstance(node.func, ast.Attribute):
            self.attribute(node.func, "call", used)
        else:
            self.visit(node.func)
        for x in [*node.args, *node.keywords]:
            self.visit(x)

    def visit_Attribute(self, node):
        self.attribute(node, {ast.Load: "read", ast.Store: "write", ast.Del: "delete"}[type(node.ctx)], True)

    def attribute(self, node, kind, used):
        chain, x = [], node.value
        while isinstance(x, ast.Attribute):
            chain.append(x.attr)
            x = x.value
        root = [x.id, *reversed(chain)] if isinstance(x, ast.Name) else None
        self.refer(node.attr, f"attribute-{kind}", node, root, used)
        if root:
            self.refer(root[0], "read", x)
        else:
            self.visit(x)

    def visit_Subscript(self, node):
        """x[i] = v and x[i][j] = v write x; a.b[i] = v writes a.b."""
        if isinstance(node.ctx, ast.Store):
            root = node.value
            while isinstance(root, ast.Subscript):
                root = root.value
            if isinstance(root, ast.Name):
                self.refer(root.id, "subscript-write", node)
            elif isinstance(root, ast.Attribute):
                root.ctx = ast.Store()
        self.generic_visit(node)


def dotted(node: ast.AST) -> bool:
    """A name, or attributes of one."""
    while isinstance(node, ast.Attribute):
        node = node.value
    return isinstance(node, ast.Name)


def looked_into(tree: ast.AST) -> set[int]:
    """Names that are iterated over, looked up in, indexed or asked whether they are empty: what is read stays where it is."""
    out = set()
    for node in ast.walk(tree):
        if isinstance(node, (ast.For, ast.AsyncFor, ast.comprehension)):
            out.add(id(node.iter))
        elif isinstance(node, ast.Subscript):
            out.add(id(node.value))
        elif isinstance(node, (ast.If, ast.While, ast.Assert)):
            out.add(id(node.test))
        elif isinstance(node, ast.UnaryOp) and isinstance(node.op, ast.Not):
            out.add(id(node.operand))
        elif isinstance(node, ast.Compare) and any(isinstance(o, (ast.In, ast.NotIn)) for o in node.ops):
            out.add(id(node.comparators[-1]))
    return out


def parsed(path: str, content: bytes) -> dict[str, list[tuple]]:
    module = module_name(path)
    try:
        tree = ast.parse(content)
    except (SyntaxError, ValueError):
        return {"files": [(path, module or path, True)]}
    walk = Walk(path, module or path, path.endswith("__init__.py"))
    walk.local = looked_into(tree)
    walk.visit(tree)
    return walk.rows | {"files": [(path, module or path, False)]}


def read_sources(spark: SparkSession, folder: str, per_task: int = 200) -> DataFrame:
    """path, content of every Python file below a folder that all executors mount.

    Spark's file sources pass over names that begin with an underscore, as every package's __init__.py does, so the
    driver lists names only and tasks read the files.
    """
    top = Path(folder)
    paths = sorted(str(p.relative_to(top)) for p in top.rglob("*.py") if p.is_file())
    names = spark.createDataFrame([(p,) for p in paths], "path string").repartition(max(1, len(paths) // per_task))

    def run(batches):
        for b in batches:
            content = [(Path(folder) / p).read_bytes() for p in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(content, pa.binary())], ["path", "content"])

    return names.mapInArrow(run, "path string, content binary")


def deal_finer(spark: SparkSession, n: int) -> None:
    """At least n parts for a shuffle to begin with; a larger number that the session has stays."""
    if n > int(spark.conf.get(FIRST_PARTS, None) or spark.conf.get("spark.sql.shuffle.partitions")):
        spark.conf.set(FIRST_PARTS, str(n))


def code_tables(sources: DataFrame) -> dict[str, DataFrame]:
    """declared, scopes, refs, files of all sources (path, content); a file that can't be parsed has errors and no rows.

    Each file is parsed once, by one task alone: its rows of all tables leave together, are stored, and each table is a
    scan of its own part. From now on the session's shuffles begin with parts for about REFS_PER_PART references each, which
    Spark puts together again where they are small: what one task sorts does not grow with the sources.
    """
    kinds = {"string": pa.string(), "int": pa.int32(), "boolean": pa.bool_(), "array<string>": pa.list_(pa.string())}
    columns = {t: [tuple(f.split()) for f in fields.split(", ")] for t, fields in FIELDS.items()}
    every = list(dict.fromkeys(c for t in columns.values() for c in t))

    def run(batches):
        for b in batches:
            files = [parsed(p, c or b"") for p, c in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) if p is not None]
            for table, own in columns.items():
                rows = [r for f in files for r in f.get(table, ())]
                if rows:
                    found = dict(zip((n for n, _ in own), zip(*rows)))
                    yield pa.RecordBatch.from_arrays([pa.array([table] * len(rows)), *(pa.array(found.get(n, [None] * len(rows)), kinds[k]) for n, k in every)], ["part", *(n for n, _ in every)])

    all_ = sources.select("path", F.col("content").cast("binary")).mapInArrow(run, "part string, " + ", ".join(f"{n} {k}" for n, k in every))
    all_ = stored(all_, "code", "part")
    deal_finer(sources.sparkSession, -(-all_.where("part = 'refs'").count() // REFS_PER_PART))
    return {t: all_.where(F.col("part") == t).select(*(n for n, _ in own)) for t, own in columns.items()}


def stale(sources: DataFrame, known: DataFrame) -> DataFrame:
    """Sources whose content is new: known has path and sha256 of what was indexed."""
    now = sources.withColumn("sha256", F.sha2("content", 256))
    return now.join(known.select("path", "sha256"), ["path", "sha256"], "left_anti")


def removed(sources: DataFrame, known: DataFrame) -> DataFrame:
    """Indexed paths that are gone."""
    return known.select("path").join(sources.select("path"), "path", "left_anti")
