"""Names, facts and rules over a small project."""

from __future__ import annotations

import pytest

from latticework.catalog.code import Code, rules
from latticework.catalog.sample import FILES, sources
from latticework.operators import graph
from latticework.sources.python_code import read_sources, removed, stale


@pytest.fixture(scope="module")
def code(spark):
    return Code(sources(spark))


@pytest.fixture(scope="module")
def found(code):
    recorded = code.sources.sparkSession.createDataFrame([("app.core.model:Model",)], "symbol_id string")
    return rules(code, root="app", allow={"web": ["core"], "core": ["web"]}, recorded=recorded, complete_docstrings=True)


def lines(rule):
    return sorted((r["path"].removeprefix("src/app/"), r["line"], r["message"], r["confidence"]) for r in rule.findings().collect())


def test_symbols(code):
    got = {r["symbol_id"]: (r["kind"], r["visibility"]) for r in code.symbols.collect()}
    assert got["app.core.model:Model.save"] == ("method", "public")
    assert got["app.core.model:Model.save.target"] == ("parameter", "public")
    assert got["app.core.model:_private"] == ("function", "protected")
    assert {r["file_path"] for r in code.raw["files"].where("has_errors").collect()} == {"src/app/broken.py"}


def test_definitions(code):
    got = {r["symbol_id"]: r["definition"] for r in code.definitions.collect()}
    assert got["app.web.view:Model"] == "app.core.model:Model"  # through the package's own import
    assert got["app.web.view:h"] == "app.core.model:helper"
    assert got["app.core.model:store"] == "app.core.store"


def test_references_and_importers(code, spark):
    wanted = spark.createDataFrame([("app.core.model:Model",), ("app.core.store:write",)], "d string")
    got = {(r["file_path"].removeprefix("src/app/"), r["line"], r["how"]) for r in code.references_to(wanted).where("kind not in ('write')").collect()}
    assert got == {("web/view.py", 6, "barrel"), ("core/model.py", 20, "receiver_declared")}
    assert {r["file_path"] for r in code.importers.where("definition = 'app.core.model:Model'").collect()} == {"src/app/__init__.py", "src/app/web/view.py"}


def test_visible(code, spark):
    places = spark.createDataFrame([("src/app/core/model.py", 20)], "file_path string, line int")
    got = {r["name"]: r["symbol_id"] for r in code.visible_at(places).collect()}
    assert got["target"] == "app.core.model:Model.save.target" and got["self"] == "app.core.model:Model.save.self" and got["Model"] == "app.core.model:Model"
    assert "_inner" not in got and "rows" not in got


def test_impure(code):
    got = {r["function"]: r["depth"] for r in code.impure.collect()}
    assert got["app.core.store:write"] == 0 and got["app.core.model:Model.save"] == 1
    assert got["app.core.store:reset"] == 0 and got["tests.test_store:test_reset"] == 1
    assert "app.web.plain:used_here" not in got


EXPECTED = {
    "no-unresolved-refs": [("core/model.py", 40, "'missing_name' is not defined", "declared")],
    "unused-imports": [("core/store.py", 1, "'model' is imported but unused", "declared"), ("web/view.py", 4, "'json' is imported but unused", "declared")],
    "no-import-cycles": [],
    "star-imports": [("web/view.py", 3, "'from app.core.store import *' supplies nothing that is used", "declared")],
    "under-exposed-access": [("web/view.py", 8, "protected '_private' of app.core.model is used outside it", "declared")],
    "pure-decorator-contracts": [("core/model.py", 27, "function 'size' should be pure: os.path.exists (line 28)", "declared")],
    "over-exposed-module-symbol": [("web/plain.py", 1, "function 'used_here' is used only in app.web.plain", "declared")],
    "test-only-production-code": [("core/store.py", 10, "function 'reset' is used by tests only", "declared")],
    "docstring-drift": [("core/model.py", 13, "'save' documents 'mode', which it doesn't take", "declared")],
    "born-private": [("web/plain.py", 1, "new function 'used_here' is used only in app.web.plain: begin it with an underscore", "declared")],
    "over-exposed-export": [("__init__.py", 1, "'Model' is exported by app but not used outside it", "declared")],
    "barrel-only": [],
    "unused-return-value": [],
    "prefer-tuple": [],  # the only list is returned
    "no-argument-mutation": [("core/model.py", 32, "argument 'items' is changed by .append()", "declared"), ("core/model.py", 33, "argument 'box' gets a new .count", "declared"), ("core/model.py", 34, "argument 'box' gets a new item", "declared")],
    "no-hidden-global-mutation": [("core/model.py", 19, "global 'cache' is changed by .update()", "declared"), ("core/store.py", 12, "global 'state' is bound anew in 'app.core.store:reset'", "declared")],
    "import-boundaries": [("pyproject.toml", 1, "core never imports web", "declared")],
}


@pytest.mark.parametrize("name", sorted(EXPECTED))
def test_rule(found, name):
    assert lines(found[name]) == sorted(EXPECTED[name])


def test_naming(found):
    assert ("core/store.py", 15, "function 'Lonely' breaks the naming convention", "declared") in lines(found["naming-conventions"])
    assert not any("LIMIT" in x[2] for x in lines(found["naming-conventions"]))


def test_unused_public(found):
    assert {x[2] for x in lines(found["unused-public-symbol"])} >= {"function 'Lonely' is never used", "function 'size' is never used"}
    assert not any("Model" in x[2] for x in lines(found["unused-public-symbol"]))


BINDER = """
def f(a, b):
    try:
        g = lambda *args, k=1, **kw: (args, k, kw)
    except (ValueError, OSError) as err:
        print(err)
    match a:
        case [first, *rest]:
            return first, rest
        case {"x": y, **more}:
            return y, more
        case str() as text:
            return text
    if any((last := x) for x in b):
        return last

def outer():
    n = 0
    def inner():
        nonlocal n
        n = 1
    return inner

def rebinding():
    global total
    total = 1

class Box[T]:
    def put(self, item: T) -> T:
        return item

type Pair[U] = tuple[U, U]
"""


def test_binder(spark):
    code = Code(spark.createDataFrame([("src/b.py", BINDER.encode())], "path string, content binary"))
    got = {r["symbol_id"]: r["kind"] for r in code.symbols.collect()}
    for name in ("b:f.err", "b:f.first", "b:f.rest", "b:f.y", "b:f.more", "b:f.text", "b:f.last"):
        assert got[name] == "variable", name
    for name in ("args", "k", "kw"):
        assert any(i.endswith(f"<lambda:4>.{name}") and k == "parameter" for i, k in got.items())
    assert got["b:Box.T"] == "type_parameter" and got["b:Pair.U"] == "type_parameter"
    assert "b:outer.inner.n" not in got and got["b:outer.n$2"] == "variable"  # bound in the scope that nonlocal names
    assert "b:rebinding.total" not in got and got["b:total"] == "variable"
    assert rules(code)["no-unresolved-refs"].findings().count() == 0


def test_effects_by_receiver(spark):
    text = """
import os
from os import path as p, system
from pathlib import Path

def a(x: str): return x.replace("a", "b")
def b(x: Path): return x.exists()
def c(x): x.append(1)
def d():
    own = []
    own.append(1)
    return own
def e(): return os.path.join("a", "b")
def f(): return p.isfile("a")
def g(): system("ls")
def h(x): return x.y.write(1)
def i(x: Path): return x.joinpath("a")
def j(): return Path("a").read_text()
def k(): return compile("1", "a", "eval")
"""
    code = Code(spark.createDataFrame([("src/q.py", text.encode())], "path string, content binary"))
    assert {r["function"] for r in code.impure.collect()} == {f"q:{x}" for x in "bcfghjk"}
    told = {r["message"]: r["confidence"] for r in rules(code)["no-impure-functions"].findings().collect()}
    assert told["function 'h' is impure: method .write (line 16)"] == "heuristic"
    assert told["function 'c' is impure: method .append (line 8)"] == "declared"


def test_import_time(found):
    assert {(x[0], x[1]) for x in lines(found["import-time-side-effects"])} == {("web/view.py", 7)}


def test_cycle(spark):
    files = {"src/a.py": "import b\n", "src/b.py": "import c\n", "src/c.py": "import a\nimport d\n", "src/d.py": "def f():\n    import a\n"}
    code = Code(spark.createDataFrame([(p, c.encode()) for p, c in files.items()], "path string, content binary"))
    assert lines(rules(code)["no-import-cycles"]) == [("src/a.py", 1, "modules import each other: a, b, c", "declared")]


def test_refresh(spark, tmp_path):
    for p, c in list(FILES.items())[:3]:
        f = tmp_path / p
        f.parent.mkdir(parents=True, exist_ok=True)
        f.write_text(c)
    now = read_sources(spark, str(tmp_path))
    from pyspark.sql import functions as F

    known = now.select("path", F.sha2("content", 256).alias("sha256")).collect()
    assert sorted(r["path"] for r in known) == sorted(list(FILES)[:3])
    known = [("src/app/__init__.py", "old"), *[(r["path"], r["sha256"]) for r in known if "model" in r["path"]], ("src/gone.py", "x")]
    known = spark.createDataFrame(known, "path string, sha256 string")
    assert sorted(r["path"] for r in stale(now, known).collect()) == ["src/app/__init__.py", "src/app/core/__init__.py"]
    assert [r["path"] for r in removed(now, known).collect()] == ["src/gone.py"]


def test_barrel_only(spark):
    """Only imports from another part of the root, past a package with __all__, of what it exports."""
    q = "from w.p.a import f\nfrom w.p import g\nfrom w.p.a import h\nf()\ng()\n"
    files = {"src/w/p/__init__.py": "from w.p.a import f, g\n__all__ = []\n", "src/w/p/a.py": "def f(): pass\ndef g(): pass\ndef h(): pass\n", "src/w/p/b.py": "from w.p.a import f\n", "src/w/q.py": q, "src/other.py": "from w.p.a import f\n"}

    def found(files):
        out = rules(Code(spark.createDataFrame([(p, c.encode()) for p, c in files.items()], "path string, content binary")))
        return out, [(r["path"], r["line"], r["message"]) for r in out["barrel-only"].findings().collect()]

    out, got = found(files)
    assert got == [("src/w/q.py", 1, "import 'f' from w.p, not from w.p.a")]
    assert out["over-exposed-export"].findings().count() == 0
    assert found(files | {"src/w/p/__init__.py": "from w.p.a import f, g\n"})[1] == []  # no barrel without __all__


def test_docstring_styles(spark):
    from pyspark.sql import functions as F

    from latticework.functions.docstrings import documented, style

    texts = {
        "sphinx": "Do.\n\n:param a: x\n:param int b: y\n",
        "google": "Do.\n\n    Args:\n        a: x\n            more: text\n        b (int): y\n\n    Returns:\n        c: z\n",
        "numpy": "Do.\n\n    Parameters\n    ----------\n    a : int\n        x\n    b\n        y\n\n    Returns\n    -------\n    c\n",
        None: "Do nothing.",
    }
    df = spark.createDataFrame([(k, v) for k, v in texts.items()], "k string, t string")
    for r in df.select("k", style(F.col("t")).alias("s"), documented(F.col("t")).alias("d")).collect():
        assert r["s"] == r["k"] and r["d"] == (["a", "b"] if r["k"] else [])


def test_hierarchy(spark):
    files = {"src/p/a.py": "class A:\n    def f(self): pass\n    def g(self): pass\n", "src/p/b.py": "from p.a import A\nimport p.a as m\nclass B(A):\n    def f(self): pass\nclass C(B, Exception):\n    def f(self): pass\n    def g(self): pass\nclass D(m.A): pass\n"}
    code = Code(spark.createDataFrame([(p, c.encode()) for p, c in files.items()], "path string, content binary"))
    got = {(r["node"], r["ancestor"], r["depth"]) for r in code.ancestors.collect()}
    assert got == {("p.b:B", "p.a:A", 1), ("p.b:C", "p.b:B", 1), ("p.b:C", "Exception", 1), ("p.b:C", "p.a:A", 2), ("p.b:D", "p.a:A", 1)}
    assert {r["node"] for r in code.open_classes.collect()} == {"p.b:C"}
    assert {r["descendant"] for r in code.descendants.where("node = 'p.a:A'").collect()} == {"p.b:B", "p.b:C", "p.b:D"}
    assert {(r["method"], r["overridden"]) for r in code.overrides.collect()} == {("p.b:B.f", "p.a:A.f"), ("p.b:C.f", "p.b:B.f"), ("p.b:C.g", "p.a:A.g")}


def test_long_ancestries_end(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(35)], "a int, b int")
    assert graph.ancestry(edges).where("node = 0").count() == 35
    with pytest.raises(RuntimeError):
        graph.ancestry(edges, most_depth=5)


def test_long_chains_end(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(35)], "name int, target int")
    assert {tuple(r) for r in graph.chased(chain).collect()} == {(i, 35, 35 - i) for i in range(35)}
    with pytest.raises(RuntimeError):
        graph.chased(chain, most_hops=3)
