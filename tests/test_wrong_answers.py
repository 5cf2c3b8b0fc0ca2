"""Small cases that once had wrong answers."""

from __future__ import annotations

import json
import random

import pytest
from pyspark.sql import functions as F

from latticework.catalog import code, depot, sample, shop
from latticework.catalog.code import Code, rules
from latticework.catalog.universes import Universes
from latticework.functions.docstrings import documented
from latticework.functions import summaries
from latticework.functions.names import snake_case
from latticework.operators import intervals, layers
from latticework.plans.evidence import field
from latticework.plans.kept import Kept
from latticework.plans.relation import Relation
from latticework.sources import python_code, shared


def project(spark, files):
    return Code(spark.createDataFrame([(k, v.encode()) for k, v in files.items()], "path string, content binary"))


@pytest.mark.parametrize(("name", "want"), [("A__b", "a_b"), ("get_Value", "get_value"), ("HTTPServer", "http_server"), ("Brand#13", "brand_13")])
def test_snake_case(spark, name, want):
    assert spark.range(1).select(snake_case(F.lit(name))).first()[0] == want


def test_a_parameters_heading_with_a_colon_is_none(spark):
    assert spark.range(1).select(documented(F.lit("X.\n\nParameters:\n    a: b\n"))).first()[0] == []


def test_lookup_adds_no_rows_and_hides_no_column(spark):
    rows = Relation.of(spark.createDataFrame([(1, "x", "m"), (2, "y", "n")], "id long, _key string, _member string"), "id")
    twice = spark.createDataFrame([(1, "b"), (1, "a")], "k long, v string")
    got = rows.with_lookup("found", "id", twice).with_membership("inside", "id", twice).df.collect()
    assert sorted((r["id"], r["_key"], r["_member"], r["found"], r["inside"]) for r in got) == [(1, "x", "m", "a", True), (2, "y", "n", None, False)]


def test_overlay_with_a_null_flag(spark):
    base = spark.createDataFrame([(1, "old"), (2, "b"), (3, "c")], "k long, v string")
    layer = spark.createDataFrame([(1, "new", None), (2, "x", True)], "k long, v string, gone boolean")
    assert sorted(tuple(r) for r in layers.overlaid(base, layer, "k", "gone").collect()) == [(1, "new"), (3, "c")]


def test_equal_ids_of_two_roots_stay_apart(spark):
    u = Universes(project(spark, {"src/x.py": "def f():\n    pass\n\n\nf()\n", "lib/x.py": "def f():\n    pass\n\n\nf()\n"}))
    calls = u["references"].where(field("kind").eq("call"))
    assert sorted(r["file_path"] for r in u.follow(calls, "references", "symbol").df.collect()) == ["lib/x.py", "src/x.py"]


def innermost(spans, g, at):
    held = [(e - s, s, n) for group, s, e, n in spans if group is not None and group == g and at is not None and s is not None and e is not None and s <= at <= e]
    return min(held)[2] if held else None


@pytest.mark.parametrize("seed", range(3))
def test_innermost_equals_a_walk(spark, seed):
    """Nested, crossing, equal and empty spans; equal points, points without a group or place."""
    rng = random.Random(seed)
    spans = [(rng.choice("ab"), s := rng.randint(0, 900), s + rng.choice([0, 1, 5, 40, 400]), f"n{i}") for i in range(150)]
    spans += [("a", 10, 20, "same1"), ("a", 10, 20, "same0"), ("c", 5, 3, "empty"), (None, 0, 9, "none"), ("a", None, 9, "open")]
    points = [(i, rng.choice("abd"), rng.randint(-5, 1400)) for i in range(300)] + [(300, "a", 15), (300, "a", 15), (301, None, 5), (302, "a", None), (303, "c", 4)]
    df = spark.createDataFrame(points, "id long, f string, p long")
    got = intervals.innermost(df, spark.createDataFrame(spans, "f string, s long, e long, n string"), "f", "p", "s", "e", "n")
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(((*p, innermost(spans, p[1], p[2])) for p in points), key=repr)


def test_innermost_of_nothing(spark):
    none = spark.createDataFrame([], "f string, s long, e long, n string")
    points = spark.createDataFrame([("a", 1)], "f string, p long")
    assert intervals.innermost(points, none, "f", "p", "s", "e", "n").collect() == [("a", 1, None)]


@pytest.mark.parametrize("seed", range(3))
def test_claims_equal_a_loop(spark, seed):
    rng = random.Random(seed)
    edits = [(i, rng.choice("ab"), s := rng.randint(0, 300), s + rng.choice([0, 1, 3, 10, 60])) for i in range(200)] + [(200, None, 1, 5), (201, "a", None, 5)]
    kept, want = {}, set()
    for i, g, a, z in edits:
        if g is None or a is None or a >= z or not any(a < y and x < z for x, y in kept.get(g, [])):
            want.add(i)
            if g is not None and a is not None and a < z:
                kept.setdefault(g, []).append((a, z))
    got = layers.claimed(spark.createDataFrame(edits, "i long, g string, a long, z long"), "g", "a", "z", ["i"]).collect()
    assert {r["i"] for r in got if r["kept"]} == want and len(got) == len(edits)


def test_imports_used_by_text(spark):
    code = project(spark, {
        "src/a.py": "from b import X, Y, Z\nimport b.c\n\n\ndef f(x: \"list['X']\"):\n    return Y\n",
        "src/b.py": "from d import W\n__all__ = ['W']\n",
    })
    got = rules(code)["unused-imports"].findings().collect()
    assert sorted((r["path"], r["message"]) for r in got) == [("src/a.py", "'Z' is imported but unused")]


def test_what_a_lambda_does_is_done_when_it_is_called(spark):
    code = project(spark, {"src/a.py": "def f():\n    return lambda: print(1)\n\n\ndef g():\n    return [print(i) for i in (1, 2)]\n"})
    assert {r["function"] for r in code.impure.collect()} == {"a:g"}


ESCAPES = """def f(z):
    a = [1]
    b = [1]
    c = [1]
    d = [1]
    e = [1]
    g = [1]
    h = [1]
    i = [1]
    j = [1]
    for v in a:
        pass
    if b or z in c:
        pass
    while d:
        assert not e
    g.append(1)
    use(h)
    k = i
    return j[0]
"""


def test_lists_that_stay(spark):
    """Iterated, looked up in, asked whether empty, indexed: they stay. In `b or x`, passed on, given a second name: they may go."""
    code = project(spark, {"src/a.py": ESCAPES})
    got = {r["message"][1] for r in rules(code)["prefer-tuple"].findings().collect()}
    assert got == set("acdej")
    flags = {r["symbol_id"][-1]: (r["has_write_ref"], r["mutator_call"], r["escaping_read"]) for r in code.mutations.collect()}
    assert flags["g"] == (False, True, True) and flags["h"] == (False, False, True) and flags["i"] == (False, False, True)


CLASSES = {
    "src/lib.py": """class A:
    def say(self):
        print(1)

    def go(self):
        self.say()


class B(A):
    def run(self):
        self.go()


class D:
    def leaf(self):
        print(2)


class C:
    d: D


class E:
    c: C


class F:
    e: E


def make() -> B:
    return B()


def loop() -> "loop":
    return 1


def f(a: A):
    a.say()
""",
    "src/app.py": """from lib import A, B, E, F, loop, make


class Svc:
    store = None

    def first(self):
        self.store = B()
        self.kept: B = None
        self.found = B()

    def second(self):
        self.found = A()
        self.found.run()
        self.kept.run()
        self.store.run()


def optional(a: "A | None"):
    a.say()


def three(e: E):
    e.c.d.leaf()


def four(f: F):
    f.e.c.d.leaf()


def untyped(a):
    a.unheard()


def unpacked():
    a, b = make()
    a.run()


def turning():
    loop().run()
    x = loop()
    x.run()


class Own:
    @property
    def inner(self) -> D:
        return 1

    def go(self):
        self.inner.leaf()
""",
}


def test_receivers(spark):
    """self, inherited methods, typed and optional parameters, members of members to three names, but not four; what a function returns,
    also round in a circle; the first declaration of a member tells its type.
    """
    code = project(spark, CLASSES)
    depth = {r["function"]: r["depth"] for r in code.impure.collect()}
    assert {k: v for k, v in depth.items() if k.startswith("lib")} == {"lib:A.say": 0, "lib:D.leaf": 0, "lib:A.go": 1, "lib:f": 1, "lib:B.run": 2}
    assert {k: v for k, v in depth.items() if k.startswith("app")} == {"app:optional": 1, "app:three": 1, "app:Svc.second": 3}
    sure = {(r["line"], r["how"]) for r in code.references_to(spark.createDataFrame([("lib:B.run",)], "d string")).collect() if r["file_path"] == "src/app.py"}
    assert sure == {(14, "receiver_inferred"), (15, "receiver_declared")}
    members = {r["member"] for r in code.members.where("own and container = 'app:Svc'").collect()}
    assert members == {f"app:Svc.{n}" for n in ("store", "first", "second", "kept", "found")}


def test_equal_sets_are_stored_once(spark):
    """Plans of one meaning are one table, however they came about; other plans are others."""
    kept = Kept()
    rows = spark.createDataFrame([(i, i % 3) for i in range(9)], "a long, b long")
    one = kept.once(rows.where("a > 2").select("b").distinct())
    two = kept.once(rows.where(F.col("a") > 2).select("b").distinct())
    other = kept.once(rows.where("a > 6").select("b").distinct())
    assert (kept.asked, kept.built) == (3, 2)
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, two.collect())) == [(0,), (1,), (2,)] and len(other.collect()) == 2


def test_rules_build_each_shared_set_once(spark):
    code = project(spark, CLASSES)
    first = rules(code)
    built = code.kept.built
    assert 0 < built < code.kept.asked  # several rules ask for one set
    again = rules(code)
    assert code.kept.built == built
    assert sorted(map(repr, again["no-impure-functions"].findings().collect())) == sorted(map(repr, first["no-impure-functions"].findings().collect()))


DIFF = """noise
@@ nowhere @@
--- a/old.py
+++ b/new.py\t2020
@@ -1 +1 @@
+a
-b
--- a/x.py
+++ b/x.py
@@ -1 +1 @@
@@ -9 +9 @@
 c
diff --git a/p.py b/q.py
similarity index 100%
diff --git a/r.py b/r.py
--- /dev/null
+++ b/r2.py
+d
++++ e
"""


def test_sections_of_a_diff(spark):
    rows = spark.createDataFrame([(1, DIFF), (2, "nothing\n"), (3, None), (None, DIFF)], "id long, text string")
    got = [tuple(r) for r in summaries.diff_sections(rows, "text", "id").orderBy("section").collect()]
    assert got == [(1, 1, "new.py", 1, 1, 1, 4, 8), (1, 2, "x.py", 0, 0, 2, 9, 12), (1, 3, "q.py", 0, 0, 0, 13, 14), (1, 4, "r2.py", 2, 0, 0, 15, 19)]


def test_summaries_fit(spark):
    """Every format is cut until it fits, and what claims a format without having it is a text."""
    long_ = "\n".join(f"line {i} " + "x" * (i % 200) for i in range(300))
    texts = {
        "diff": "\n".join(f"diff --git a/f{i}.py b/f{i}.py\n@@ -1 +1 @@\n+a" for i in range(40)),
        "search": "\n".join(f"some/path/file{i % 30}.py:{i}: hit" for i in range(90)),
        "pytest": "===== test session starts =====\n...\n===== 3 passed, 1 failed in 0.1s =====",
        "json": '{"a": [1, 2], "b": "c"}',
        "text": long_,
        "claims": "@@ -1 +1 @@\nno file begins",
        "empty": "",
        "null": None,
    }
    rows = spark.createDataFrame(list(texts.items()), "id string, text string")
    for most in (4096, 600, 200):
        got = {r["id"]: (r["format"], json.loads(r["summary"])) for r in summaries.summaries(rows, "text", "id", most_bytes=most).collect()}
        assert {k: f for k, (f, _) in got.items()} == {k: k if k in ("diff", "search", "pytest", "json") else "text" for k in texts}
        assert all(len(json.dumps(s, separators=(",", ":")).encode()) <= most for k, (_, s) in got.items())
        assert got["diff"][1]["files"] == 40 and got["diff"][1]["added"] == 40 and got["search"][1]["paths"] == 30
        assert (got["pytest"][1]["passed"], got["pytest"][1]["failed"]) == (3, 1) and got["empty"][1]["lines"] == 0
    fine = {r["id"]: json.loads(r["summary"]) for r in summaries.summaries(rows, "text", "id", most_bytes=4096).collect()}
    assert [x["path"] for x in fine["diff"]["shown"]] == [f"f{i}.py" for i in range(8)]
    assert fine["search"]["shown"][0] == {"path": "some/path/file0.py", "matches": 3} and len(fine["search"]["shown"]) == 8
    assert fine["text"]["head"][0] == "line 0 " and fine["text"]["tail"][-1].startswith("line 299 ")


def test_sources_are_dealt_out_before_they_grow(spark):
    rows = spark.range(1200).coalesce(1).select(F.col("id").alias("k"))
    files = shop.written(rows, "src/m{k}.py", "a = {k}\n")
    assert files.rdd.getNumPartitions() == -(-1200 // shop.FILES_PER_TASK) > 1
    assert {(r["path"], bytes(r["content"])) for r in files.collect()} == {(f"src/m{k}.py", f"a = {k}\n".encode()) for k in range(1200)}
    assert shop.written(rows.limit(0), "src/m{k}.py", "").count() == 0


def test_import_cycles_are_found_once(spark, monkeypatch):
    found = []
    real = code.strong_components
    monkeypatch.setattr(code, "strong_components", lambda edges: found.append(1) or real(edges))
    one = Code(sample.sources(spark))
    rules(one)
    rules(one, library=True)
    assert len(found) == 1


def test_sections_of_odd_diffs(spark):
    """Sections are told as the patterns of Spark tell them, without a sort of all lines."""
    text = "+before\ndiff --git a/x b/y z\r\n--- a/x\n+++ b/y z\t2024\n@@ -1 +1 @@\n+a\n-b\n+++ b/\n+++ more\n@@\n--gone\n\n\n"
    rows = spark.createDataFrame([(1, text), (2, None), (None, text), (3, ""), (4, "no diff"), (5, "+++ \n")], "id long, text string")
    found = summaries.diff_sections(rows, "text", "id")
    assert [tuple(r) for r in found.orderBy("id", "section").collect()] == [(1, 1, "y z", 1, 1, 1, 2, 7), (1, 2, "more", 0, 1, 1, 8, 12), (5, 1, "?", 0, 0, 0, 1, 1)]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Sort" not in plan and "Window" not in plan


def test_the_contract_of_exports_builds_no_other_rule(spark, monkeypatch):
    monkeypatch.setattr(code, "strong_components", None)
    monkeypatch.setattr(code, "affected", None)
    found = depot.export_contract(spark, "/root/testdata/sf0.001").collect()
    assert {r["mode"] for r in found} == {"app", "other root"} and len(found) == 50


def test_shuffles_grow_in_number_with_the_sources(spark, monkeypatch):
    """Parts of a shuffle hold a bounded number of references; where there are few, the session's own number stays."""
    files = [(f"src/m{i}.py", f"import os\n\n\ndef f{i}(x):\n    return os.path.join(x, str(x))\n".encode()) for i in range(40)]
    rows = lambda: sorted(map(tuple, Code(spark.createDataFrame(files, "path string, content binary")).uses.select("file_path", "ord", "name", "definition").collect()))
    before = rows()
    assert spark.conf.get(python_code.FIRST_PARTS, None) is None
    monkeypatch.setattr(python_code, "REFS_PER_PART", 8)
    try:
        assert rows() == before
        n = Code(spark.createDataFrame(files, "path string, content binary")).raw["refs"].count()
        assert int(spark.conf.get(python_code.FIRST_PARTS)) == -(-n // 8) > 4
        python_code.deal_finer(spark, 5)
        assert int(spark.conf.get(python_code.FIRST_PARTS)) == -(-n // 8)
    finally:
        spark.conf.unset(python_code.FIRST_PARTS)


def test_a_task_reads_few_rows_of_a_stored_table(spark, monkeypatch):
    """Rows that are small on disk are read by as many tasks as their number asks for."""
    monkeypatch.setattr(shared, "ROWS_PER_FILE", 10)
    for by in (None, "part"):
        again = shared.stored(spark.range(2000).withColumn("part", F.lit("a")).coalesce(1), "few", by)
        assert sorted(r["id"] for r in again.collect()) == list(range(2000))
        assert again.groupBy(F.spark_partition_id().alias("task")).count().agg(F.max("count")).first()[0] <= 32 * 10
