"""Each expression on NULL, empty and unmatched values; relations; rules; graphs; names; captures; streams."""

from __future__ import annotations

import itertools
import json
from fnmatch import fnmatchcase

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from latticework.functions import captures, names
from latticework.functions.glob import glob_to_regex
from latticework.operators import graph, intervals, ranking
from latticework.plans.evidence import DECLARED, HEURISTIC, INFERRED, UNKNOWN, all_of, any_of, constant, field, not_, opaque, weakened_when, why
from latticework.plans.relation import AuthoringError, Relation
from latticework.plans.rules import Part, Rule
from latticework.streaming import ingest


@pytest.fixture(scope="module")
def one(spark):
    return spark.createDataFrame([(None, "", "x", [], ["a.b", "a.bc"], 0, True, None)], "n string, e string, s string, z array<string>, a array<string>, i int, t boolean, u boolean")


def value(df, e):
    r = df.select(e.value.alias("v"), e.confidence.alias("c"), e.matched.alias("m")).first()
    return (r["v"] if r["m"] else "unmatched"), r["c"]


def test_comparisons(one):
    n, e, s, a = field("n", "str"), field("e", "str"), field("s", "str"), field("a", "array")
    for got, want in (
        (n.eq(None), True), (e.eq(None), False), (n.ne("x"), True), (s.ne("x"), False), (n.is_in("x"), False), (n.is_in("x", None), True), (s.is_in(), False), (n.matches("*"), False), (s.matches("?"), True),
        (n.startswith("x"), False), (s.startswith("a", "x"), True), (e.is_true(), False), (s.is_true(), True), (field("z", "array").is_true(), False), (field("i", "num").is_true(), False), (field("u", "bool").is_true(), False),
        (a.any_other_than("a.b"), True), (a.any_outside("a"), False), (a.any_outside("a.b"), True), (field("z", "array").any_other_than("q"), False), (constant("pkgx").is_within("pkg"), False), (constant("pkg.x").is_within("pkg"), True), (n.is_within("a"), False),
        (not_(n.eq("x")), True), (not_(field("u", "bool")), True),
    ):
        assert value(one, got) == (want, DECLARED), got.op


def test_unmatched_compares_false(one):
    weak = constant("x", HEURISTIC).at(DECLARED)
    assert value(one, weak)[0] == "unmatched"
    for e in (weak.eq("x"), weak.ne("x"), weak.ne(None), weak.is_in("x"), weak.is_true(), weak.matches("*"), weak.startswith("x")):
        assert value(one, e) == (False, DECLARED)
    assert value(one, not_(weak)) == (True, DECLARED)
    assert value(one, constant("x", HEURISTIC).at(HEURISTIC).eq("x")) == (True, DECLARED)
    assert value(one, constant("x", HEURISTIC).how_sure()) == (HEURISTIC, DECLARED)


def test_confidence_of_disjunctions(one):
    yes = {c: opaque("y", lambda _: F.lit(True), constant(1, c), kind="bool") for c in range(4)}
    no = {c: opaque("n", lambda _: F.lit(False), constant(1, c), kind="bool") for c in range(4)}
    assert value(one, any_of(yes[1], yes[3])) == (True, 1)
    assert value(one, any_of(no[0], yes[3])) == (True, 3)
    assert value(one, any_of(no[1], no[3])) == (False, 1)
    assert value(one, any_of()) == (False, DECLARED)
    assert value(one, all_of()) == (True, DECLARED)
    for parts in itertools.permutations((yes[1], yes[2], no[0])):
        assert value(one, all_of(*parts)) == (False, 0)
    assert value(one, weakened_when(yes[3], INFERRED)) == (True, INFERRED)
    assert value(one, weakened_when(no[3], INFERRED)) == (True, DECLARED)


def test_struct_attribute(spark):
    df = spark.sql("select named_struct('x', 1) as p, cast(null as struct<x:int>) as q")
    assert value(df, field("p").attr("x")) == (1, DECLARED)
    assert value(df, field("q").attr("x")) == (None, UNKNOWN)


def test_why_is_json(one):
    text = one.select(why(all_of(field("s", "str").eq("x"), not_(field("n", "str").eq("y")))).alias("w")).first()["w"]
    tree = json.loads(text)
    assert tree["op"] == "all_of" and [x["op"] for x in tree["inputs"]] == ["eq", "not"] and tree["reads"] == "n,s"


def test_authoring_errors(one):
    r = Relation.of(one, "s")
    for wrong in (lambda: r.where(field("nope").eq(1)), lambda: r.with_field("s", constant(1)), lambda: r.project("s").where(field("e").eq("")), lambda: r.follow(r, {"nope": "s"}), lambda: Rule("x").findings(), lambda: Rule("x", (Part(r, "{nope}", "s"),)).findings()):
        with pytest.raises(AuthoringError):
            wrong()


def test_membership_of_null(spark):
    left = Relation.of(spark.createDataFrame([(1, "a"), (2, None), (3, "b")], "i int, k string"), "i")
    members = spark.createDataFrame([("a",), ("a",), (None,)], "k string")
    got = left.with_membership("m", "k", members).frame(None).orderBy("i").collect()
    assert [(r["i"], r["m"]) for r in got] == [(1, True), (2, False), (3, False)]


def test_first_path_decides(spark):
    source = Relation.of(spark.createDataFrame([(1, "t", 1), (2, "t", 3), (3, "u", 2)], "i int, k string, c int"), "i", evidence="c")
    target = Relation.of(spark.createDataFrame([("t", 9), ("u", 8)], "k string, v int"), "k")
    got = {r["k"]: r["evidence"] for r in source.follow(target, {"k": "k"}).frame().collect()}
    assert got == {"t": 1, "u": 2}


def test_messages(spark):
    r = Relation.of(spark.createDataFrame([("p", None, True, 3)], "p string, n string, b boolean, i int"), "p")
    assert Rule("x", (Part(r, "{n} {b} {i}", "p", "i"),)).findings().first()["message"] == "None True 3"


@settings(max_examples=60, deadline=None)
@given(st.text("ab*?[]!^\\.-/", max_size=7), st.text("ab*?[]!^\\.-/", max_size=7))
def test_globs(pattern, text):
    import re

    if "[" in pattern and ("-" in pattern or "\\" in pattern or "^" in pattern or "!" in pattern):
        return
    wanted = fnmatchcase(text, pattern)
    assert bool(re.match(glob_to_regex(pattern).replace(r"\z", r"\Z"), text)) == wanted


def test_names(spark):
    df = spark.createDataFrame([("a.b:C.d$2", "__x", "HTTPServerError", "Optional[a.B]"), ("<unresolved>.attr", "__init__", "some_name", "B[int]"), ("m", "_p", "already", "B | C"), ("a.b:c", "____", "x-y z", "Union[B, C]")], "s string, n string, c string, t string")
    got = df.select(names.module_of(F.col("s")), names.leaf_name(F.col("s")), names.strip_shadow(F.col("s")), names.shadow_suffix(F.col("s")), names.visibility(F.col("n")), names.snake_case(F.col("c")), names.pascal_case(F.col("c")), names.bare_type(F.col("t"))).collect()
    assert [tuple(r) for r in got] == [
        ("a.b", "d$2", "a.b:C.d", 2, "private", "http_server_error", "HTTPServerError", "B"),
        ("<unresolved>.attr", "attr", "<unresolved>.attr", None, "dunder", "some_name", "SomeName", "B"),
        ("m", "m", "m", None, "protected", "already", "Already", "B"),
        ("a.b", "c", "a.b:c", None, "private", "x_y_z", "XYZ", "B"),
    ]


def test_paths_and_containment(spark):
    df = spark.createDataFrame([("src/a/b.py", "a.b:C.d", "a.b:C"), ("src/a/__init__.py", "a.b:Cx", "a.b:C"), ("__init__.py", "a.b:C", "a.b:C")], "p string, s string, q string")
    got = df.select(names.module_path(F.col("p")), names.affects(F.col("s"), F.col("q"))).collect()
    assert [tuple(r) for r in got] == [("a.b", True), ("a", False), ("", True)]


def test_captures(spark):
    texts = {"json": '{"a": [1]}', "diff": "diff --git a/x b/x\n--- a/x\n+++ b/x\n@@ -1,2 +1,2 @@\n-a\n+b\n+c\n", "pytest": "=== test session starts ===\n1\n=== 3 passed, 2 failed in 1s ===", "search": "a.py:1:x\nb.py:2:y\na.py:3:z\n", "text": "{not json\nhello"}
    df = spark.createDataFrame(list(texts.items()), "id string, t string")
    assert {r["id"]: r["f"] for r in df.select("id", captures.detect_format(F.col("t")).alias("f")).collect()} == {k: k for k in texts}
    assert {(r["path"], r["matches"]) for r in captures.search_tally(df.where("id = 'search'"), "t", "id").collect()} == {("a.py", 2), ("b.py", 1)}
    r = captures.diff_totals(df.where("id = 'diff'"), "t", "id").first()
    assert (r["files"], r["hunks"], r["added"], r["removed"]) == (1, 1, 2, 1)
    assert df.where("id = 'pytest'").select(captures.pytest_tally(F.col("t"), "passed"), captures.pytest_tally(F.col("t"), "failed"), captures.pytest_tally(F.col("t"), "skipped")).first() == (3, 2, 0)
    assert df.where("id = 'search'").select(captures.excerpt(F.col("t"), 1, 1)).first()[0] == "a.py:1:x\n… 2 lines …\n"
    assert df.where("id = 'text'").select(captures.clip_line(F.lit("abcdef"), 4)).first()[0] == "abc…"


@settings(max_examples=5, deadline=None)
@given(st.sets(st.tuples(st.integers(0, 6), st.integers(0, 6)), min_size=1, max_size=12))
def test_strong_components(spark, edges):
    reach = {n: {n} for e in edges for n in e}
    for _ in range(8):
        for a, b in edges:
            for s in reach.values():
                if a in s:
                    s.add(b)
    want = {n: min(m for m in reach if m in reach[n] and n in reach[m]) for n in reach if any(m != n and m in reach[n] and n in reach[m] for m in reach)}
    got = {r["node"]: r["component"] for r in graph.strong_components(spark.createDataFrame(sorted(edges), "a long, b long")).collect()}
    assert got == want


def test_chase_ends_at_the_repeated_name(spark):
    df = spark.createDataFrame([("x", "a"), ("a", "b"), ("b", "a"), ("p", "q"), ("q", "r")], "name string, target string")
    got = {r["name"]: r["final"] for r in graph.chased(df).collect()}
    assert got == {"x": "a", "a": "a", "b": "b", "p": "r", "q": "r"}


def test_innermost_ties(spark):
    points = spark.createDataFrame([("f", 5), ("f", 99), ("g", 5)], "f string, p int")
    spans = spark.createDataFrame([("f", 1, 9, "outer"), ("f", 4, 6, "b"), ("f", 4, 6, "a"), ("f", 5, 7, "later")], "f string, s int, e int, n string")
    got = {(r["f"], r["p"]): r["innermost"] for r in intervals.innermost(points, spans, "f", "p", "s", "e", "n").collect()}
    assert got == {("f", 5): "a", ("f", 99): None, ("g", 5): None}


def test_top_text(spark):
    df = spark.createDataFrame([("a", i) for i in range(5)] + [("b", 1)], "k string, i int")
    got = {r["k"]: (r["n"], r["shown"]) for r in ranking.top_text(df, ["k"], ["i"], F.col("i").cast("string")).collect()}
    assert got == {"a": (5, "0, 1, 2 +2 more"), "b": (1, "1")}


def test_streams(spark, tmp_path):
    rows = spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (2, 1, "c")], "k int, v int, x string")
    rows.where("v = 1").write.mode("append").parquet(str(tmp_path / "in"))
    stream = lambda: spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    out, checkpoint = str(tmp_path / "out"), str(tmp_path / "check")
    ingest.upserted(stream(), out, "k", "v", checkpoint).awaitTermination()
    rows.where("v = 2").write.mode("append").parquet(str(tmp_path / "in"))
    ingest.upserted(stream(), out, "k", "v", checkpoint).awaitTermination()
    got = {r["k"]: r["x"] for r in ingest.latest(spark.read.parquet(out), "k", "v").collect()}
    assert got == {1: "b", 2: "c"}
    events = spark.sql("select timestamp'2024-01-01 00:10:00' + make_dt_interval(0, 0, cast(id as int)) as ts, 'a' as kind from range(100)")
    events.write.parquet(str(tmp_path / "ev"))
    counts = ingest.run_once(spark.readStream.schema(events.schema).parquet(str(tmp_path / "ev")), "counts", str(tmp_path / "c2"), lambda s: ingest.windowed_counts(s, "ts", ["kind"]), mode="complete")
    assert sum(r["n"] for r in counts.collect()) == 100


def test_json_shape_and_eviction(spark):
    df = spark.createDataFrame([('{"a": [1]}',), ("{not",)], "t string")
    assert [r[0] for r in df.select(captures.json_shape(F.col("t"))).collect()] == ["OBJECT<a: ARRAY<BIGINT>>", None]
    rows = spark.sql("select id, timestamp'2024-01-10 00:00:00' - make_dt_interval(cast(id as int)) as at, 10 as bytes from range(6)")
    gone = captures.evicted(rows, "at", "bytes", F.lit("2024-01-10 00:00:00").cast("timestamp"), ttl_days=4, most_bytes=30)
    assert sorted(r["id"] for r in gone.collect()) == [3, 4, 5]
