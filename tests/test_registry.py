"""Traits, facts, expressions and rules by name; universes and their steps; error codes; layers and names."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from latticework.catalog.code import Code
from latticework.catalog.sample import sources
from latticework.catalog.universes import Universes
from latticework.functions import captures, names
from latticework.operators import layers
from latticework.plans import errors
from latticework.plans.evidence import DECLARED, HEURISTIC, constant, field
from latticework.plans.registry import Registry
from latticework.plans.relation import FILE, PROJECT, Relation, decisions
from latticework.plans.rules import Part, Rule


@pytest.fixture(scope="module")
def things(spark):
    return Relation.of(spark.createDataFrame([("a", 1), ("b", 2), ("c", 3)], "id string, n int"), "id")


def test_traits(spark, things):
    r = Registry()
    r.register_trait("size", lambda corpus: corpus.createDataFrame([("a", "small", DECLARED), ("b", "large", HEURISTIC)], "id string, v string, c int"))
    got = {x["id"]: (x["size"], x["size_conf"]) for x in r.with_trait(things, "size", spark).df.collect()}
    assert got == {"a": ("small", 3), "b": ("large", 1), "c": (None, 0)}
    with pytest.raises(errors.UnknownTrait):
        r.with_trait(things, "weight", spark)
    with pytest.raises(errors.DerivedField):
        r.with_trait(things, "size", spark, as_="n")
    with pytest.raises(errors.TraitShadowed):
        r.register_trait("size", lambda corpus: None, owner="another")
    r.register_trait("size", lambda corpus: corpus.createDataFrame([("a", "tiny")], "id string, v string"))  # its owner may
    assert {x["size"] for x in r.with_trait(things, "size", spark).df.collect()} == {"tiny", None}
    r.trait("big", lambda corpus: things, field("n").eq(3))
    assert {x["id"]: x["big"] for x in r.with_trait(things, "big", spark).df.collect()} == {"a": False, "b": False, "c": True}


def test_reach(spark, things):
    looked = things.with_membership("known", "id", spark.createDataFrame([("a",)], "x string"))
    assert looked.reach(field("n").eq(1)) == FILE and looked.reach(field("known", "bool")) == PROJECT
    assert looked.with_field("again", field("known", "bool")).reach(field("again", "bool")) == PROJECT
    r = Registry()
    r.trait("known", lambda corpus: looked, field("known", "bool"))
    with pytest.raises(errors.ReachRefused):
        r.with_trait(things, "known", spark)


def test_facts_expressions_rules(spark, things):
    r = Registry()
    r.register_fact("uses", lambda corpus, at_least=0: corpus.createDataFrame([("a", 5), ("b", 1)], "id string, uses int").where(F.col("uses") >= at_least))
    assert {x["id"]: x["uses"] for x in r.with_fact(things, "uses", spark, at_least=2).df.collect()} == {"a": 5, "b": None, "c": None}
    source = r.fact_source("uses", spark, "id", "uses")
    assert source.fields == ("id", "uses") and source.df.count() == 2
    with pytest.raises(errors.UnknownFact):
        r.with_fact(things, "none", spark)
    r.expressions["is-two"] = lambda: field("n").eq(2)
    assert [x["id"] for x in things.where(r.expression("is-two")).df.collect()] == ["b"]
    with pytest.raises(errors.UnknownExpression):
        r.expression("is-three")
    r.register_rule("twos", lambda corpus: Rule("twos", (Part(things.where(r.expression("is-two")), "{id} is two", "id"),)))
    assert [tuple(x) for x in r.findings(spark).collect()] == [("twos", "b", 1, "b is two", "declared")]


def test_error_codes(things):
    for act, code in (
        (lambda: things.where(field("m").eq(1)), "unknown-field"),
        (lambda: things.with_field("n", constant(1)), "derived-field"),
        (lambda: decisions(things, "not a name", DECLARED, {}), "unplannable-mutation"),
        (lambda: decisions(things, "rename", DECLARED, {"x": constant("text")}), "mutation-precondition"),
    ):
        with pytest.raises(errors.AuthoringError) as e:
            act()
        assert e.value.as_fields()["code"] == code
    codes = [c.code for c in (errors.AuthoringError, *errors.AuthoringError.__subclasses__(), *errors.AnchorError.__subclasses__())]
    assert len(set(codes)) == len(codes) == 16


def test_universes(spark):
    u = Universes(Code(sources(spark)))
    with pytest.raises(errors.UnknownUniverse):
        u["classes"]
    with pytest.raises(errors.UnknownFollow):
        u.follow(u["modules"], "modules", "parent")
    model = u["symbols"].where(field("symbol_id").eq("app.core.model:Model.save"))
    assert [r["name"] for r in u.follow(model, "symbols", "scope").df.collect()] == ["Model"]
    assert [r["file_path"] for r in u.follow(model, "symbols", "module").df.collect()] == ["src/app/core/model.py"]
    imported = u["imports"].where(field("file_path").eq("src/app/web/view.py"))
    assert {r["symbol_id"] for r in u.follow(imported, "imports", "target").df.collect()} >= {"app.core.model:Model", "app.core.model:helper", "app.core.model:_private"}
    assert [r["name"] for r in u.members("app.core.model:Model").collect()] == ["save", "_inner"]
    assert [r["name"] for r in u.document_symbols("src/app/web/plain.py").collect()] == ["used_here"]
    assert u.references_to_binding("app.web.plain:used_here").count() == 1
    assert u.anchor("used_here") == "app.web.plain:used_here"
    with pytest.raises(errors.AmbiguousAnchor) as e:
        u.anchor("Model")
    assert "app.core.model:Model" in e.value.as_fields()["candidates"]
    with pytest.raises(errors.UnresolvedAnchor) as e:
        u.anchor("lone")
    assert e.value.as_fields() == {"code": "unresolved-anchor", "message": "no symbol 'lone'", "candidates": ["app.core.store:Lonely"]}
    assert {r["file_path"] for r in Universes(u.code, "tests/")["modules"].df.collect()} == {"tests/test_store.py"}


def test_layers_and_names(spark):
    old, new = (spark.createDataFrame([(x,) for x in xs], "x string") for xs in (["a", "a", "b"], ["a", "b", "b", "c"]))
    assert {(r["side"], r["x"], r["n"]) for r in layers.both_ways(old, new).collect()} == {("old", "a", 1), ("new", "b", 1), ("new", "c", 1)}
    df = spark.createDataFrame([("a.b:C.d", "list['X', \"p.Y[X]\"]", ["app.route('/')", "cache"]), ("m:f", None, None)], "id string, note string, by array<string>")
    got = [tuple(r) for r in df.select(names.replace_leaf(F.col("id"), F.lit("new")), names.forward_names(F.col("note")), names.decorated_by(F.col("by"), "app.*")).collect()]
    assert got == [("a.b:C.new", ["X", "p", "Y"], True), ("m:new", None, False)]
    words = spark.createDataFrame([(x,) for x in ("a", "_b1", "1a", "class", "a b", "")], "w string")
    assert [r[0] for r in words.select(names.is_identifier(F.col("w"))).collect()] == [True, True, False, False, False, False]
    days = spark.createDataFrame([(i, 1) for i in range(-2500, 2500)], "d long, b long")
    assert all(r["total"] == r["d"] + 2501 for r in captures.running(days, F.col("d"), "b").collect())
