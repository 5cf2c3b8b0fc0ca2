"""Patterns of each row's own, policies of effects, the order of findings, boundaries and rename conflicts on small cases."""

from __future__ import annotations

import random
from fnmatch import fnmatchcase

from pyspark.sql import functions as F

from latticework.catalog.code import Code, rules
from latticework.catalog.renames import conflicts
from latticework.catalog.units import Boundaries
from latticework.functions.effects import Policy
from latticework.functions.glob import glob_column
from latticework.plans.evidence import field
from latticework.plans.relation import Relation
from latticework.plans.rules import ordered
from tests.test_wrong_answers import project


def test_patterns_of_rows_equal_the_shell(spark):
    rng = random.Random(7)
    pieces = ["*", "?", "a", "b", ".", "(", "+", "[ab]", "[!a]", "[a-c]", "\\", "^", "{", "x y", "é"]
    rows = [("".join(rng.choice(pieces) for _ in range(rng.randint(0, 4))), "".join(rng.choice("ab.(+\\^{x yé") for _ in range(rng.randint(0, 5)))) for _ in range(400)]
    df = spark.createDataFrame(rows, "p string, s string").select("p", "s", F.regexp_like("s", glob_column(F.col("p"))).alias("hit"))
    assert [r for r in df.collect() if r["hit"] != fnmatchcase(r["s"], r["p"])] == []


def test_matches_takes_an_expression(spark):
    rows = spark.createDataFrame([("app.web", "app.*"), ("app", "app.*"), (None, "*"), ("a", None)], "name string, pattern string")
    got = Relation.of(rows, "name").where(field("name", "str").matches(field("pattern", "str"))).df.collect()
    assert [(r["name"], r["pattern"]) for r in got] == [("app.web", "app.*")]


def test_policy():
    p = Policy().extended(builtins=("audit",), functions=("db.commit",), io_methods=("send",), allow=("print", "write", "append"))
    assert "audit" in p.builtins and "print" not in p.builtins and "db.commit" in p.functions and "send" in p.io_methods
    assert "write" not in p.io_methods and "append" not in p.mutators and all("write" not in m for m in p.typed.values()) and "write" in Policy().io_methods


def test_findings_in_order(spark):
    rows = [("b", "p", 2, "m"), ("a", "q", 1, "m"), ("a", "p", 2, "n"), ("a", "p", 2, "m"), ("z", "p", 1, "m")]
    got = ordered(spark.createDataFrame(rows, "rule string, path string, line int, message string")).collect()
    assert [tuple(r) for r in got] == [("z", "p", 1, "m"), ("a", "p", 2, "m"), ("a", "p", 2, "n"), ("b", "p", 2, "m"), ("a", "q", 1, "m")]


LAYERED = {
    "src/firm/app/one.py": "from firm.domain.orders.order import Order\nfrom firm.domain import Bill\nimport os\n",
    "src/firm/domain/__init__.py": "from firm.domain.billing.bill import Bill\n",
    "src/firm/domain/orders/order.py": "from firm.domain.billing.bill import Bill\nclass Order:\n    pass\n",
    "src/firm/domain/billing/bill.py": "class Bill:\n    pass\n",
    "src/firm/zone/__init__.py": "",
    "src/firm/zone/a.py": "",
    "src/firm/__main__.py": "",
    "lib/other/x.py": "from firm.app.one import y\n",
}


def test_boundaries_of_nested_units(spark):
    code = project(spark, LAYERED)
    b = Boundaries({"app": ("domain.orders",), "domain.orders": ("domain",)}, ("domain.billing",), root="firm")
    got = sorted((r["path"].rpartition("/")[2], r["line"], r["message"]) for r in b.rule(code).findings().collect())
    assert got == [
        ("__init__.py", 1, "package 'domain' is not declared"),
        ("__init__.py", 1, "package 'zone' is not declared"),
        ("one.py", 2, "package 'app' may not import 'domain.billing' (via re-export 'firm.domain.Bill')"),
        ("order.py", 1, "package 'domain.orders' may not import 'domain.billing' (via 'firm.domain.billing.bill.Bill')"),
        ("pyproject.toml", 1, "'domain.orders' may import 'domain' but never does"),
    ]
    assert Boundaries(strict=False).rule(code).findings is not None and Boundaries(strict=False).rule(code).parts == ()
    every = {r["unit"] for r in Boundaries({"app": ()}).units(code).collect()}
    assert {"app", "x", "zone", "domain"} <= every  # each file's first name is its root


NAMES = """import os


def outer(a):
    x = a
    y = os.getcwd()

    def inner(z):
        return x + len(z)

    return inner, y
"""


def test_new_names(spark):
    code = project(spark, {"src/m.py": NAMES})
    asked = [("m:outer.x", "y"), ("m:outer.x", "z"), ("m:outer.x", "len"), ("m:outer.x", "os"), ("m:outer.x", "free"), ("m:outer.x", "x"), ("m:outer.x", "1x"), ("m:gone", "q"), ("m:outer.y", "z"), ("m:outer.x", "z"), (None, "q"), ("m:outer.x", None)]
    got = [(r["symbol_id"], r["new_name"], r["reason"]) for r in conflicts(code, spark.createDataFrame(asked, "symbol_id string, new_name string")).collect()]
    want = ["no-scope-name-conflict", "captured-by-inner-scope", "captures-outer-name", "captures-outer-name", "", "new-name-differs", "valid-identifier", "symbol-resolves-uniquely", "", "captured-by-inner-scope", "symbol-resolves-uniquely", "valid-identifier"]
    assert sorted(got, key=repr) == sorted(((*a, w) for a, w in zip(asked, want)), key=repr)


def test_dynamic_imports(spark):
    source = "import importlib\nimportlib.import_module('b.c')\n__import__('d')\n__import__(name)\nother.import_module('e')\nimport_module('f')\n"
    code = Code(spark.createDataFrame([("src/a.py", source.encode())], "path string, content binary"))
    got = code.symbols.where("import_confidence is not null").orderBy("line").collect()
    assert [(r["imported_from"], r["import_confidence"]) for r in got] == [("b.c", "heuristic"), ("d", "heuristic")]
    assert rules(code)["unused-imports"].findings().count() == 0
