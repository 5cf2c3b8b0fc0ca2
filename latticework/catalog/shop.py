"""A project written from the tables: a module for each supplier and nation, a test for each nation, a package that passes
names on. What a supplier's module does depends on its row, so that SQL over the tables can tell what must be found in it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from latticework.catalog.code import Code, rules
from latticework.catalog.tables import table
from latticework.catalog.universes import Universes
from latticework.plans.evidence import field
from latticework.plans.rules import rendered

SUPPLIER = '''"""Supplier {k}."""
import json
from shop import rate_{n} as rate
from shop.n{n} import log, _secret


def price_{k}(items, box):
    items.append(rate(box))
    return items


def Report_{k}(text) -> int:
    """Tell.

    :param text: what
    :param mode: how
    """
    log(text)
    return 1


def quiet_{k}(x):
    """Use."""
    return {body}


def chain_{k}(x):
    """Call."""
    return Report_{k}(x), _secret()
'''
NATION = '''"""Nation {n}."""


def rate(amount) -> int:
    """The rate."""
    return amount


def log(text):
    print(text)


def _secret():
    """Not for others."""
    return 1
'''
TEST = '''from shop.n{n} import log


def test_log():
    log(1)
'''
ROOT = "shop"
#: Files that one task writes and parses: a table of short rows, which Spark reads in one task, becomes a project a hundred times its size.
FILES_PER_TASK = 250


def written(df: DataFrame, path: str, text: str) -> DataFrame:
    """A file for each row: its path and content, with the row's columns filled in. The rows are dealt out before they grow."""
    df = df.repartition(-(-max(1, df.count()) // FILES_PER_TASK))
    return df.select(rendered(path, dict(df.dtypes)).alias("path"), rendered(text, dict(df.dtypes)).cast("binary").alias("content"))


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """path, content of the project's files."""

    body = F.when(F.col("s_acctbal") < 0, "missing_name").otherwise("json.dumps(x)")
    suppliers = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_nationkey").alias("n"), body.alias("body"))
    nations = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("n"))
    line = F.format_string("from shop.n%d import rate as rate_%d\n", "n", "n")
    package = nations.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", line.alias("line")))), lambda x: x["line"]), "").alias("all"))  # one line a nation
    out = written(suppliers, "src/shop/s{k}.py", SUPPLIER).unionByName(written(nations, "src/shop/n{n}.py", NATION))
    return out.unionByName(written(nations, "tests/test_n{n}.py", TEST)).unionByName(written(package, "src/shop/__init__.py", "{all}"))


# What there is in the files, by name: kind, scope, line, where an import comes from, annotation.
SHOP_CTES = """t AS (SELECT 'src/shop/s' || s_suppkey || '.py' AS file_path, 'shop.s' || s_suppkey AS m, s_suppkey AS k, s_nationkey AS n, s_acctbal < 0 AS debt FROM supplier),
u AS (SELECT 'src/shop/n' || n_nationkey || '.py' AS file_path, 'shop.n' || n_nationkey AS m, n_nationkey AS n, 'tests/test_n' || n_nationkey || '.py' AS test_path, 'tests.test_n' || n_nationkey AS tm,
 row_number() OVER (ORDER BY n_nationkey) AS line, EXISTS (SELECT 1 FROM supplier WHERE s_nationkey = n_nationkey) AS used FROM nation)"""

SYMBOLS_SQL = f"""WITH {SHOP_CTES}, a AS (
SELECT file_path, m || d.id AS symbol_id, d.kind, d.visibility, d.line, m || d.scope AS scope_id, d.source AS imported_from, d.annotation, k, n FROM t, (VALUES
 (':json', 'import', 'public', 2, '', 'json', NULL), (':rate', 'import', 'public', 3, '', 'shop.rate_@n', NULL), (':log', 'import', 'public', 4, '', 'shop.n@n.log', NULL), (':_secret', 'import', 'protected', 4, '', 'shop.n@n._secret', NULL),
 (':price_@k', 'function', 'public', 7, '', NULL, NULL), (':price_@k.items', 'parameter', 'public', 7, ':price_@k', NULL, NULL), (':price_@k.box', 'parameter', 'public', 7, ':price_@k', NULL, NULL),
 (':Report_@k', 'function', 'public', 12, '', NULL, 'int'), (':Report_@k.text', 'parameter', 'public', 12, ':Report_@k', NULL, NULL),
 (':quiet_@k', 'function', 'public', 22, '', NULL, NULL), (':quiet_@k.x', 'parameter', 'public', 22, ':quiet_@k', NULL, NULL),
 (':chain_@k', 'function', 'public', 27, '', NULL, NULL), (':chain_@k.x', 'parameter', 'public', 27, ':chain_@k', NULL, NULL)) d(id, kind, visibility, line, scope, source, annotation)
UNION ALL SELECT file_path, m || d.id, d.kind, d.visibility, d.line, m || d.scope, NULL, d.annotation, 0, n FROM u, (VALUES (':rate', 'function', 'public', 4, '', 'int'), (':rate.amount', 'parameter', 'public', 4, ':rate', NULL),
 (':log', 'function', 'public', 9, '', NULL), (':log.text', 'parameter', 'public', 9, ':log', NULL), (':_secret', 'function', 'protected', 13, '', NULL)) d(id, kind, visibility, line, scope, annotation)
UNION ALL SELECT test_path, tm || ':log', 'import', 'public', 1, tm, m || '.log', NULL, 0, n FROM u UNION ALL SELECT test_path, tm || ':test_log', 'function', 'public', 4, tm, NULL, NULL, 0, n FROM u
UNION ALL SELECT 'src/shop/__init__.py', 'shop:rate_' || n, 'import', 'public', line, 'shop', m || '.rate', NULL, 0, n FROM u)
SELECT file_path, replace(symbol_id, '@k', k::VARCHAR) AS symbol_id, kind, visibility, line::INTEGER AS line, replace(scope_id, '@k', k::VARCHAR) AS scope_id, replace(imported_from, '@n', n::VARCHAR) AS imported_from, annotation FROM a"""


def code_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Code(sources(spark, sf_dir)).symbols.select("file_path", "symbol_id", "kind", "visibility", "line", "scope_id", "imported_from", "annotation")


DEFINITIONS_SQL = f"""WITH {SHOP_CTES}
SELECT m || ':' || d.name AS symbol_id, 'shop.n' || n || ':' || d.name AS definition FROM t, (VALUES ('rate'), ('log'), ('_secret')) d(name)
UNION ALL SELECT 'shop:rate_' || n, m || ':rate' FROM u UNION ALL SELECT tm || ':log', m || ':log' FROM u"""


def code_definitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where imports lead, through the package that passes names on."""
    return Code(sources(spark, sf_dir)).definitions


IMPURITY_SQL = f"""WITH {SHOP_CTES}
SELECT m || ':log' AS function, 0::INTEGER AS depth FROM u UNION ALL SELECT tm || ':test_log', 1 FROM u
UNION ALL SELECT m || ':price_' || k, 0 FROM t UNION ALL SELECT m || ':Report_' || k, 1 FROM t UNION ALL SELECT m || ':chain_' || k, 2 FROM t"""


def code_impurity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Functions with effects, and how many calls away: a builtin, a change of a parameter, calls of those."""
    return Code(sources(spark, sf_dir)).impure


USES_SQL = f"""WITH {SHOP_CTES}
SELECT 'shop.n' || n || ':' || d.name AS definition, file_path, d.line::INTEGER AS line, 'call' AS kind, d.how FROM t, (VALUES ('rate', 8, 'barrel'), ('log', 18, 'import_alias'), ('_secret', 29, 'import_alias')) d(name, line, how)
UNION ALL SELECT m || ':log', test_path, 5, 'call', 'import_alias' FROM u"""


def code_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Uses of what the nations' modules define, and how each gets there: directly, by an import, through the package."""
    code = Code(sources(spark, sf_dir))
    return code.references_to(code.located.where("file_path like 'src/shop/n%' and kind = 'function'").select("symbol_id"))


IMPORTERS_SQL = f"""WITH {SHOP_CTES}
SELECT 'shop.n' || n || ':' || d.name AS definition, m || ':' || d.name AS symbol_id, file_path, d.line::INTEGER AS line FROM t, (VALUES ('rate', 3), ('log', 4), ('_secret', 4)) d(name, line)
UNION ALL SELECT m || ':rate', 'shop:rate_' || n, 'src/shop/__init__.py', line::INTEGER FROM u UNION ALL SELECT m || ':log', tm || ':log', test_path, 1 FROM u"""


def code_importers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Code(sources(spark, sf_dir)).importers.select("definition", "symbol_id", "file_path", "line")


VISIBLE_SQL = f"""WITH {SHOP_CTES}
SELECT file_path, 18::INTEGER AS line, replace(d.name, '@k', k::VARCHAR) AS name, m || ':' || replace(d.id, '@k', k::VARCHAR) AS symbol_id FROM t, (VALUES ('text', 'Report_@k.text'), ('json', 'json'), ('rate', 'rate'), ('log', 'log'), ('_secret', '_secret'),
 ('price_@k', 'price_@k'), ('Report_@k', 'Report_@k'), ('quiet_@k', 'quiet_@k'), ('chain_@k', 'chain_@k')) d(name, id)"""


def code_visible(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What can be read at line 18 of each supplier's module: its own parameter, then the module's names."""
    code = Code(sources(spark, sf_dir))
    return code.visible_at(code.raw["files"].where("file_path like 'src/shop/s%'").select("file_path", F.lit(18).alias("line")))


FINDINGS_SQL = f"""WITH {SHOP_CTES}, f AS (
SELECT d.rule, file_path AS path, d.line, d.message, k, n FROM t, (VALUES
 ('import-boundaries', 4, 's@k may not import n@n'), ('require-docstrings', 7, 'function ''price_@k'' has no docstring'), ('naming-conventions', 12, 'function ''Report_@k'' breaks the naming convention'),
 ('docstring-drift', 12, '''Report_@k'' documents ''mode'', which it doesn''t take'), ('no-argument-mutation', 8, 'argument ''items'' is changed by .append()'),
 ('unused-public-symbol', 7, 'function ''price_@k'' is never used'), ('unused-public-symbol', 22, 'function ''quiet_@k'' is never used'), ('unused-public-symbol', 27, 'function ''chain_@k'' is never used'),
 ('over-exposed-module-symbol', 12, 'function ''Report_@k'' is used only in shop.s@k'), ('under-exposed-access', 29, 'protected ''_secret'' of shop.n@n is used outside it'),
 ('no-impure-functions', 7, 'function ''price_@k'' is impure: method .append (line 8)'), ('no-impure-functions', 12, 'function ''Report_@k'' is impure: calls an impure function'), ('no-impure-functions', 27, 'function ''chain_@k'' is impure: calls an impure function')) d(rule, line, message)
UNION ALL SELECT 'no-unresolved-refs', file_path, 24, '''missing_name'' is not defined', k, n FROM t WHERE debt UNION ALL SELECT 'unused-imports', file_path, 2, '''json'' is imported but unused', k, n FROM t WHERE debt
UNION ALL SELECT 'require-docstrings', file_path, 9, 'function ''log'' has no docstring', 0, n FROM u UNION ALL SELECT 'require-docstrings', test_path, 4, 'function ''test_log'' has no docstring', 0, n FROM u
UNION ALL SELECT 'no-impure-functions', file_path, 9, 'function ''log'' is impure: builtin print (line 10)', 0, n FROM u UNION ALL SELECT 'no-impure-functions', test_path, 4, 'function ''test_log'' is impure: calls an impure function', 0, n FROM u
UNION ALL SELECT 'unused-public-symbol', test_path, 4, 'function ''test_log'' is never used', 0, n FROM u
UNION ALL SELECT 'test-only-production-code', file_path, 9, 'function ''log'' is used by tests only', 0, n FROM u WHERE NOT used
UNION ALL SELECT 'over-exposed-export', 'src/shop/__init__.py', line, '''rate_' || n || ''' is exported by shop but not used outside it', 0, n FROM u)
SELECT rule, path, line::INTEGER AS line, replace(replace(message, '@k', k::VARCHAR), '@n', n::VARCHAR) AS message, 'declared' AS confidence FROM f"""


def code_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All rules' findings in one bag."""
    code, out = Code(sources(spark, sf_dir)), None
    for rule in rules(code, ROOT, complete_docstrings=True).values():
        out = rule.findings() if out is None else out.unionByName(rule.findings())
    return out


FOLLOWED_SQL = f"""WITH {SHOP_CTES} SELECT file_path, 29::INTEGER AS line, 'Report_' || k AS name, 'call' AS kind FROM t"""


def code_symbol_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """symbols -> references: where the suppliers' functions are named in their own files."""
    u = Universes(Code(sources(spark, sf_dir)), "src/")
    return u.follow(u["symbols"].where(field("name").startswith("Report_", "price_")), "symbols", "references").df.select("file_path", "line", "name", "kind")


SCOPED_SQL = f"""WITH {SHOP_CTES} SELECT m || ':' || replace(d.id, '@k', k::VARCHAR) AS symbol_id FROM t, (VALUES ('price_@k.items'), ('price_@k.box'), ('Report_@k.text'), ('quiet_@k.x'), ('chain_@k.x')) d(id) UNION ALL SELECT m || ':' || d.id FROM u, (VALUES ('rate.amount'), ('log.text')) d(id)"""


def code_scope_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """scopes -> symbols, of functions: their parameters."""
    u = Universes(Code(sources(spark, sf_dir)))
    return u.follow(u["scopes"].where(field("kind").eq("function")), "scopes", "symbols").df.select("symbol_id")


PARENTS_SQL = f"""WITH {SHOP_CTES} SELECT file_path, m AS scope_id FROM t UNION ALL SELECT file_path, m FROM u UNION ALL SELECT test_path, tm FROM u"""


def code_scope_parents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """scopes -> parent: each module that has a function, once."""
    u = Universes(Code(sources(spark, sf_dir)))
    return u.follow(u["scopes"].where(field("kind").eq("function")), "scopes", "parent").df.select("file_path", "scope_id")


CALLED_SQL = f"""WITH {SHOP_CTES} SELECT m || ':Report_' || k AS symbol_id, file_path FROM t UNION ALL SELECT m || ':log', file_path FROM u UNION ALL SELECT m || d.id, file_path FROM u, (VALUES (':rate'), (':_secret')) d(id) WHERE used"""


def code_called_definitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """references -> definition, of calls: what is called anywhere, in its own file."""
    u = Universes(Code(sources(spark, sf_dir)))
    return u.follow(u["references"].where(field("kind").eq("call")), "references", "definition").df.select("symbol_id", "file_path")


TARGETS_SQL = f"""WITH {SHOP_CTES} SELECT m || ':log' AS symbol_id FROM u UNION ALL SELECT m || ':rate' FROM u UNION ALL SELECT m || ':_secret' FROM u WHERE used UNION ALL SELECT m || ':json' FROM t"""


def code_import_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """imports -> target: what is imported, each once; what no source defines stands for itself."""
    u = Universes(Code(sources(spark, sf_dir)))
    return u.follow(u["imports"], "imports", "target").df.select("symbol_id")


FOUND_SQL = f"""WITH {SHOP_CTES} SELECT m || ':rate' AS symbol_id, 'import' AS kind FROM t UNION ALL SELECT m || ':rate', 'function' FROM u"""


def code_find_symbol(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Universes(Code(sources(spark, sf_dir))).find_symbol("rate").df.select("symbol_id", "kind")


QUERIES = {f.__name__: f for f in (code_symbols, code_definitions, code_impurity, code_references, code_importers, code_visible, code_findings, code_symbol_references, code_scope_symbols, code_scope_parents, code_called_definitions, code_import_targets, code_find_symbol)}
SQL = {"code_symbols": SYMBOLS_SQL, "code_definitions": DEFINITIONS_SQL, "code_impurity": IMPURITY_SQL, "code_references": USES_SQL, "code_importers": IMPORTERS_SQL, "code_visible": VISIBLE_SQL, "code_findings": FINDINGS_SQL, "code_symbol_references": FOLLOWED_SQL, "code_scope_symbols": SCOPED_SQL, "code_scope_parents": PARENTS_SQL, "code_called_definitions": CALLED_SQL, "code_import_targets": TARGETS_SQL, "code_find_symbol": FOUND_SQL}
