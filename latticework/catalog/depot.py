"""A second project written from the tables, of classes: inherited methods, typed and inferred receivers, members set by self, lists that
stay or go, stars, globals. What a supplier's module does depends on its row, so that SQL over the tables tells what must be found in it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from latticework.catalog import shop
from latticework.catalog.code import Code, over_exposed_export, rules
from latticework.catalog.renames import conflicts
from latticework.catalog.shop import written
from latticework.catalog.tables import table
from latticework.catalog.units import Boundaries
from latticework.catalog.universes import Universes
from latticework.functions import names
from latticework.functions.effects import Policy
from latticework.plans.evidence import field
from latticework.plans.rules import rendered

REGION = '''class Base{r}:
    def say(self):
        print(1)

    def go(self):
        self.say()

    def calm(self) -> int:
        return 1


def spare{r}():
    return 0


def _hidden{r}():
    return 0
'''
NATION = '''from depot.base{r} import Base{r}


class Store{n}(Base{r}):
    twin: Base{r}

    def run(self):
        self.go()

    def deep(self):
        self.twin.say()

    def rest(self):
        return self.calm()


def make{n}() -> Store{n}:
    return Store{n}()
'''
SUPPLIER = '''from depot.n{n} import Store{n}, make{n}
import depot.n{n} as place
count = 0
table = {}


class Office:
    def __init__(self, given: "Store{n}"):
        self.given = given
        self.built = Store{n}()
        self.kept: Store{n} = given
        self.built = None

    def inferred(self):
        self.built.run()

    def declared(self):
        self.kept.twin.say()

    def unknown(self):
        self.given.run()

    def filed(self, key):
        self.files[key] = 1

    def helper(self):
        self.inferred()


def typed(s: Store{n}):
    s.run()


def local():
    s = make{n}()
    {call}


def parted():
    s, t = make{n}()
    s.go()


def through():
    place.make{n}().go()


def lists(z):
    kept = [1, 2]
    given = [3]
    looped = [i for i in kept]
    if z in kept:
        return kept[0]
    for v in looped:
        pass
    return given


def total():
    global count
    count = 2
    table[1] = 2


def promise() -> int:
    return 1


def broken():
    promise()


def shown() -> int:
    return 1


def taken():
    shown()
    return shown
'''
STARRED = '''from depot.base{r} import *
from depot.other{r} import *
from elsewhere import *


def use():
    return spare{r}() + extra{r}() + nowhere()
'''
OTHER = '''def spare{r}():
    return 1


def extra{r}():
    return 2
'''


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """path, content of the project's files: one for each supplier and nation, three for each region."""
    call = F.when(F.col("s_acctbal") < 0, "s.deep()").otherwise("s.rest()")
    suppliers = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_nationkey").alias("n"), call.alias("call"))
    nations = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("n"), F.col("n_regionkey").alias("r"))
    regions = table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("r"))
    out = written(suppliers, "src/depot/s{k}.py", SUPPLIER).unionByName(written(nations, "src/depot/n{n}.py", NATION))
    for path, text in (("src/depot/base{r}.py", REGION), ("src/depot/other{r}.py", OTHER), ("src/depot/star{r}.py", STARRED)):
        out = out.unionByName(written(regions, path, text))
    return out


CTES = """t AS (SELECT 'src/depot/s' || s_suppkey || '.py' AS file_path, 'depot.s' || s_suppkey AS m, s_suppkey AS k, s_nationkey AS n, n_regionkey AS r, s_acctbal < 0 AS debt FROM supplier JOIN nation ON n_nationkey = s_nationkey),
u AS (SELECT 'src/depot/n' || n_nationkey || '.py' AS file_path, 'depot.n' || n_nationkey AS m, n_nationkey AS n, n_regionkey AS r FROM nation),
v AS (SELECT 'src/depot/base' || r_regionkey || '.py' AS file_path, 'depot.base' || r_regionkey AS m, r_regionkey AS r FROM region)"""

IMPURITY_SQL = f"""WITH {CTES}
SELECT m || ':Base' || r || '.' || d.f AS function, d.depth::INTEGER AS depth FROM v, (VALUES ('say', 0), ('go', 1)) d(f, depth)
UNION ALL SELECT m || ':Store' || n || '.' || d.f, d.depth FROM u, (VALUES ('run', 2), ('deep', 1)) d(f, depth)
UNION ALL SELECT m || d.f, d.depth FROM t, (VALUES (':Office.inferred', 3), (':Office.declared', 1), (':Office.helper', 4), (':typed', 3), (':total', 0)) d(f, depth)
UNION ALL SELECT m || ':local', 2 FROM t WHERE debt"""


def receiver_impurity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Effects that are reached by self, by inherited methods, by typed and inferred receivers and by members of members."""
    return Code(sources(spark, sf_dir)).impure


MEMBERS_SQL = f"""WITH {CTES}
SELECT m || ':Office' AS container, d.name, m || ':Office.' || d.name AS member, d.sure FROM t, (VALUES ('given', NULL), ('built', 'inferred'), ('kept', 'declared')) d(name, sure)
UNION ALL SELECT m || ':Store' || n, 'twin', m || ':Store' || n || '.twin', 'declared' FROM u"""


def self_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields of classes: those written in the class and those that a method stores to self, each once."""
    code = Code(sources(spark, sf_dir))
    fields = code.members.where("own").join(code.symbols.where("kind = 'variable' and scope_kind = 'class'").select(F.col("symbol_id").alias("member"), "annotation_confidence"), "member")
    return fields.select("container", "name", "member", F.col("annotation_confidence").alias("sure"))


INHERITED_SQL = f"""WITH {CTES}
SELECT u.m || ':Store' || n AS container, d.name, 'depot.base' || r || ':Base' || r || '.' || d.name AS member FROM u, (VALUES ('say'), ('go'), ('calm')) d(name)"""


def inherited_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What classes have from their bases in other files."""
    return Code(sources(spark, sf_dir)).members.where("not own").select("container", "name", "member")


USES_SQL = f"""WITH {CTES}
SELECT 'depot.base' || r || ':Base' || r || '.say' AS definition, file_path, 6::INTEGER AS line, 'direct' AS how FROM v
UNION ALL SELECT 'depot.base' || r || ':Base' || r || '.go', file_path, 8, 'receiver_declared' FROM u
UNION ALL SELECT 'depot.base' || r || ':Base' || r || '.say', file_path, 11, 'receiver_declared' FROM u
UNION ALL SELECT 'depot.base' || r || ':Base' || r || '.calm', file_path, 14, 'receiver_declared' FROM u
UNION ALL SELECT 'depot.n' || n || ':Store' || n || '.run', file_path, 15, 'receiver_inferred' FROM t
UNION ALL SELECT 'depot.base' || r || ':Base' || r || '.say', file_path, 18, 'receiver_declared' FROM t
UNION ALL SELECT 'depot.n' || n || ':Store' || n || '.run', file_path, 31, 'receiver_declared' FROM t
UNION ALL SELECT 'depot.n' || n || ':Store' || n || '.' || CASE WHEN debt THEN 'deep' ELSE 'rest' END, file_path, 36, 'receiver_inferred' FROM t
UNION ALL SELECT m || ':Office.inferred', file_path, 27, 'direct' FROM t"""


def receiver_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls of methods, and how each gets to its method."""
    code = Code(sources(spark, sf_dir))
    found = code.references_to(code.located.where("kind = 'method'").select("symbol_id"))
    return found.where("kind = 'attribute-call'").select("definition", "file_path", "line", "how")


MUTATION_SQL = f"""WITH {CTES}
SELECT m || d.id AS symbol_id, d.w AS has_write_ref, false AS mutator_call, d.e AS escaping_read FROM t, (VALUES (':count', false, false), (':count$2', false, false), (':table', true, false), (':local.s', false, true), (':parted.s', false, true), (':parted.t', false, false),
 (':lists.kept', false, false), (':lists.given', false, true), (':lists.looped', false, false), (':lists.<comp:51>.i', false, true), (':lists.v', false, false), (':Office.given', false, false), (':Office.built', false, false), (':Office.kept', false, false)) d(id, w, e)
UNION ALL SELECT m || ':Store' || n || '.twin', false, false, false FROM u"""


def variable_mutations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each variable: written to, changed by a method, read where it goes on."""
    return Code(sources(spark, sf_dir)).mutations


STARS_SQL = """SELECT 'src/depot/star' || r_regionkey || '.py' AS file_path, d.line::INTEGER AS line, d.source || CASE WHEN d.source = 'elsewhere' THEN '' ELSE r_regionkey::VARCHAR END AS imported_from, d.source <> 'elsewhere' AS indexed, d.name || CASE WHEN d.name = '' THEN '' ELSE r_regionkey::VARCHAR END AS used_names
FROM region, (VALUES (1, 'depot.base', 'spare'), (2, 'depot.other', 'extra'), (3, 'elsewhere', '')) d(line, source, name)"""


def star_attribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which star import supplies which names: one that two of them have goes to the first."""
    return Code(sources(spark, sf_dir)).stars.select("file_path", "line", "imported_from", "indexed", "used_names")


REBINDS_SQL = f"""WITH {CTES} SELECT file_path, 61::INTEGER AS line, 'count' AS name, m || ':total' AS function_id FROM t"""


def global_rebinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Globals that a function binds anew, with the function around the line."""
    return Code(sources(spark, sf_dir)).rebinds.select("file_path", "line", "name", "function_id")


FINDINGS_SQL = f"""WITH {CTES}
SELECT d.rule, file_path AS path, d.line::INTEGER AS line, replace(d.message, '@m', m) AS message, d.confidence FROM t, (VALUES
 ('prefer-tuple', 49, '''kept'' is never changed: a tuple would do', 'heuristic'), ('prefer-tuple', 51, '''looped'' is never changed: a tuple would do', 'heuristic'),
 ('no-hidden-global-mutation', 61, 'global ''count'' is bound anew in ''@m:total''', 'declared'), ('no-hidden-global-mutation', 62, '''@m:total'' writes into global ''table''', 'declared'),
 ('unused-return-value', 65, 'the result of ''promise'' is never used in 1 calls', 'declared')) d(rule, line, message, confidence)
UNION ALL SELECT 'star-imports', 'src/depot/star' || r || '.py', d.line, replace(d.message, '@r', r::VARCHAR), 'heuristic' FROM v, (VALUES (1, '''from depot.base@r import *'' supplies only ''spare@r'''), (2, '''from depot.other@r import *'' supplies only ''extra@r'''), (3, '''from elsewhere import *'' of a module that isn''t indexed')) d(line, message)"""


def flow_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings of the rules on lists, globals, results and stars."""
    found, out = rules(Code(sources(spark, sf_dir))), None
    for name in ("prefer-tuple", "no-hidden-global-mutation", "unused-return-value", "star-imports"):
        out = found[name].findings() if out is None else out.unionByName(found[name].findings())
    return out


DOMAIN = '''def rate{n}(amount):
    return amount


def cost{n}(amount):
    return amount
'''
BARREL = '''from firm.domain.r{r}.n{n} import cost{n}
'''
APP = '''from firm.domain.r{r}.n{n} import rate{n}
from firm.domain import cost{n}
import json
from firm.domain.r{r}.n{n} import cost{n} as deep{n}
__import__("firm.domain.r{r}.late")


def price{k}(amount):
    total = rate{n}(amount)
    return [total + step for step in json.loads(cost{n}(amount))]
'''
ALLOW = {"app": ("domain", "domain.r0", "domain.r1", "store"), "domain": ("domain.r0", "domain.r1", "domain.r2")}
BOUNDARIES = Boundaries(ALLOW, root="firm")


def firm(spark: SparkSession, sf_dir: str) -> Code:
    """Units in two levels: a part of the domain for each region, a package that passes one name of each nation on, an app module for each supplier."""
    nations = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("n"), F.col("n_regionkey").alias("r"))
    suppliers = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_nationkey").alias("n")).join(nations, "n")
    line = rendered(BARREL, dict(nations.dtypes))
    package = nations.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", line.alias("line")))), lambda x: x["line"]), "").alias("all"))  # one line a nation
    out = written(nations, "src/firm/domain/r{r}/n{n}.py", DOMAIN).unionByName(written(package, "src/firm/domain/__init__.py", "{all}__all__ = []\n"))
    return Code(out.unionByName(written(suppliers, "src/firm/app/s{k}.py", APP)))


FIRM_CTES = """d AS (SELECT n_nationkey AS n, n_regionkey AS r, CASE WHEN n_regionkey < 3 THEN 'domain.r' || n_regionkey ELSE 'domain' END AS unit FROM nation),
t AS (SELECT s_suppkey AS k, d.* FROM supplier JOIN d ON n = s_nationkey)"""

BOUNDARY_SQL = f"""WITH {FIRM_CTES}
SELECT 'src/firm/app/s' || k || '.py' AS path, x.line::INTEGER AS line, 'package ''app'' may not import ''' || unit || ''' (' || x.detail || ' ''firm.domain.' || replace(replace(x.name, '@r', r::VARCHAR), '@n', n::VARCHAR) || ''')' AS message, x.confidence FROM t,
 (VALUES (1, 'via', 'r@r.n@n.rate@n', 'declared'), (2, 'via re-export', 'cost@n', 'declared'), (4, 'via', 'r@r.n@n.cost@n', 'declared'), (5, 'via', 'r@r.late', 'heuristic')) x(line, detail, name, confidence) WHERE unit = 'domain.r2'
UNION ALL SELECT 'src/firm/domain/r' || r || '/n' || min(n::VARCHAR) || '.py', 1, 'package ''' || unit || ''' is not declared', 'declared' FROM d WHERE unit <> 'domain' GROUP BY r, unit
UNION ALL SELECT 'pyproject.toml', 1, '''app'' may import ''store'' but never does', 'declared' UNION ALL SELECT 'pyproject.toml', 1, '''app'' may import ''domain'' but never does', 'declared' WHERE NOT EXISTS (SELECT 1 FROM t WHERE unit = 'domain')"""


def boundary_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Imports over the bounds of nested units, units that nobody declared, allowances that nothing uses."""
    return BOUNDARIES.rule(firm(spark, sf_dir)).findings().select("path", "line", "message", "confidence")


BARRELS_SQL = f"""WITH {FIRM_CTES}
SELECT 'src/firm/app/s' || k || '.py' AS path, 4::INTEGER AS line, 'import ''cost' || n || ''' from firm.domain, not from firm.domain.r' || r || '.n' || n AS message FROM t"""


def barrel_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Imports past a package that exports the name; the first of each file's names isn't exported, the second comes through the package."""
    return rules(firm(spark, sf_dir))["barrel-only"].findings().select("path", "line", "message")


CONTRACT_SQL = """SELECT x.mode, 'src/shop/__init__.py' AS path, (row_number() OVER (PARTITION BY x.mode ORDER BY n_nationkey))::INTEGER AS line, '''rate_' || n_nationkey || ''' is exported by shop but not used outside it' AS message FROM nation, (VALUES ('app'), ('other root')) x(mode)"""


def export_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exports that nobody outside uses: all of them in an application, none in a library whose root they are below."""
    code, out = Code(shop.sources(spark, sf_dir)), None
    for mode, options in {"app": {}, "library": {"library": True}, "root": {"library": True, "public_roots": ("shop",)}, "other root": {"library": True, "public_roots": ("store",)}}.items():
        found = over_exposed_export(code, **options).findings().select(F.lit(mode).alias("mode"), "path", "line", "message")
        out = found if out is None else out.unionByName(found)
    return out


CENSUS_SQL = f"""WITH {FIRM_CTES}
SELECT unit, false AS declared, min('src/firm/domain/r' || r || '/n' || n || '.py') AS file_path FROM d WHERE unit <> 'domain' GROUP BY unit
UNION ALL SELECT 'domain', true, 'src/firm/domain/__init__.py' UNION ALL SELECT 'app', true, min('src/firm/app/s' || k || '.py') FROM t"""


def unit_census(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every unit, whether it is declared, and the file that stands for it."""
    return BOUNDARIES.units(firm(spark, sf_dir)).select("unit", "declared", "file_path")


RENAMES_SQL = f"""WITH {FIRM_CTES}
SELECT CASE WHEN x.id = 'nothing' THEN 'firm.app.s' || k || ':nothing' ELSE 'firm.app.s' || k || ':' || replace(x.id, '@k', k::VARCHAR) END AS symbol_id, replace(x.new, '@n', n::VARCHAR) AS new_name, x.reason FROM t, (VALUES
 ('price@k.total', 'total', 'new-name-differs'), ('price@k.total', 'for', 'valid-identifier'), ('price@k.total', 'amount', 'no-scope-name-conflict'), ('price@k.total', 'step', 'captured-by-inner-scope'), ('price@k.total', 'cost@n', 'captures-outer-name'),
 ('price@k.total', 'sum', ''), ('price@k', 'json', 'no-scope-name-conflict'), ('json', 'other', ''), ('json', 'step', ''), ('nothing', 'x', 'symbol-resolves-uniquely')) x(id, new, reason)"""


def rename_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What becomes of new names proposed for the names of each app module."""
    code = firm(spark, sf_dir)
    at = code.raw["files"].where("file_path like 'src/firm/app/%'").select("module", F.regexp_extract("module", r"(\d+)$", 1).alias("k"))
    costs = code.symbols.where("kind = 'import' and name like 'cost%'").select("module", F.regexp_extract("name", r"(\d+)$", 1).alias("n"))
    new = [("price@k.total", x) for x in ("total", "for", "amount", "step", "cost@n", "sum")] + [("price@k", "json"), ("json", "other"), ("json", "step"), ("nothing", "x")]
    asked = F.explode(F.array(*(F.struct(F.lit(i).alias("id"), F.lit(x).alias("new")) for i, x in new)))
    full = lambda c: F.replace(F.replace(F.col(c), F.lit("@k"), F.col("k")), F.lit("@n"), F.col("n"))
    proposals = at.join(costs, "module").select("module", "k", "n", asked.alias("x")).select("*", "x.*")
    return conflicts(code, proposals.select(F.concat("module", F.lit(":"), full("id")).alias("symbol_id"), full("new").alias("new_name")))


YARD_A = '''import functools
from yard.b{r} import back{r}
print("loaded")


@functools.lru_cache
def cached{r}(x):
    print(x)
    return x


def local{r}():
    return 1


def other{r}(x):
    return local{r}() + x.part.count


def unsure{r}(x):
    x.part.write(1)


def both{r}(x):
    x.part.write(1)
    print(x)


def later{r}():
    return [lambda: print(i) for i in (1, 2)]


def passed{r}():
    audit(passed{r})
'''
YARD_B = '''from yard.a{r} import other{r}


def back{r}():
    return other{r}(1)
'''


def yard(spark: SparkSession, sf_dir: str, policy: Policy | None = None) -> Code:
    """Two modules for each region that import each other."""
    regions = table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("r"))
    files = written(regions, "src/yard/a{r}.py", YARD_A).unionByName(written(regions, "src/yard/b{r}.py", YARD_B))
    return Code(files, policy=policy) if policy else Code(files)


YARD_CTE = "r AS (SELECT r_regionkey AS r, 'src/yard/a' || r_regionkey || '.py' AS path FROM region)"
YARD_SQL = f"""WITH {YARD_CTE}
SELECT x.rule, path, x.line::INTEGER AS line, replace(x.message, '@r', r::VARCHAR) AS message, x.confidence FROM r, (VALUES
 ('no-import-cycles', 2, 'modules import each other: yard.a@r, yard.b@r', 'declared'), ('pure-decorator-contracts', 7, 'function ''cached@r'' should be pure: builtin print (line 8)', 'declared'), ('import-time-side-effects', 3, '''print'' runs when the module is imported', 'declared'),
 ('no-impure-functions', 7, 'function ''cached@r'' is impure: builtin print (line 8)', 'declared'), ('no-impure-functions', 20, 'function ''unsure@r'' is impure: method .write (line 21)', 'heuristic'),
 ('no-impure-functions', 24, 'function ''both@r'' is impure: method .write (line 25), builtin print (line 26)', 'declared')) x(rule, line, message, confidence)
UNION ALL SELECT 'born-private', path, 12, 'new function ''local' || r || ''' is used only in yard.a' || r || ': begin it with an underscore', 'declared' FROM r WHERE r > 0
UNION ALL SELECT 'born-private', path, 33, 'new function ''passed' || r || ''' is used only in yard.a' || r || ': begin it with an underscore', 'declared' FROM r"""


def yard_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cycles, contracts of decorators, effects of an import, new symbols, and how sure effects are; the first region's symbol is known before."""
    code = yard(spark, sf_dir)
    known = table(spark, sf_dir, "region").where("r_regionkey = 0").select(F.format_string("yard.a%d:local%d", "r_regionkey", "r_regionkey").alias("symbol_id"))
    found, out = rules(code, recorded=known), None
    for name in ("no-import-cycles", "pure-decorator-contracts", "import-time-side-effects", "no-impure-functions", "born-private"):
        out = found[name].findings() if out is None else out.unionByName(found[name].findings())
    return out


POLICY_SQL = f"""WITH {YARD_CTE} SELECT 'yard.a' || r || ':' || x.f || r AS function, 0::INTEGER AS depth FROM r, (VALUES ('unsure'), ('both'), ('passed')) x(f)"""


def impurity_by_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With one more builtin that has effects, and one that hasn't."""
    return yard(spark, sf_dir, Policy().extended(builtins=("audit",), allow=("print",))).impure


SITES_SQL = f"""WITH {CTES}
SELECT m || ':promise' AS symbol_id, 1::BIGINT AS n_calls, false AS any_used, false AS escapes, file_path || ':70' AS shown FROM t UNION ALL SELECT m || ':shown', 1, false, true, file_path || ':78' FROM t"""


def call_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the functions that promise a number: calls, whether any result is used, whether they are passed on, the first sites."""
    code = Code(sources(spark, sf_dir))
    return code.call_sites.join(code.located.where("name in ('promise', 'shown')").select("symbol_id"), "symbol_id")


INLINE_SQL = f"""WITH {YARD_CTE} SELECT 'yard.a' || r || ':' || x.owner || r AS owner, 'yard.a' || r || ':' || replace(x.scope, '@', r::VARCHAR) AS scope_id FROM r, (VALUES ('cached', 'cached@'), ('local', 'local@'), ('other', 'other@'), ('unsure', 'unsure@'), ('both', 'both@'), ('later', 'later@'), ('later', 'later@.<comp:30>'), ('passed', 'passed@')) x(owner, scope)
UNION ALL SELECT 'yard.b' || r || ':back' || r, 'yard.b' || r || ':back' || r FROM r"""


def inline_scopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The scopes that run when a function does: comprehensions, but no lambdas."""
    return yard(spark, sf_dir).inline_scopes.select("owner", "scope_id")


FLAGS_SQL = f"""WITH {CTES} SELECT file_path, false AS has_all, false AS dynamic_access FROM t UNION ALL SELECT file_path, false, false FROM u UNION ALL SELECT file_path, false, false FROM v
UNION ALL SELECT 'src/depot/' || x.f || r || '.py', false, false FROM v, (VALUES ('other'), ('star')) x(f)"""


def file_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each file: whether it has __all__, whether it looks names up as it runs."""
    return Code(sources(spark, sf_dir)).file_flags.select("file_path", "has_all", "dynamic_access")


STEPS_SQL = f"""WITH {YARD_CTE}
SELECT x.step, 'src/yard/' || x.file || r || '.py' AS file_path, replace(x.id, '@', r::VARCHAR) AS id FROM r, (VALUES ('symbols.scope', 'a', 'yard.a@'), ('symbols.module', 'a', 'yard.a@'), ('symbols.definition', 'b', 'yard.b@:back@'), ('references.symbol', 'a', 'yard.a@:local@'), ('references.scope', 'a', 'yard.a@:other@'),
 ('modules.symbols', 'b', 'yard.b@:other@'), ('modules.symbols', 'b', 'yard.b@:back@'), ('modules.scopes', 'b', 'yard.b@'), ('modules.scopes', 'b', 'yard.b@:back@'), ('modules.imports', 'b', 'yard.b@:other@'), ('imports.module', 'b', 'yard.b@')) x(step, file, id)"""


def named_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the steps between universes lead to, each from a few rows of its universe."""
    u, out = Universes(yard(spark, sf_dir)), None
    begin = lambda universe, name, of="name": u[universe].where(field(of).startswith(name))
    symbols, calls, modules = begin("symbols", "cached"), begin("references", "local"), begin("modules", "yard.b", "module")
    back = begin("symbols", "back").where(field("kind").eq("import"))
    for start, universe, step, column in (
        (symbols, "symbols", "scope", "scope_id"), (symbols, "symbols", "module", "module"), (back, "symbols", "definition", "symbol_id"), (calls, "references", "symbol", "symbol_id"), (calls, "references", "scope", "scope_id"),
        (modules, "modules", "symbols", "symbol_id"), (modules, "modules", "scopes", "scope_id"), (modules, "modules", "imports", "symbol_id"), (begin("imports", "other"), "imports", "module", "module"),
    ):
        rows = u.follow(start, universe, step).df.select(F.lit(f"{universe}.{step}").alias("step"), "file_path", F.col(column).alias("id"))
        out = rows if out is None else out.unionByName(rows)
    return out


ANCESTRY_SQL = f"""WITH {CTES} SELECT m || ':Store' || n AS node, 'depot.base' || r || ':Base' || r AS ancestor, 1::INTEGER AS depth FROM u"""


def class_ancestry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes and those they are made of, over files."""
    return Code(sources(spark, sf_dir)).ancestors


ALGEBRA_SQL = f"""WITH {CTES}
SELECT m || x.id AS symbol_id, m AS module, x.leaf, m || x.plain AS plain, x.shadow, m || x.renamed AS renamed, x.inside, m AS by_path, CASE WHEN x.inside THEN 'Store' || n END AS type FROM t,
 (VALUES (':count', 'count', ':count', NULL::INTEGER, ':new', false), (':count$2', 'count$2', ':count', 2, ':new', false), (':Office.built', 'built', ':Office.built', NULL, ':Office.new', true)) x(id, leaf, plain, shadow, renamed, inside)"""


def identifier_algebra(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The parts of symbols' ids: module, last name, shadow, what they are called with another last name, whether they are inside a class."""
    rows = Code(sources(spark, sf_dir)).symbols.where("kind = 'variable' and name in ('count', 'built')")
    s = F.col("symbol_id")
    inside = names.affects(s, F.concat("module", F.lit(":Office")))
    return rows.select(
        "symbol_id", names.module_of(s).alias("module"), names.leaf_name(s).alias("leaf"), names.strip_shadow(s).alias("plain"), names.shadow_suffix(s).alias("shadow"),
        names.replace_leaf(s, F.lit("new")).alias("renamed"), inside.alias("inside"), names.module_path(F.col("file_path")).alias("by_path"), names.bare_type(F.col("annotation")).alias("type"),
    )


QUERIES = {f.__name__: f for f in (receiver_impurity, self_members, inherited_members, receiver_references, variable_mutations, star_attribution, global_rebinds, flow_findings, boundary_findings, barrel_findings, export_contract, unit_census, rename_conflicts, yard_findings, impurity_by_policy, call_sites, inline_scopes, file_flags, named_steps, class_ancestry, identifier_algebra)}
SQL = {"receiver_impurity": IMPURITY_SQL, "self_members": MEMBERS_SQL, "inherited_members": INHERITED_SQL, "receiver_references": USES_SQL, "variable_mutations": MUTATION_SQL, "star_attribution": STARS_SQL, "global_rebinds": REBINDS_SQL, "flow_findings": FINDINGS_SQL, "boundary_findings": BOUNDARY_SQL, "barrel_findings": BARRELS_SQL, "export_contract": CONTRACT_SQL, "unit_census": CENSUS_SQL, "rename_conflicts": RENAMES_SQL, "yard_findings": YARD_SQL, "impurity_by_policy": POLICY_SQL, "call_sites": SITES_SQL, "inline_scopes": INLINE_SQL, "file_flags": FLAGS_SQL, "named_steps": STEPS_SQL, "class_ancestry": ANCESTRY_SQL, "identifier_algebra": ALGEBRA_SQL}
