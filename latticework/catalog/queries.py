"""Queries over the driver's tables, one or more for each operator, and SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from latticework.catalog.tables import relation, table
from latticework.functions import captures, names, summaries
from latticework.operators import graph, intervals, layers, ranking, tree
from latticework.plans.evidence import DECLARED, HEURISTIC, INFERRED, all_of, any_of, constant, field, not_, opaque, weakened_when
from latticework.plans.relation import decisions
from latticework.plans.rules import Part, Rule, beyond_baseline, fixed_since, identity

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def long(*columns: str) -> list:
    return [F.col(c).cast("long").alias(c) for c in columns]


@query("""SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, l_quantity, CAST(3 AS INTEGER) AS evidence FROM lineitem
WHERE l_returnflag = 'R' AND l_linestatus = 'F' AND CAST(l_quantity AS BIGINT) IN (1, 2, 3)""")
def where_all_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conjunction of equality and membership: the flagship."""
    r = relation(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", "l_quantity", "l_returnflag", "l_linestatus")
    r = r.where(all_of(field("l_returnflag", "str").eq("R"), field("l_linestatus", "str").eq("F"), field("l_quantity", "num").is_in(1.0, 2.0, 3.0)))
    return r.project("l_orderkey", "l_linenumber", "l_quantity").frame().withColumn("l_linenumber", F.col("l_linenumber").cast("long"))


@query("""SELECT o_orderkey, CAST(CASE WHEN urgent AND big THEN least(2, 1) WHEN urgent THEN 2 WHEN big THEN 1 END AS INTEGER) AS evidence
FROM (SELECT o_orderkey, o_orderpriority = '1-URGENT' AS urgent, o_totalprice > 300000 AS big FROM orders) WHERE urgent OR big""")
def where_any_of_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Disjunction: as sure as the least sure satisfied branch."""
    r = relation(spark, sf_dir, "orders")
    urgent = field("o_orderpriority", "str").eq(constant("1-URGENT", INFERRED))
    big = opaque("big", lambda price, _: price > 300000, field("o_totalprice", "num"), constant(0, HEURISTIC), kind="bool")
    return r.where(any_of(urgent, big)).project("o_orderkey").frame()


@query("""SELECT event_id, nullif(event_type, 'click') IS NOT DISTINCT FROM NULL AS was_null FROM events
WHERE NOT (nullif(event_type, 'click') IS NOT DISTINCT FROM 'view')""")
def not_null_safe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Negated equality keeps rows with NULL."""
    r = relation(spark, sf_dir, "events", "event_id", "event_type")
    r = r.with_field("kind", opaque("nullif", lambda c: F.nullif(c, F.lit("click")), field("event_type"), kind="str"))
    r = r.where(not_(field("kind", "str").eq("view"))).with_field("was_null", field("kind", "str").eq(None))
    return r.project("event_id", "was_null").frame(None)


@query("SELECT p_partkey, p_type FROM part WHERE p_type GLOB '*[AB]*EL' OR p_brand GLOB 'Brand#?5'")
def glob_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = relation(spark, sf_dir, "part")
    return r.where(field("p_type", "str").matches("*[AB]*EL") | field("p_brand", "str").matches("Brand#?5")).project("p_partkey", "p_type").frame(None)


@query("""WITH h AS (SELECT page_id, regexp_extract(url, '^[a-z]+://([^/]+)', 1) AS host FROM pages), r AS (SELECT page_id, host, array_to_string(list_reverse(string_split(host, '.')), '.') AS dotted FROM h)
SELECT page_id, dotted, (dotted = 'com.example' OR starts_with(dotted, 'com.example.')) AS inside FROM r WHERE NOT starts_with(dotted, 'org')""")
def is_within_dotted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dotted containment on reversed host names, and a prefix."""
    r = relation(spark, sf_dir, "pages", "page_id", "url")
    dotted = opaque("dotted", lambda u: F.array_join(F.reverse(F.split(F.regexp_extract(u, "^[a-z]+://([^/]+)", 1), r"\.")), "."), field("url"), kind="str")
    r = r.with_field("dotted", dotted).where(~field("dotted", "str").startswith("org"))
    return r.with_field("inside", field("dotted", "str").is_within("com.example")).project("page_id", "dotted", "inside").frame(None)


@query("SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 'debt' WHEN c_acctbal < 5000 THEN 'low' ELSE 'high' END AS tier, CAST(2 AS INTEGER) AS evidence FROM customer")
def with_field_opaque(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A derived field by any column function; no row is dropped."""
    r = relation(spark, sf_dir, "customer")
    tier = opaque("tier", lambda b, _: F.when(b < 0, "debt").when(b < 5000, "low").otherwise("high"), field("c_acctbal", "num"), constant(None, INFERRED), kind="str")
    return r.with_field("tier", tier).project("c_custkey", "tier").frame()


@query("SELECT s_suppkey, CAST(CASE WHEN s_acctbal < 1000 THEN 1 ELSE 3 END AS INTEGER) AS evidence FROM supplier")
def weakened_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = relation(spark, sf_dir, "supplier")
    low = opaque("low", lambda b: b < 1000, field("s_acctbal", "num"), kind="bool")
    return r.where(weakened_when(low, HEURISTIC)).project("s_suppkey").frame()


@query("""SELECT c_custkey, CAST(CASE WHEN c_acctbal < 0 THEN 1 ELSE 3 END AS INTEGER) AS balance_conf, c_acctbal >= 0 AS declared_positive FROM customer""")
def unmatched_assertion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A value asserted at a level: unmatched where it is less sure, so every comparison with it is false."""
    r = relation(spark, sf_dir, "customer")
    sure = F.when(F.col("c_acctbal") < 0, HEURISTIC).otherwise(DECLARED)
    df = r.df.withColumn("balance_conf", sure)
    from dataclasses import replace

    r = replace(r, df=df, fields=(*r.fields, "balance_conf"))
    held = field("c_acctbal", "num", confidence="balance_conf").at(DECLARED)
    return r.with_field("declared_positive", held.ne(None)).project("c_custkey", "balance_conf", "declared_positive").frame(None)


@query("""WITH o AS (SELECT l_orderkey, min(l_linenumber) AS ln FROM lineitem WHERE l_quantity >= 45 GROUP BY 1)
SELECT DISTINCT n_nationkey AS n_nationkey, n_name, CAST(3 AS INTEGER) AS evidence FROM o JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey""")
def follow_to_nations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Navigation over three joins, each target once."""
    r = relation(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", "l_quantity").where(opaque("big", lambda q: q >= 45, field("l_quantity"), kind="bool"))
    r = r.follow(relation(spark, sf_dir, "orders", "o_orderkey", "o_custkey"), {"l_orderkey": "o_orderkey"})
    r = r.follow(relation(spark, sf_dir, "customer", "c_custkey", "c_nationkey"), {"o_custkey": "c_custkey"})
    return r.follow(relation(spark, sf_dir, "nation", "n_nationkey", "n_name"), {"c_nationkey": "n_nationkey"}).project("n_nationkey", "n_name").frame()


@query("""SELECT c_custkey, CAST(evidence AS INTEGER) AS evidence FROM (SELECT o_custkey AS c_custkey, CASE WHEN o_totalprice > 200000 THEN 1 ELSE 3 END AS evidence, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS rn FROM orders) JOIN customer USING (c_custkey) WHERE rn = 1""")
def follow_first_reached(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A target reached by several paths keeps the confidence of the first."""
    high = opaque("high", lambda p: p > 200000, field("o_totalprice"), kind="bool")
    r = relation(spark, sf_dir, "orders", "o_orderkey", "o_custkey", "o_totalprice").where(weakened_when(high, HEURISTIC))
    return r.follow(relation(spark, sf_dir, "customer", "c_custkey"), {"o_custkey": "c_custkey"}).project("c_custkey").frame()


def _urgent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relation(spark, sf_dir, "orders", "o_orderkey", "o_custkey", "o_orderpriority").where(field("o_orderpriority").eq("1-URGENT")).frame(None).select("o_custkey")


@query("SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT')")
def in_set_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = relation(spark, sf_dir, "customer", "c_custkey").with_membership("urgent", "c_custkey", _urgent(spark, sf_dir))
    return r.where(field("urgent", "bool").is_true()).project("c_custkey").frame(None)


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT')")
def in_set_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = relation(spark, sf_dir, "customer", "c_custkey").with_membership("urgent", "c_custkey", _urgent(spark, sf_dir))
    return r.where(~field("urgent", "bool")).project("c_custkey").frame(None)


@query("SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING' OR EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT')")
def in_set_or(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Membership under a disjunction: an existence join, which adds no rows."""
    r = relation(spark, sf_dir, "customer", "c_custkey", "c_mktsegment").with_membership("urgent", "c_custkey", _urgent(spark, sf_dir))
    return r.where(field("c_mktsegment").eq("BUILDING") | field("urgent", "bool")).project("c_custkey").frame(None)


@query("SELECT DISTINCT o_custkey FROM orders WHERE o_orderpriority = '5-LOW' AND o_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')")
def one_set_not_other(spark: SparkSession, sf_dir: str) -> DataFrame:
    """In the one set and not in the other."""
    low = table(spark, sf_dir, "orders").where("o_orderpriority = '5-LOW'").select("o_custkey").distinct()
    return low.join(_urgent(spark, sf_dir).distinct(), "o_custkey", "left_anti")


@query("""SELECT l_partkey AS p_partkey, string_agg(origin, ',' ORDER BY origin) AS origins, bool_or(origin <> 'FRANCE') AS abroad
FROM (SELECT DISTINCT l_partkey, n_name AS origin FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey) GROUP BY 1""")
def usage_origins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each part the set of nations it is supplied from, and whether any is another than one."""
    uses = table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey").distinct()
    places = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", "n_name")
    origins = uses.join(places, F.col("l_suppkey") == F.col("s_suppkey")).groupBy(F.col("l_partkey").alias("part")).agg(F.array_sort(F.collect_set("n_name")).alias("places"))
    r = relation(spark, sf_dir, "part", "p_partkey").with_lookup("places", "p_partkey", origins).where(field("places", "array").ne(None))
    r = r.with_field("abroad", field("places", "array").any_other_than("FRANCE")).with_field("origins", opaque("join", lambda a: F.array_join(a, ","), field("places"), kind="str"))
    return r.project("p_partkey", "origins", "abroad").frame(None)


@query("""SELECT l_orderkey, min(n_name) AS only_origin FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey GROUP BY 1 HAVING count(DISTINCT n_name) = 1""")
def used_only_locally(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys all of whose uses have one origin: least and greatest agree."""
    places = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", "n_name")
    uses = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey").join(places, F.col("l_suppkey") == F.col("s_suppkey"))
    return uses.groupBy("l_orderkey").agg(F.min("n_name").alias("only_origin"), F.max("n_name").alias("other")).where("only_origin = other").drop("other")


@query("""SELECT c_custkey, CAST(CASE WHEN n IS NULL THEN 0 ELSE 2 END AS INTEGER) AS evidence, n IS NULL AS absent, coalesce(n, -1) AS n_orders FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) ON o_custkey = c_custkey""")
def fact_by_anchor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A fact about each row's entity, with its own confidence; absent reads NULL at none."""
    facts = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("n")).withColumn("tier", F.lit(INFERRED))
    r = relation(spark, sf_dir, "customer", "c_custkey").with_lookup("n", "c_custkey", facts, confidence="tier")
    r = r.with_field("absent", opaque("absent", lambda n: n.isNull(), field("n", "num", confidence="n_conf"), kind="bool"))
    return r.with_field("n_orders", opaque("count", lambda n: F.coalesce(n, F.lit(-1)), field("n"), kind="num")).project("c_custkey", "absent", "n_orders").frame()


@query("""WITH r AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS rn, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders)
SELECT o_custkey, max(n) AS n, string_agg(CAST(o_orderkey AS VARCHAR), ', ' ORDER BY rn) || CASE WHEN max(n) > 3 THEN ' +' || (max(n) - 3) || ' more' ELSE '' END AS shown FROM r WHERE rn <= 3 GROUP BY 1""")
def top_three_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first three of each key as text, and how many more."""
    return ranking.top_text(table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey"), ["o_custkey"], ["o_orderkey"], F.col("o_orderkey").cast("string"))


@query("""SELECT l_partkey, count(*) AS n_calls, bool_or(l_returnflag <> 'N') AS any_used, bool_and(l_linestatus = 'F') AS all_final FROM lineitem GROUP BY 1, l_suppkey HAVING NOT bool_or(l_returnflag = 'R')""")
def discarded_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys none of whose uses is of one kind: boolean aggregates."""
    g = table(spark, sf_dir, "lineitem").groupBy("l_partkey", "l_suppkey").agg(F.count("*").alias("n_calls"), F.bool_or(F.col("l_returnflag") != "N").alias("any_used"), F.bool_and(F.col("l_linestatus") == "F").alias("all_final"), F.bool_or(F.col("l_returnflag") == "R").alias("returned"))
    return g.where("not returned").drop("returned", "l_suppkey")


@query("""SELECT p_partkey, p_name, regexp_matches(replace(p_name, ' ', '_'), '^[a-z][a-z0-9_]*$') AS fits, lower(regexp_replace(regexp_replace(regexp_replace(p_brand, '([A-Z]+)([A-Z][a-z])', '\\1_\\2', 'g'), '([a-z0-9])([A-Z])', '\\1_\\2', 'g'), '[-\\s#.]+', '_', 'g')) AS suggested FROM part""")
def naming_conventions(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part")
    fits = names.conforms(F.replace("p_name", F.lit(" "), F.lit("_")), F.lit("variable"))
    return parts.select("p_partkey", "p_name", fits.alias("fits"), names.snake_case(F.col("p_brand")).alias("suggested"))


@query("""SELECT user_id, event_type, event_id AS first_event FROM (SELECT user_id, event_type, event_id, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS rn FROM events) WHERE rn = 1""")
def first_attribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first claimant of each key wins."""
    return ranking.first_by(table(spark, sf_dir, "events").select("user_id", "event_type", "ts", "event_id"), ["user_id", "event_type"], ["ts", "event_id"], ["event_id"]).withColumnRenamed("event_id", "first_event")


@query("""WITH big AS (SELECT page_id, url, regexp_extract(url, '^[a-z]+://([^/]+)', 1) AS host FROM pages)
SELECT 'secure-links' AS rule, host AS path, CAST(1 AS INTEGER) AS line, 'page ' || page_id || ' is not secure' AS message, 'declared' AS confidence FROM big WHERE starts_with(url, 'http:')
UNION ALL SELECT 'secure-links', host, CAST(1 AS INTEGER), 'page ' || page_id || ' is tracked', 'heuristic' FROM big WHERE url LIKE '%utm_%'""")
def findings_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A rule of two parts, rendered as findings; a bag, nothing merged."""
    r = relation(spark, sf_dir, "pages", "page_id", "url").with_field("host", opaque("host", lambda u: F.regexp_extract(u, "^[a-z]+://([^/]+)", 1), field("url"), kind="str"))
    tracked = opaque("tracked", lambda u, _: u.contains("utm_"), field("url"), constant(None, HEURISTIC), kind="bool")
    parts = (Part(r.where(field("url").startswith("http:")), "page {page_id} is not secure", "host"), Part(r.where(tracked), "page {page_id} is tracked", "host"))
    return Rule("secure-links", parts).findings()


@query("""WITH f AS (SELECT 'users' AS rule, event_type AS path, event_id, 'event of ' || user_id AS message FROM events), r AS (SELECT *, row_number() OVER (PARTITION BY path, message ORDER BY event_id) AS rn FROM f)
SELECT rule, path, message, event_id FROM r WHERE rn > 2""")
def baseline_surplus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings beyond the two that the baseline allows for each identity: the last ones."""
    rows = table(spark, sf_dir, "events").select(F.lit("users").alias("rule"), F.col("event_type").alias("path"), F.col("event_id").alias("line"), F.format_string("event of %d", "user_id").alias("message"))
    known = rows.select(identity().alias("identity")).distinct().withColumn("count", F.lit(2))
    return beyond_baseline(rows, known).select("rule", "path", "message", F.col("line").cast("long").alias("event_id"))


@query("""SELECT 'users|' || event_type || '|event of ' || user_id AS identity, 1000 - count(*) AS fixed FROM events GROUP BY event_type, user_id HAVING count(*) < 1000""")
def baseline_fixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select(F.lit("users").alias("rule"), F.col("event_type").alias("path"), F.format_string("event of %d", "user_id").alias("message"))
    known = rows.select(identity().alias("identity")).distinct().withColumn("count", F.lit(1000).cast("long"))
    return fixed_since(rows, known)


@query("""SELECT n_name AS unit, r_name AS may_use, coalesce(bool_or(o_orderkey IS NOT NULL), false) AS exercised FROM nation JOIN region ON n_regionkey = r_regionkey LEFT JOIN customer ON c_nationkey = n_nationkey AND c_acctbal > 9900 LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1, 2""")
def allowances_exercised(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each allowed pair, whether any row makes use of it."""
    allowed = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    used = table(spark, sf_dir, "customer").where("c_acctbal > 9900").join(table(spark, sf_dir, "orders").select("o_custkey").distinct(), F.col("o_custkey") == F.col("c_custkey"), "left_semi").select("c_nationkey").distinct()
    return allowed.join(used, F.col("c_nationkey") == F.col("n_nationkey"), "left").select(F.col("n_name").alias("unit"), F.col("r_name").alias("may_use"), F.col("c_nationkey").isNotNull().alias("exercised"))


@query("""WITH s AS (SELECT l_suppkey AS g, epoch(min(l_shipdate)) AS a, epoch(max(l_shipdate)) AS b, l_returnflag || l_linestatus AS name FROM lineitem WHERE l_quantity = 50 GROUP BY 1, 4), p AS (SELECT l_orderkey, l_linenumber, l_suppkey AS g, epoch(l_shipdate) AS t FROM lineitem WHERE l_discount = 0.1)
SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, name AS innermost FROM (SELECT p.*, s.name, row_number() OVER (PARTITION BY l_orderkey, l_linenumber, p.g, t ORDER BY (b - a) NULLS LAST, a, name) AS rn FROM p LEFT JOIN s ON p.g = s.g AND t BETWEEN a AND b) WHERE rn = 1""")
def innermost_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shortest interval of its group that holds each point: a join by buckets of time."""
    lines = table(spark, sf_dir, "lineitem").withColumn("t", F.unix_timestamp(F.col("l_shipdate").cast("timestamp")).cast("double"))
    spans = lines.where("l_quantity = 50").groupBy(F.col("l_suppkey").alias("g"), F.concat("l_returnflag", "l_linestatus").alias("name")).agg(F.min("t").alias("a"), F.max("t").alias("b"))
    points = lines.where("l_discount = 0.1").select("l_orderkey", F.col("l_linenumber").cast("long").alias("l_linenumber"), F.col("l_suppkey").alias("g"), "t")
    return intervals.innermost(points, spans, "g", "t", "a", "b", "name").select("l_orderkey", "l_linenumber", "innermost")


TRADE = "SELECT DISTINCT s_nationkey AS a, c_nationkey AS b FROM lineitem JOIN supplier ON s_suppkey = l_suppkey JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey WHERE l_quantity >= 50 AND l_discount >= 0.09"


def _trade(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").where("l_quantity >= 50 and l_discount >= 0.09").select("l_orderkey", "l_suppkey")
    sold = lines.join(table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey"), F.col("s_suppkey") == F.col("l_suppkey"))
    bought = sold.join(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), F.col("o_orderkey") == F.col("l_orderkey")).join(table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"), F.col("c_custkey") == F.col("o_custkey"))
    return bought.select(F.col("s_nationkey").alias("a"), F.col("c_nationkey").alias("b")).distinct()


@query(f"""WITH RECURSIVE e AS ({TRADE}), r AS (SELECT a AS s, b AS t FROM e UNION SELECT r.s, e.b FROM r JOIN e ON r.t = e.a)
SELECT CAST(x.s AS BIGINT) AS node, CAST(min(x.t) AS BIGINT) AS component FROM r x JOIN r y ON x.s = y.t AND x.t = y.s GROUP BY x.s HAVING count(DISTINCT x.t) > 1""")
def trade_cycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strongly connected nations of a trade graph."""
    return graph.strong_components(_trade(spark, sf_dir)).select(*long("node", "component"))


@query(f"""WITH RECURSIVE e AS ({TRADE}), r AS (SELECT 0 AS node UNION SELECT e.b FROM r JOIN e ON r.node = e.a) SELECT CAST(node AS BIGINT) AS node FROM r""")
def reachability(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = _trade(spark, sf_dir)
    return graph.reachable(edges, spark.createDataFrame([(0,)], "node int")).select(*long("node"))


@query(f"""WITH RECURSIVE e AS ({TRADE}), seeds AS (SELECT n_nationkey AS node FROM nation WHERE n_regionkey = 0), r AS (SELECT node FROM seeds UNION SELECT e.a FROM r JOIN e ON r.node = e.b) SELECT CAST(node AS BIGINT) AS node FROM r""")
def affected_fixpoint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is a seed, or leads to something affected: a least fixpoint against the edges."""
    seeds = table(spark, sf_dir, "nation").where("n_regionkey = 0").select(F.col("n_nationkey").alias("node"))
    return graph.affected(_trade(spark, sf_dir), seeds).select(*long("node"))


@query("""WITH RECURSIVE al AS (SELECT c_custkey AS name, c_custkey // 2 AS target FROM customer WHERE c_custkey <> c_custkey // 2), r AS (SELECT name, target AS cur, 1 AS hops FROM al UNION ALL SELECT r.name, al.target, hops + 1 FROM r JOIN al ON r.cur = al.name)
SELECT name, arg_max(cur, hops) AS final, CAST(max(hops) AS BIGINT) AS hops FROM r GROUP BY name""")
def alias_chase(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chains of aliases followed to their end; a name that stands for itself is no alias."""
    aliases = table(spark, sf_dir, "customer").where("c_custkey <> c_custkey div 2").select(F.col("c_custkey").alias("name"), F.expr("c_custkey div 2").alias("target"))
    return graph.chased(aliases).select("name", "final", F.col("hops").cast("long").alias("hops"))


@query("""WITH l AS (SELECT n_nationkey, n_regionkey, n_name, sha256(n_nationkey || '|' || n_name) AS d FROM nation)
SELECT r_name, sha256(string_agg(n_name || '=' || d, chr(10) ORDER BY n_name || '=' || d)) AS digest, count(*) AS children FROM l JOIN region ON n_regionkey = r_regionkey GROUP BY 1""")
def merkle_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    leaves = table(spark, sf_dir, "nation").withColumn("d", tree.leaf_digest(F.col("n_nationkey"), F.col("n_name")))
    up = tree.rolled_up(leaves, "n_regionkey", "n_name", "d")
    return up.join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("r_name", "digest", "children")


@query("""SELECT coalesce(o.p_partkey, n.p_partkey) AS p_partkey, CASE WHEN o.d IS NULL THEN 'added' WHEN n.d IS NULL THEN 'removed' WHEN o.d = n.d THEN 'reused' ELSE 'rebuilt' END AS state
FROM (SELECT p_partkey, sha256(p_partkey || '|' || p_name) AS d FROM part WHERE p_size < 40) o FULL JOIN (SELECT p_partkey, sha256(p_partkey || '|' || CASE WHEN p_size % 5 = 0 THEN p_brand ELSE p_name END) AS d FROM part WHERE p_size > 10) n ON o.p_partkey = n.p_partkey""")
def tree_reconcile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What of two trees is reused, rebuilt, added, removed."""
    parts = table(spark, sf_dir, "part")
    old = parts.where("p_size < 40").withColumn("d", tree.leaf_digest(F.col("p_partkey"), F.col("p_name")))
    new = parts.where("p_size > 10").withColumn("d", tree.leaf_digest(F.col("p_partkey"), F.when(F.col("p_size") % 5 == 0, F.col("p_brand")).otherwise(F.col("p_name"))))
    return tree.reconciled(old, new, "p_partkey", "d")


@query("""SELECT event_id, CASE WHEN props LIKE '{%' THEN 'json' ELSE 'text' END AS format FROM events""")
def format_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", captures.detect_format(F.col("props")).alias("format"))


@query("""SELECT sha256(text) AS digest, CAST(strlen(any_value(text)) AS BIGINT) AS bytes, min(doc_id) AS first, count(*) AS holders FROM documents GROUP BY 1""")
def blob_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A content-addressed store of the documents."""
    return captures.blobs(table(spark, sf_dir, "documents"), "text", "doc_id")


@query("""WITH l AS (SELECT conv_id, turn, unnest(string_split(role || ':' || turn || ':' || text, chr(10))) AS line FROM conversations)
SELECT conv_id, regexp_extract(line, '^([^:\\n]+):\\d+:', 1) AS path, count(*) AS matches FROM l WHERE regexp_matches(line, '^[^:\\n]+:\\d+:') GROUP BY 1, 2""")
def search_tally(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines `path:line:` counted by path."""
    turns = table(spark, sf_dir, "conversations").withColumn("output", F.concat_ws(":", "role", F.col("turn").cast("string"), "text"))
    return captures.search_tally(turns, "output", "conv_id")


@query("""SELECT o_orderkey, CAST(CASE WHEN o_totalprice > 300000 THEN 1 ELSE 3 END AS INTEGER) AS evidence, CASE WHEN o_totalprice > 300000 THEN 'below-floor' WHEN o_orderstatus <> 'O' THEN 'closed' WHEN o_orderpriority = '5-LOW' THEN 'unimportant' ELSE '' END AS reason,
CASE WHEN o_totalprice <= 300000 AND o_orderstatus = 'O' AND o_orderpriority <> '5-LOW' THEN 'query:expedite:' || o_orderkey END AS intent_id FROM orders""")
def mutation_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A proposed change for every row: refused below a floor of confidence or by the first precondition that fails."""
    big = opaque("big", lambda p: p > 300000, field("o_totalprice"), kind="bool")
    r = relation(spark, sf_dir, "orders", "o_orderkey", "o_totalprice", "o_orderstatus", "o_orderpriority").where(weakened_when(big, HEURISTIC))
    out = decisions(r, "expedite", INFERRED, {"closed": field("o_orderstatus").eq("O"), "unimportant": field("o_orderpriority").ne("5-LOW")})
    return out.select("o_orderkey", "evidence", "reason", "intent_id")


@query("""WITH p AS (SELECT l_orderkey AS file, l_linenumber AS n, CAST(l_quantity AS BIGINT) AS a, CAST(l_quantity AS BIGINT) + l_partkey % 7 AS b FROM lineitem)
SELECT x.file, CAST(x.n AS BIGINT) AS first, CAST(y.n AS BIGINT) AS second FROM p x JOIN p y ON x.file = y.file AND x.n < y.n AND x.a < y.b AND y.a < x.b""")
def edit_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of edits of one file whose half-open spans overlap; a file's edits are few."""
    edits = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("file"), F.col("l_linenumber").cast("long").alias("n"), F.col("l_quantity").cast("long").alias("a"), (F.col("l_quantity").cast("long") + F.col("l_partkey") % 7).alias("b"))
    return layers.overlapping(edits, "file", "n", "a", "b")


@query("""WITH p AS (SELECT l_suppkey AS file, l_orderkey, l_linenumber, l_partkey, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice) AS n, CAST(l_quantity * 100 AS BIGINT) + l_partkey % 100 AS a, CAST(l_quantity * 100 AS BIGINT) + l_partkey % 100 + l_orderkey % 13 AS b FROM lineitem),
g AS (SELECT file, list_reduce(list({'n': n, 'a': a, 'b': b} ORDER BY n) FILTER (a < b), lambda k, x: CASE WHEN len(list_filter(k, lambda y: y.a < x.b AND x.a < y.b)) = 0 THEN list_append(k, x) ELSE k END, CAST([] AS STRUCT(n BIGINT, a BIGINT, b BIGINT)[])) AS k FROM p GROUP BY file)
SELECT p.file, l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, l_partkey, a >= b OR list_contains(list_transform(k, lambda y: y.n), n) AS kept FROM p JOIN g USING (file)""")
def claimed_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which edits of a file go through when each, in order, is refused where it overlaps one that went through."""
    at = (F.col("l_quantity") * 100).cast("long") + F.col("l_partkey") % 100
    order = ["l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice"]
    edits = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("file"), *order, at.alias("a"), (at + F.col("l_orderkey") % 13).alias("b"))
    return layers.claimed(edits, "file", "a", "b", order).select("file", "l_orderkey", F.col("l_linenumber").cast("long").alias("l_linenumber"), "l_partkey", "kept")


@query("""SELECT s_suppkey, s_name FROM supplier WHERE s_suppkey % 10 <> 0 UNION ALL SELECT s_suppkey, upper(s_name) FROM supplier WHERE s_suppkey % 10 = 0 AND s_suppkey % 20 <> 0""")
def overlay_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A what-if layer over a base: rewritten rows stand before the base's, deleted ones hide them."""
    base = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name")
    layer = base.where("s_suppkey % 10 = 0").select("s_suppkey", F.upper("s_name").alias("s_name"), (F.col("s_suppkey") % 20 == 0).alias("deleted"))
    return layers.overlaid(base, layer, "s_suppkey", "deleted")


@query("""SELECT event_id FROM events WHERE event_id % 3 = 0 OR event_id % 4 = 0""")
def incremental_refresh(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows whose content digest differs from the stored one, or that the store lacks."""
    now = table(spark, sf_dir, "events").select("event_id", F.sha2(F.col("props").cast("binary"), 256).alias("digest"))
    kept = now.where("event_id % 4 <> 0").withColumn("digest", F.when(F.col("event_id") % 3 == 0, F.lit("old")).otherwise(F.col("digest")))
    return layers.changed(now, kept, "event_id", "digest")


@query("""SELECT doc_id, CAST(bytes AS BIGINT) AS bytes FROM (SELECT doc_id, strlen(text) AS bytes, sum(strlen(text)) OVER (ORDER BY doc_id // 100 DESC) AS total FROM documents) WHERE total <= 500000""")
def size_eviction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a size limit keeps, newest days first."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.octet_length("text").cast("long").alias("bytes"), F.expr("doc_id div 100").alias("day"))
    days = docs.groupBy("day").agg(F.sum("bytes").alias("b"))
    kept = captures.running(days, -F.col("day"), "b").where("total <= 500000").select("day")
    return docs.join(kept, "day", "left_semi").select("doc_id", "bytes")


@query("""SELECT c_custkey, '{"op":"eq","value":"' || CASE WHEN c_mktsegment = 'BUILDING' THEN 'true' ELSE 'false' END || '","confidence":"declared","reads":"c_mktsegment","inputs":[{"op":"read","value":"' || c_mktsegment || '","confidence":"declared","reads":"c_mktsegment","inputs":[]},{"op":"const","value":"BUILDING","confidence":"declared","reads":"","inputs":[]}]}' AS derivation FROM customer""")
def derivation_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Why a row has its value: the derivation tree as JSON."""
    r = relation(spark, sf_dir, "customer", "c_custkey", "c_mktsegment")
    return r.with_why("derivation", field("c_mktsegment", "str").eq("BUILDING")).project("c_custkey", "derivation").frame(None)


@query("""WITH p AS (SELECT unnest(string_split(n, '.')) AS part, n, unnest(range(1, len(string_split(n, '.')) + 1)) AS i FROM (SELECT replace(replace(split_part(url, '?', 1), '://', '.'), '/', '.') AS n, page_id FROM pages)),
q AS (SELECT array_to_string(list_slice(string_split(n, '.'), 1, i), '.') AS node, i FROM p)
SELECT node, CASE WHEN i > 1 THEN regexp_replace(node, '\\.[^.]*$', '') END AS parent, CAST(i - 1 AS INTEGER) AS depth, count(*) AS members FROM q GROUP BY node, i""")
def package_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tree that the pages' addresses make, read as dotted names."""
    return layers.package_tree(_dotted(spark, sf_dir), "n")


def _dotted(spark: SparkSession, sf_dir: str) -> DataFrame:
    plain = F.replace(F.replace(F.split_part(F.col("url"), F.lit("?"), F.lit(1)), F.lit("://"), F.lit(".")), F.lit("/"), F.lit("."))
    return table(spark, sf_dir, "pages").select("page_id", plain.alias("n"))


@query("""WITH d AS (SELECT page_id, replace(replace(split_part(url, '?', 1), '://', '.'), '/', '.') AS n FROM pages), v AS (SELECT DISTINCT u FROM (SELECT array_to_string(list_slice(string_split(n, '.'), 1, 2), '.') AS u FROM d WHERE n LIKE 'https%' UNION ALL SELECT array_to_string(list_slice(string_split(n, '.'), 1, 3), '.') FROM d WHERE n LIKE '%a%'))
SELECT page_id, (SELECT u FROM v WHERE n = u OR starts_with(n, u || '.') ORDER BY length(u) DESC LIMIT 1) AS unit FROM d""")
def longest_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of a vocabulary of units the longest that each name is below."""
    d = _dotted(spark, sf_dir)
    head = lambda k: F.array_join(F.slice(F.split("n", r"\."), 1, k), ".").alias("u")
    units = d.where("n like 'https%'").select(head(2)).unionByName(d.where("n like '%a%'").select(head(3)))
    return layers.longest_prefix(d, "n", units, "u").select("page_id", "unit")


@query("""WITH o AS (SELECT p_brand, count(*) AS n FROM part WHERE p_size < 25 GROUP BY 1), w AS (SELECT p_brand, count(*) AS n FROM part WHERE p_size >= 25 GROUP BY 1)
SELECT CASE WHEN coalesce(w.n, 0) > coalesce(o.n, 0) THEN 'new' ELSE 'old' END AS side, coalesce(o.p_brand, w.p_brand) AS p_brand, abs(coalesce(w.n, 0) - coalesce(o.n, 0)) AS n FROM o FULL JOIN w USING (p_brand) WHERE coalesce(w.n, 0) <> coalesce(o.n, 0)""")
def multiset_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What one bag of rows has oftener than another."""
    parts = table(spark, sf_dir, "part")
    return layers.both_ways(parts.where("p_size < 25").select("p_brand"), parts.where("p_size >= 25").select("p_brand"))


@query("""WITH o AS (SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_quantity) AS section, 'p' || l_partkey || '.py' AS path, CAST(l_quantity AS BIGINT) % 5 AS added, l_suppkey % 4 AS removed, 1 + l_partkey % 2 AS hunks, CASE WHEN l_partkey % 3 = 0 THEN 2 ELSE 3 END AS heads FROM lineitem),
n AS (SELECT *, heads + hunks + added + removed AS size FROM o)
SELECT l_orderkey, section::INTEGER AS section, path, added, removed, hunks, (1 + CASE WHEN section = 1 AND heads = 2 THEN 1 ELSE 0 END + sum(size) OVER w - size + CASE WHEN section > 1 AND heads = 2 THEN 1 ELSE 0 END)::INTEGER AS first_line, (sum(size) OVER w + CASE WHEN lead(heads) OVER w = 2 THEN 1 ELSE 0 END)::INTEGER AS last_line FROM n WINDOW w AS (PARTITION BY l_orderkey ORDER BY section)""")
def diff_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The files of a diff for each order, with and without a header of git."""
    return summaries.diff_sections(_diffs(spark, sf_dir), "text", "l_orderkey")


def _diffs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An order's lines as a diff: a file for each, some with a header of git; hunks, added and removed lines by its numbers."""
    times = lambda text, n: F.repeat(F.lit(text), n.cast("int"))

    def body(x):
        path = F.concat(F.lit("p"), x["l_partkey"].cast("string"), F.lit(".py"))
        git = F.when(x["l_partkey"] % 3 == 0, F.lit("")).otherwise(F.concat(F.lit("diff --git a/"), path, F.lit(" b/"), path, F.lit("\n")))
        return F.concat(git, F.lit("--- a/"), path, F.lit("\n+++ b/"), path, F.lit("\n"), times("@@ -1 +1 @@\n", 1 + x["l_partkey"] % 2), times("+new\n", x["l_quantity"].cast("long") % 5), times("-old\n", x["removed"]))

    # Numbers meet, not texts; of equal ones the shorter text comes first. An order has few lines.
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", F.struct("l_linenumber", "l_partkey", "l_quantity", (F.col("l_suppkey") % 4).alias("removed")).alias("line"))
    return lines.groupBy("l_orderkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list("line")), body), "").alias("text"))


@query("""WITH t AS (SELECT l_suppkey, 'part' || l_partkey || '.py' AS path, count(*) AS n FROM lineitem GROUP BY 1, 2), g AS (SELECT l_suppkey, sum(n)::INTEGER AS lines, len(list(path))::INTEGER AS paths, list({'path': path, 'matches': n} ORDER BY n DESC, path) AS m FROM t GROUP BY 1),
c AS (SELECT l_suppkey, k, CAST(to_json({'format': 'search', 'lines': lines, 'paths': paths, 'shown': list_slice(m, 1, k)}) AS VARCHAR) AS summary FROM g, (VALUES (8), (4), (2), (1)) v(k)
 UNION ALL SELECT l_suppkey, 0, CAST(to_json({'format': 'search', 'lines': lines, 'paths': paths}) AS VARCHAR) FROM g)
SELECT l_suppkey, 'search' AS format, arg_max(summary, k) FILTER (strlen(summary) <= 180 OR k = 0) AS summary FROM c GROUP BY l_suppkey""")
def search_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A search's output for each supplier, summed up in 180 bytes: as many of the paths with most matches as fit."""
    line = F.concat(F.lit("part"), F.col("l_partkey").cast("string"), F.lit(".py:"), F.col("l_linenumber").cast("string"), F.lit(": found"))
    found = table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.array_join(F.collect_list(line), "\n").alias("text"))
    return summaries.summaries(found, "text", "l_suppkey", most_bytes=180)
