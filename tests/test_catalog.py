"""Every catalog query against its SQL, on small tables."""

from __future__ import annotations

import math

import duckdb
import pytest

from latticework.catalog import depot, queries, shop

QUERIES, SQL = queries.QUERIES | shop.QUERIES | depot.QUERIES, queries.SQL | shop.SQL | depot.SQL

SF = "/root/testdata/sf0.01"
TABLES = "region nation customer supplier part orders lineitem events documents pages conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def key(row):
    return tuple((x is None, round(x, 6) if isinstance(x, float) and math.isfinite(x) else x) for x in row)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    got = df.collect()
    if name not in SQL:
        return
    rel = duck.sql(SQL[name])
    assert sorted(df.columns) == sorted(rel.columns)
    order = [rel.columns.index(c) for c in df.columns]
    want = sorted((key([r[i] for i in order]) for r in rel.fetchall()), key=repr)
    assert sorted((key(r) for r in got), key=repr) == want
    assert len(got) > 0
