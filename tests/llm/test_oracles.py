"""Operator queries against their SQL."""

from __future__ import annotations

from collections import Counter

import duckdb
import pytest

from latticework.llm import queries

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query(spark, name):
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = queries.queries()[name](spark, SF)
    rel = con.sql(queries.oracle_sql()[name])
    assert sorted(df.columns) == sorted(rel.columns)
    order = [rel.columns.index(c) for c in df.columns]
    want = Counter(tuple(r[i] for i in order) for r in rel.fetchall())
    assert Counter(tuple(r) for r in df.collect()) == want and len(want) > 900
