"""Queries over the driver tables against DuckDB, where both are there."""

from __future__ import annotations

import os

import pytest

from tracewell.plans.driver_queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
duckdb = pytest.importorskip("duckdb")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no driver tables")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    return c


def told(x):
    if x is None or x != x:
        return "null"
    return str(x) if isinstance(x, bool | str) else repr(round(float(x), 6))


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_is_its_sql(spark, con, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    mine = sorted("|".join(told(r[c]) for c in columns) for r in (r.asDict() for r in df.collect()))
    cursor = con.execute(ORACLES[name])
    names = [c[0] for c in cursor.description]
    assert sorted(names) == columns
    assert mine == sorted("|".join(told(dict(zip(names, r, strict=True))[c]) for c in columns) for r in cursor.fetchall())
