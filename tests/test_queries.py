"""Every registered query of the core against its SQL twin on the smallest shared tables."""

import math
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from slatewing.plans.queries import QUERIES, SQL


def cells(table):
    def plain(v):
        if v is None or v != v:
            return None
        if isinstance(v, float):
            return round(v, 6) if math.isfinite(v) else v
        return v

    return sorted(repr(tuple(plain(v) for v in row)) for row in table)


@pytest.fixture(scope="module")
def duck(data):
    con = duckdb.connect()
    for p in Path(data).glob("*.parquet"):
        con.sql(f"create view {p.stem} as select * from '{p}'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, data, duck, name):
    df = QUERIES[name](spark, data)
    columns = sorted(df.columns)
    got = [tuple(r) for r in df.select(*columns).collect()]
    if name in SQL:
        want = duck.sql(f"select {', '.join(columns)} from ({SQL[name]})")
        assert cells(got) == cells(want.fetchall())
    else:
        assert got


def test_entry(spark, data):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_filters_and_columns_reach_the_scan(spark, data):
    plan = QUERIES["q6_forecast_revenue"](spark, data)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(l_shipdate" in plan and "LessThan(l_quantity,24.0)" in plan
    assert "l_returnflag" not in plan.split("ReadSchema")[1]
    plan = QUERIES["q3_shipping_priority"](spark, data)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
