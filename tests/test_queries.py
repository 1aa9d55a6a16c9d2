"""Every registered query of the engine against DuckDB on the smallest tables."""

from __future__ import annotations

import decimal
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from millrace.plans import registry

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="the tables are not here")


def views(sf: str = SF):
    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return con


def plain(v):
    if isinstance(v, bool):
        return v
    if isinstance(v, (int, decimal.Decimal)):
        return float(v)
    return round(v, 9 if abs(v) < 1e6 else 4) if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, name):
    df = entry.queries()[name](spark, SF)
    rows = df.collect()
    sql = entry.oracle_sql().get(name)
    if sql is None:
        assert rows
        return
    r = views().execute(sql)
    names = [d[0] for d in r.description]
    assert sorted(names) == sorted(df.columns)
    want = sorted(repr(tuple(plain(v) for v in x)) for x in r.fetchall())
    assert sorted(repr(tuple(plain(x[n]) for n in names)) for x in rows) == want


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_plans_push_down_and_prune(spark):
    plan = entry.queries()["op_filter_deleted"](spark, SF).select("l_orderkey")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan
    plan = entry.queries()["op_window_tumbling"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<ts:timestamp_ntz,event_type:string,value:double>" in plan or "event_id" not in plan
    assert "partial_" in plan


def test_reductions_combine_before_the_shuffle(spark):
    for name in ("op_group_by_value", "op_group_first_row"):
        plan = entry.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert "partial_sum" in plan and "Window" not in plan
