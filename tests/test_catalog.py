"""Every catalogued query against its SQL."""

import duckdb
import pytest

from tidemill.plans import catalog


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    con.sql(f"create view events as select * from '{sf_dir}/events.parquet'")
    return con


#: At this scale events are too far apart for any to be late.
SPARSE = {"late_filter_late", "late_window_side_output"}


def test_each_query_has_an_oracle():
    assert set(catalog.QUERIES) == set(catalog.ORACLES)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query_matches_sql(spark, duck, sf_dir, name):
    got = catalog.QUERIES[name](spark, sf_dir)
    want = duck.sql(catalog.ORACLES[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    rows = sorted(tuple(r[c] for c in columns) for r in got.collect())
    assert rows == sorted(want.select(*columns).fetchall())
    assert rows or name in SPARSE


def test_flagship_plan_prunes_and_preaggregates(spark, sf_dir):
    plan = catalog.QUERIES["avg_temp_celsius_per_window"](spark, sf_dir)._jdf.queryExecution().toString()
    assert "ReadSchema: struct<ts:timestamp_ntz,user_id:bigint,value:double>" in plan
    assert "partial_avg" in plan
