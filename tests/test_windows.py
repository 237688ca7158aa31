"""Window functions and folds given in Python, over many windows and odd values."""

import math
import statistics

import pytest
from pyspark.sql import functions as F

from tidemill.operators import windows
from tidemill.plans.catalog import MeanFold, _spread

HOUR = 3_600_000
ROWS = [(f"s{k % 5}" if k % 11 else None, (k * 7919 % 400) * HOUR // 4, None if k % 7 == 0 else float(k % 13)) for k in range(3000)] + [("hot", 5, float(k)) for k in range(2000)] + [("none", 5, None), ("nan", 5, math.nan)]


def read(spark):
    return spark.createDataFrame(ROWS, "id string, ms long, temperature double").select("id", F.timestamp_millis("ms").alias("ts"), "temperature").repartition(5)


def wanted(size):
    by = {}
    for key, ms, t in ROWS:
        by.setdefault((key, (ms // size + 1) * size), []).append(t)
    return by


def told(df):
    return {(r[0], r[1]): tuple(None if x is None else "NaN" if x != x else x for x in r[2:]) for r in df.collect()}


@pytest.mark.parametrize("held", [1, 50_000])
def test_folds_merge_and_pass_nulls_over(spark, monkeypatch, held):
    monkeypatch.setattr(windows, "HELD", held)
    monkeypatch.setattr(windows, "BATCH_ROWS", 7)
    want = {}
    for at, values in wanted(5 * HOUR).items():
        known = [v for v in values if v is not None]
        want[at] = (("NaN" if any(v != v for v in known) else round(sum(known) / len(known), 9)) if known else None,)
    got = windows.folded(read(spark), "5 hours", MeanFold(), "double", "m").withColumn("m", F.round("m", 9))
    assert told(got) == want


def test_functions_see_whole_windows_of_any_size(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "16")  # windows span batches
    try:
        got = told(windows.processed(read(spark), "5 hours", _spread, "id string, end_ms long, seconds long, cnt long, median double"))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = {}
    for at, values in wanted(5 * HOUR).items():
        known = [v for v in values if v is not None]
        want[at] = (18000, len(values), (statistics.median(known) if known[0] == known[0] else "NaN") if known else None)
    assert got == want


def test_functions_may_give_any_rows(spark):
    def each(key, start, end, rows):
        return [(key[0], start, v) for v in rows["temperature"] if v is not None and v > 11]

    got = windows.processed(read(spark), "1 hour", each, "id string, start_ms long, v double").collect()
    assert sorted(map(str, got)) == sorted(f"Row(id={k!r}, start_ms={ms // HOUR * HOUR}, v={t!r})" for k, ms, t in ROWS if t is not None and t > 11)


def test_python_is_not_called_for_each_window(spark):
    """Small windows share batches; a pandas frame for each made large tables run out of time."""
    for df in (windows.folded(read(spark), "5 hours", MeanFold(), "double", "m"), windows.processed(read(spark), "5 hours", _spread, "id string, end_ms long, seconds long, cnt long, median double")):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "MapInArrow" in plan and "InPandas" not in plan
