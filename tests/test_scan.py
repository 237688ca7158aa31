"""Running aggregates agree with a plain window, however the order is cut."""

import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemill.operators.scan import latest_before, running


@pytest.mark.parametrize("block", [1, 7, 1000])
@pytest.mark.parametrize("inclusive", [True, False])
def test_running_equals_window(spark, block, inclusive):
    df = spark.range(200).select(F.col("id").alias("n"), F.when(F.col("id") % 4 < 3, F.col("id") % 4).alias("k"), F.when(F.hash("id") % 4 != 0, F.abs(F.hash("id")) % 100).alias("x"))
    w = W.partitionBy("k").orderBy("n").rowsBetween(W.unboundedPreceding, W.currentRow if inclusive else -1)
    want = df.select("n", F.max("x").over(w).alias("m"), F.sum("x").over(w).alias("s"))
    got = running(df, "n", {"m": ("max", F.col("x")), "s": ("sum", F.col("x"))}, ("k",), inclusive, block).select("n", "m", "s")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_latest_before_over_all_rows(spark):
    df = spark.createDataFrame([(0, None), (1, "a"), (2, None), (5, "b"), (9, None)], "n long, v string")
    got = latest_before(df, "n", "last", F.col("v"), where=F.col("v").isNotNull()).orderBy("n").collect()
    assert [r["last"]["v"] if r["last"] else None for r in got] == [None, None, "a", "a", "b"]
