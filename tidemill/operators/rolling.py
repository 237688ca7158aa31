"""Un-windowed keyed operators: one output for each input, in arrival order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expressions import millis
from .scan import latest_before, running


def rolling_sum(df: DataFrame, key: str, value: str, carried: str, order: str) -> DataFrame:
    """Running sum of ``value``; ``carried`` keeps the key's first value."""
    first = F.max(F.struct((-F.col(order)).alias("o"), F.col(carried).alias("v")))
    firsts = df.groupBy(key).agg(first["v"].alias("__first"))
    out = running(df, order, {"running_sum": ("sum", F.col(value))}, (key,)).join(firsts, key)
    return out.select(order, key, "running_sum", F.col("__first").alias(carried))


def rolling_max(readings: DataFrame, order: str = "event_id") -> DataFrame:
    """The reading with the highest temperature so far; of equal ones the newest."""
    best = F.struct("temperature", F.col(order).alias("o"), "ts")
    out = running(readings, order, {"best": ("max", best)}, ("id",))
    return out.select(order, "id", F.col("best.temperature").alias("max_temp"), millis(F.col("best.ts")).alias("max_ts_ms"))


def with_previous(readings: DataFrame, order: str = "event_id", key: str = "id") -> DataFrame:
    """Adds ``prev``: (order, v) of the same key's reading before."""
    return latest_before(readings, order, "prev", F.col("temperature"), (key,))


def change_alerts(readings: DataFrame, threshold: float = 1.7, first_counts: bool = True, order: str = "event_id") -> DataFrame:
    """Readings that differ from the one before by more than ``threshold``.

    A key's first reading is compared with 0.0, or never alerts if
    ``first_counts`` is false.
    """
    known = with_previous(readings, order)
    last = F.coalesce(F.col("prev.v"), F.lit(0.0)) if first_counts else F.col("prev.v")
    return known.withColumn("diff", F.abs(F.col("temperature") - last)).filter(F.col("diff") > threshold).select(order, "id", "temperature", "diff")


def bucket(column: str, buckets: int) -> Column:
    """What stands for a parallel instance: results don't depend on the cluster's size."""
    return F.pmod(F.col(column), F.lit(buckets)).cast("int")


def high_counts_per_bucket(readings: DataFrame, threshold: float = 120.0, buckets: int = 4, order: str = "event_id") -> DataFrame:
    """Running number of readings above ``threshold`` in each bucket."""
    high = readings.filter(F.col("temperature") > threshold).withColumn("bucket", bucket("user_id", buckets))
    return running(high, order, {"cnt": ("count", F.lit(1))}, ("bucket",)).select(order, "bucket", "cnt")


def high_counts(readings: DataFrame, threshold: float = 10.0, buckets: int = 4, order: str = "event_id") -> DataFrame:
    """Running numbers of readings above ``threshold`` of the key and of its bucket."""
    high = readings.filter(F.col("temperature") > threshold).withColumn("bucket", bucket("user_id", buckets))
    by_key = running(high, order, {"key_cnt": ("count", F.lit(1))}, ("id",))
    return running(by_key, order, {"op_cnt": ("count", F.lit(1))}, ("bucket",)).select(order, "id", "key_cnt", "op_cnt")
