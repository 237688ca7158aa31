"""Operators with two inputs or timers, over tables in arrival order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.expressions import increase_message, millis
from .rolling import with_previous
from .scan import latest_before, running


def switched(rows: DataFrame, is_switch: Column, duration_ms: Column | int, order: str = "event_id") -> DataFrame:
    """Readings within ``duration_ms`` of a switch of the same key, half open.

    A switch only ever extends the time, so the greatest end seen decides.
    """
    end = millis(F.col("ts")) + (F.lit(duration_ms) if isinstance(duration_ms, int) else duration_ms)
    known = running(rows.withColumn("__switch", is_switch), order, {"until": ("max", F.when(F.col("__switch"), end))}, ("id",))
    return known.filter(~F.col("__switch") & (millis(F.col("ts")) < F.col("until"))).drop("__switch", "until")


def fire_alerts(rows: DataFrame, level: Column, high: float = 100.0, order: str = "event_id") -> DataFrame:
    """Readings above ``high`` while the latest smoke level of all is High.

    ``level`` is null for readings; before any level it is Low.
    """
    known = latest_before(rows.withColumn("__level", level), order, "latest", F.col("__level"), where=F.col("__level").isNotNull())
    alarm = F.col("__level").isNull() & (F.col("latest.v") == "High") & (F.col("temperature") > high)
    return known.filter(alarm).select(order, F.lit("Risk of fire!").alias("message"), millis(F.col("ts")).alias("ts_ms"))


def threshold_alerts(readings: DataFrame, thresholds: DataFrame, order: str = "event_id", most_bytes: int = 64 << 20) -> DataFrame:
    """Alerts of sensors that have a threshold; the last update of a sensor counts, 0.0 removes it.

    ``thresholds``: (seq, id, threshold).  The effective table is broadcast
    only while the optimizer's estimate of it is small.
    """
    now = thresholds.groupBy("id").agg(F.max_by("threshold", "seq").alias("threshold")).filter(F.col("threshold") != 0.0)
    small = int(str(thresholds._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) <= most_bytes
    wanted = readings.join(F.broadcast(now) if small else now, "id")
    known = with_previous(wanted, order)
    diff = F.abs(F.col("temperature") - F.coalesce(F.col("prev.v"), F.lit(0.0)))
    return known.withColumn("diff", diff).filter(F.col("diff") > F.col("threshold")).select(order, "id", "temperature", "diff")


def self_cleaning_alerts(readings: DataFrame, threshold: float, ttl_ms: int, delay_ms: int, order: str = "event_id") -> DataFrame:
    """Change alerts that forget a key's reading once the watermark is ``ttl_ms`` beyond it."""
    most = running(readings.withColumn("__ms", millis(F.col("ts"))), order, {"__most": ("max", F.col("__ms"))}, inclusive=False)
    seen = latest_before(most, order, "prev", F.struct("temperature", "__ms"), ("id",))
    expired = F.col("__most") - delay_ms >= F.col("prev.v.__ms") + ttl_ms
    last = F.when(F.col("prev").isNull() | expired, 0.0).otherwise(F.col("prev.v.temperature"))
    return seen.withColumn("diff", F.abs(F.col("temperature") - last)).filter(F.col("diff") > threshold).select(order, "id", "temperature", "diff")


def increase_alerts(readings: DataFrame, hold_ms: int, order: str = "event_id") -> DataFrame:
    """A message when a sensor hasn't fallen for ``hold_ms`` since a rise.

    A rise sets a timer unless one runs; a fall cancels it; a timer that is
    reached fires and the next rise sets another.  0.0 means that no reading
    came before.  Readings are cut into runs without a fall; a run's rises fold
    into its timers.  The last run of a sensor lasts to the input's end.
    """
    known = with_previous(readings.withColumn("__ms", millis(F.col("ts"))), order)
    last = F.when(F.col("prev.v") != 0.0, F.col("prev.v"))
    known = known.withColumns({"__up": F.coalesce(F.col("temperature") > last, F.lit(False)), "__down": F.coalesce(F.col("temperature") < last, F.lit(False))})
    runs = running(known, order, {"__run": ("sum", F.col("__down").cast("long"))}, ("id",))
    end = readings.agg(F.max(millis(F.col("ts"))).alias("end")).scalar()
    rises = F.sort_array(F.collect_list(F.when(F.col("__up"), F.col("__ms"))))
    folded = runs.groupBy("id", "__run").agg(rises.alias("rises"), F.min("__ms").alias("began"))
    folded = folded.withColumn("until", F.coalesce(F.lead("began").over(W.partitionBy("id").orderBy("__run")), end))
    none = F.array().cast("array<bigint>")
    timers = F.aggregate("rises", none, lambda acc, t: F.when(F.size(acc) == 0, F.array(t + hold_ms)).when(t >= F.get(acc, F.size(acc) - 1), F.concat(acc, F.array(t + hold_ms))).otherwise(acc))
    fired = folded.filter(F.size("rises") > 0).select("id", "until", F.explode(timers).alias("fired_ms"))
    return fired.filter(F.col("fired_ms") <= F.col("until")).select("id", "fired_ms", increase_message(F.col("id")).alias("message"))
