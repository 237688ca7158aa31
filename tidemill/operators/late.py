"""Watermarks over arrival order, late data, and early results.

The watermark before a row is the greatest time of the rows that arrived before
it, less a delay; before the first row there is none.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.expressions import late_message, millis
from ..model import HOUR_MS
from .scan import running


def with_watermark_before(readings: DataFrame, delay_ms: int, order: str = "event_id", seen_ms: int | None = None) -> DataFrame:
    """Adds ``wm_ms``, null before the first row.  ``seen_ms``: the greatest time of rows before this table's."""
    seen = running(readings, order, {"__most": ("max", millis(F.col("ts")))}, inclusive=False)
    if seen_ms is not None:
        seen = seen.withColumn("__most", F.greatest("__most", F.lit(seen_ms)))
    return seen.withColumn("wm_ms", F.col("__most") - delay_ms).drop("__most")


def periodic_watermark(readings: DataFrame, bound_ms: int, order: str = "event_id") -> DataFrame:
    """The watermark after each row: the greatest time so far less ``bound_ms``."""
    seen = running(readings, order, {"__most": ("max", millis(F.col("ts")))})
    return seen.select(order, (F.col("__most") - bound_ms).alias("wm_ms"))


def punctuated_watermark(readings: DataFrame, bound_ms: int, sensor: str = "sensor_1", order: str = "event_id") -> DataFrame:
    """Only readings of ``sensor`` carry a watermark: their time less ``bound_ms``."""
    return readings.filter(F.col("id") == sensor).select(order, (millis(F.col("ts")) - bound_ms).alias("wm_ms"))


def split_late(readings: DataFrame, delay_ms: int, order: str = "event_id", seen_ms: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(on time, late): a reading is late if its time is below the watermark."""
    known = with_watermark_before(readings, delay_ms, order, seen_ms)
    late = F.coalesce(millis(F.col("ts")) < F.col("wm_ms"), F.lit(False))
    return known.filter(~late), known.filter(late).withColumn("message", late_message(F.col("id")))


def _ends(readings: DataFrame, size_ms: int) -> DataFrame:
    return readings.withColumn("end_ms", (F.floor(millis(F.col("ts")) / size_ms) + 1) * size_ms)


def late_windows(readings: DataFrame, size_ms: int, delay_ms: int, order: str = "event_id") -> tuple[DataFrame, DataFrame]:
    """(counts by key and window, readings too late for their window).

    A reading is too late once the watermark has reached the window's last
    millisecond.
    """
    known = _ends(with_watermark_before(readings, delay_ms, order), size_ms)
    closed = F.coalesce(F.col("end_ms") - 1 <= F.col("wm_ms"), F.lit(False))
    counts = known.filter(~closed).groupBy("id", "end_ms").agg(F.count(F.lit(1)).alias("cnt"))
    return counts, known.filter(closed).withColumn("message", late_message(F.col("id")))


def updating_windows(readings: DataFrame, size_ms: int, delay_ms: int, lateness_ms: int, order: str = "event_id") -> DataFrame:
    """A window's first count, then an updated one for each reading within the allowed lateness."""
    known = _ends(with_watermark_before(readings, delay_ms, order), size_ms)
    last = F.col("end_ms") - 1
    open_, wm = F.col("wm_ms").isNull() | (F.col("wm_ms") < last), F.col("wm_ms")
    kept = known.withColumn("__open", open_).filter(F.col("__open") | (wm < last + lateness_ms))
    first = kept.filter("__open").groupBy("id", "end_ms").agg(F.count(F.lit(1)).alias("cnt")).withColumn("kind", F.lit("first"))
    # Only windows with late readings are numbered row by row, and those are few.
    late = kept.filter("not __open").select("id", "end_ms", order)
    nth = F.row_number().over(W.partitionBy("id", "end_ms").orderBy(order))
    updates = late.withColumn("nth", nth).join(first.select("id", "end_ms", F.col("cnt").alias("base")), ["id", "end_ms"], "left")
    updates = updates.select("id", "end_ms", (F.coalesce("base", F.lit(0)) + F.col("nth")).alias("cnt"), F.when(F.col("base").isNull() & (F.col("nth") == 1), "first").otherwise("update").alias("kind"))
    return first.unionByName(updates)


def early_windows(readings: DataFrame, size_ms: int, delay_ms: int, every_ms: int = HOUR_MS, order: str = "event_id") -> DataFrame:
    """Counts a window shows each whole ``every_ms`` of watermark, and at its end.

    A reading first shows at the next whole step of the watermark it met; the
    first reading of all met none and counts as having met its own time's.
    Steps beyond the final watermark aren't reached; every window's end is, as
    the end of the input closes all windows.
    """
    known = _ends(with_watermark_before(readings, delay_ms, order), size_ms)
    met = F.coalesce("wm_ms", millis(F.col("ts")) - delay_ms)
    shown = known.withColumn("at", (F.floor(met / every_ms) + 1) * every_ms)
    final = readings.agg((F.max(millis(F.col("ts"))) - delay_ms).alias("final_ms")).scalar()
    steps = shown.groupBy("id", "end_ms", "at").agg(F.count(F.lit(1)).alias("n"))
    window = W.partitionBy("id", "end_ms").orderBy("at")
    steps = steps.withColumns({"cnt": F.sum("n").over(window), "until": F.coalesce(F.lead("at").over(window) - every_ms, "end_ms")})
    fired = steps.select("id", "end_ms", F.explode(F.sequence("at", "until", F.lit(every_ms))).alias("eval_ms"), "cnt")
    return fired.filter((F.col("eval_ms") <= final) | (F.col("eval_ms") == F.col("end_ms")))
