"""What running queries are watched and steered by."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from ..functions.expressions import millis
from ..operators.late import split_late
from ..sources.jdbc import Periodically
from .sinks import Remembered


def watermarked(readings: DataFrame, delay: str = "5 seconds") -> DataFrame:
    """Event time with bounded disorder: the watermark is the greatest time less ``delay``."""
    return readings.withWatermark("ts", delay)


def console(df: DataFrame, mode: str = "append") -> DataStreamWriter:
    """Print results as they come."""
    return df.writeStream.format("console").outputMode(mode).option("truncate", False)


class LateSplit:
    """For ``foreachBatch``: the late filter over arrival order, exact across batches.

    The greatest time of all batches before is remembered by batch, so a batch
    that is run again is split as it was at first.
    """

    def __init__(self, folder: str, delay_ms: int, on_time: Callable[[DataFrame, int], None], late: Callable[[DataFrame, int], None], order: str = "event_id"):
        self.folder, self.delay_ms, self.on_time, self.late, self.order = folder, delay_ms, on_time, late, order

    def _seen(self, spark: SparkSession, batch_id: int) -> Remembered:
        return Remembered(spark, f"{self.folder}/seen-{batch_id}")

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        before = self._seen(spark, batch_id - 1).get()
        seen = int(before) if before else None
        batch = batch.persist()
        try:
            on_time, late = split_late(batch, self.delay_ms, self.order, seen)
            self.on_time(on_time, batch_id)
            self.late(late, batch_id)
            most = batch.agg(F.max(millis(F.col("ts"))).alias("most")).first()["most"]
        finally:
            batch.unpersist()
        known = [x for x in (seen, most) if x is not None]
        self._seen(spark, batch_id).put(str(max(known)) if known else "")


def dashboard(look: Callable[[], dict[str, float]], keys: list[str], show: Callable[[str], None] = print, interval_s: float = 10.0) -> Periodically:
    """A thread that shows the latest values of ``keys``, three decimals each."""

    def once() -> None:
        now = look()
        show("\t| ".join(f"{now[k]:1.3f}" if k in now else "-" for k in keys))

    return Periodically(once, interval_s)
