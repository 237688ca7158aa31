"""Projections, filters and side outputs; valid on tables and streams alike."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expressions import after, freezing_message, shuffled_offset_ms, to_celsius


def celsius(readings: DataFrame) -> DataFrame:
    return readings.withColumn("temperature", to_celsius(F.col("temperature")))


def at_least(readings: DataFrame, threshold: float = 25) -> DataFrame:
    return readings.filter(F.col("temperature") >= threshold)


def sensor_ids(readings: DataFrame) -> DataFrame:
    return readings.select("id")


def split_ids(readings: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row for each part of the id between underscores."""
    return readings.select(*keep, F.explode(F.split("id", "_")).alias("part"))


def side_outputs(df: DataFrame, outputs: Mapping[str, tuple[Column, Callable[[DataFrame], DataFrame]]]) -> tuple[DataFrame, dict[str, DataFrame]]:
    """All of ``df``, and for each tag what it selects, transformed.

    On a stream, fan out within ``foreachBatch`` so the source is read once.
    """
    return df, {tag: shape(df.filter(chosen)) for tag, (chosen, shape) in outputs.items()}


def monitor_freezing(readings: DataFrame, keep: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """Every reading, and a message for each below 32 degrees Fahrenheit."""
    shape = lambda d: d.select(*keep, freezing_message(F.col("id")).alias("message"))
    main, sides = side_outputs(readings, {"freezing": (F.col("temperature") < 32.0, shape)})
    return main, sides["freezing"]


def shuffle_timestamps(readings: DataFrame, most_ms: int, row_id: str = "event_id") -> DataFrame:
    """Delay each reading's time by a repeatable pseudo-random amount below ``most_ms``."""
    return readings.withColumn("ts", after(F.col("ts"), shuffled_offset_ms(F.col(row_id), most_ms)))


def fail_on(df: DataFrame, nth: int, order: str) -> DataFrame:
    """For tests of recovery: pass rows through, raise on the ``nth`` (from 1) by ``order``."""
    message = F.raise_error(F.lit(f"injected failure at row {nth}"))
    return df.filter(F.when(F.col(order) == nth - 1, message.cast("boolean")).otherwise(F.lit(True)))
