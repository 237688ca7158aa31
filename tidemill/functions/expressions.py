"""Scalar expressions of the sensor programs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def to_celsius(fahrenheit: Column) -> Column:
    return (fahrenheit - 32) * (5.0 / 9.0)


def late_message(sensor: Column) -> Column:
    return F.concat(F.lit("*** late reading *** "), sensor)


def freezing_message(sensor: Column) -> Column:
    return F.concat(F.lit("Freezing Alarm for "), sensor)


def increase_message(sensor: Column) -> Column:
    return F.concat(F.lit("Temperature of sensor '"), sensor, F.lit("' monotonically increased for 1 second."))


def iso_time(ts: Column) -> Column:
    """Whole seconds, UTC, without a zone."""
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")


def millis(ts: Column) -> Column:
    return F.unix_millis(ts)


def after(ts: Column, ms: Column | int) -> Column:
    """The time ``ms`` later."""
    ms = F.lit(ms) if isinstance(ms, int) else ms
    return F.timestamp_micros(F.unix_micros(ts) + ms.cast("long") * 1000)


def checkpoint_mark(number: Column) -> Column:
    """A checkpoint's number as 0x and 16 hexadecimal digits."""
    return F.concat(F.lit("0x"), F.lpad(F.lower(F.hex(number.cast("long"))), 16, "0"))


def parse_checkpoint_mark(mark: Column) -> Column:
    return F.conv(F.regexp_replace(mark, "^0x", ""), 16, 10).cast("long")


def dashboard_line(*temperatures: Column) -> Column:
    """Three decimals each, joined for a terminal."""
    return F.concat_ws("\t| ", *[F.coalesce(F.format_string("%1.3f", t), F.lit("-")) for t in temperatures])


def shuffled_offset_ms(row_id: Column, most_ms: int, step_ms: int = 1000) -> Column:
    """A repeatable stand-in for a random delay below ``most_ms``, by multiplying the row's id."""
    return F.pmod(row_id * 7919, F.lit(most_ms // step_ms)) * step_ms
