"""Record types, and the sensor view of the ``events`` table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _struct(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in fields])


_S, _D, _L, _TS = T.StringType(), T.DoubleType(), T.LongType(), T.TimestampType()

SENSOR_READING = _struct(("id", _S), ("ts", _TS), ("temperature", _D))
SMOKE_LEVEL = _struct(("level", _S))
FIRE_ALERT = _struct(("message", _S), ("ts_ms", _L))
THRESHOLD_UPDATE = _struct(("id", _S), ("threshold", _D))
FORWARD_SWITCH = _struct(("id", _S), ("duration_ms", _L))
SENSOR_LOCATION = _struct(("sensor", _S), ("room", _S))
COUNTER = _struct(("n", _L))
MIN_MAX_TEMP = _struct(("id", _S), ("min_temp", _D), ("max_temp", _D), ("end_ms", _L))
TEMP_ALERT = _struct(("id", _S), ("temperature", _D), ("diff", _D))
EVENTS = _struct(("event_id", _L), ("ts", T.TimestampNTZType()), ("user_id", _L), ("event_type", _S), ("value", _D), ("props", _S))

#: A second of the sensor programs is an hour of the events table, whose rows are minutes apart.
HOUR_MS = 3_600_000


def sensor_view(events: DataFrame) -> DataFrame:
    """events -> (event_id, user_id, id, ts, temperature, event_type).

    ``event_id`` is the order of arrival.  The time column becomes a zoned
    timestamp, which watermarks ask for; the session's zone is UTC.
    """
    return events.select(
        "event_id",
        "user_id",
        F.concat(F.lit("sensor_"), F.col("user_id").cast("string")).alias("id"),
        F.col("ts").cast("timestamp").alias("ts"),
        F.col("value").alias("temperature"),
        "event_type",
    )


def readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sensor_view(spark.read.parquet(f"{sf_dir}/events.parquet"))
