"""Enrichment from a dimension table, and final states of upserts."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

UNKNOWN_ROOM = "UNKNOWN ROOM"
#: A dimension is broadcast up to this estimated size.
BROADCAST_BYTES = 64 << 20


def with_room(readings: DataFrame, locations: DataFrame) -> DataFrame:
    """Left join on the sensor; a missing room has a name of its own.

    The dimension is broadcast only while the optimizer's estimate is small;
    beyond that the join shuffles, and AQE splits hot sensors.
    """
    dim = locations.select(F.col("sensor").alias("id"), "room")
    if int(str(dim._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) <= BROADCAST_BYTES:
        dim = F.broadcast(dim)
    return readings.join(dim, "id", "left").withColumn("room", F.coalesce("room", F.lit(UNKNOWN_ROOM)))


def with_room_async(readings: DataFrame, lookup: Callable[[str], str | None], in_flight: int = 100, timeout_s: float = 5.0) -> DataFrame:
    """For services that can't be joined: bounded concurrent lookups, in input order.

    A batch asks once for each sensor.  A lookup that raises or takes longer
    than ``timeout_s`` fails the task.
    """
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in readings.schema) + ", room string"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with ThreadPoolExecutor(in_flight) as pool:
            for b in batches:
                asked = {k: pool.submit(lookup, k) for k in b["id"].unique()}
                found = {k: f.result(timeout=timeout_s) for k, f in asked.items()}
                yield b.assign(room=[found[k] or UNKNOWN_ROOM for k in b["id"]])

    return readings.mapInPandas(run, schema)


def latest_by_key(rows: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """What a table upserted in ``order`` ends as."""
    return rows.groupBy(key).agg(F.max_by(value, order).alias(value))
