"""Generated streams as Python data sources.

Rows are a pure function of an offset range, so a replayed batch holds the
same rows.  Offsets carry what the generator remembers (the walk's present
temperatures), which makes them its checkpoint.
"""

from __future__ import annotations

import json
import random
import time
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

TICK_MS = 100
SENSORS = 10


def _gauss(*seed: object) -> float:
    return random.Random("|".join(map(str, seed))).gauss(0, 1)


def _at(ms: int) -> datetime:
    return datetime.fromtimestamp(ms / 1000, timezone.utc)


def start_temperatures(sensors: int, seed: object) -> list[float]:
    return [65 + 20 * _gauss(seed, "start", k) for k in range(sensors)]


def step(temps: list[float], ms: int, seed: object, numbers: Sequence[int] | None = None) -> list[float]:
    """One tick of the walks of sensors ``numbers``; the draw depends on the tick's time and the present temperature."""
    return [t + 0.5 * _gauss(seed, ms ^ int(t), k) for k, t in zip(range(len(temps)) if numbers is None else numbers, temps, strict=True)]


@dataclass
class Span(InputPartition):
    """Ticks ``first`` to ``last`` - 1 of sensors whose numbers are ``numbers``."""

    first: int
    last: int
    numbers: list[int]
    temps: list[float]


class SensorReader(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.subtasks = int(options.get("subtasks", 1))
        self.per_batch = int(options.get("ticksperbatch", 10))
        self.most = int(options.get("maxticks", 0)) or None
        self.first_number = int(options.get("firstnumber", 0))
        self.start_ms = int(options.get("startms", 0))
        self.seed = options.get("seed", "0")
        self.now = None

    def initialOffset(self) -> dict:
        return {"tick": 0, "temps": json.dumps(start_temperatures(SENSORS * self.subtasks, self.seed))}

    def latestOffset(self) -> dict:
        self.now = self._ahead(self.now or self.initialOffset())
        return self.now

    def _ahead(self, at: dict) -> dict:
        tick, temps = at["tick"], json.loads(at["temps"])
        last = min(tick + self.per_batch, self.most or tick + self.per_batch)
        for n in range(tick, last):
            temps = step(temps, self.start_ms + (n + 1) * TICK_MS, self.seed)
        return {"tick": last, "temps": json.dumps(temps)}

    def partitions(self, start: dict, end: dict) -> list[Span]:
        self.now = end if self.now is None or end["tick"] > self.now["tick"] else self.now
        # What an offset remembers is dealt by index over the subtasks of now, however many there were before.
        temps = json.loads(start["temps"])
        dealt = [range(k, len(temps), self.subtasks) for k in range(self.subtasks)]
        return [Span(start["tick"], end["tick"], list(some), [temps[k] for k in some]) for some in dealt if some]

    def read(self, partition: Span) -> Iterator[tuple]:
        temps = partition.temps
        for n in range(partition.first, partition.last):
            ms = self.start_ms + (n + 1) * TICK_MS
            temps = step(temps, ms, self.seed, partition.numbers)
            for k, t in zip(partition.numbers, temps, strict=True):
                yield f"sensor_{k + self.first_number}", _at(ms), t

    def commit(self, end: dict) -> None:
        pass


class ReplayableSensors(DataSource):
    """Sensors numbered from 0, with a logical clock of 100 ms ticks."""

    @classmethod
    def name(cls) -> str:
        return "replayable_sensors"

    def schema(self) -> str:
        return "id string, ts timestamp, temperature double"

    def streamReader(self, schema) -> SensorReader:
        return SensorReader({k.lower(): v for k, v in self.options.items()})


class LiveSensors(ReplayableSensors):
    """Sensors numbered from 1, seeded by and starting at the wall clock."""

    @classmethod
    def name(cls) -> str:
        return "live_sensors"

    def streamReader(self, schema) -> SensorReader:
        now = str(int(time.time() * 1000))
        return SensorReader({"firstnumber": "1", "startms": now, "seed": now} | {k.lower(): v for k, v in self.options.items()})


@dataclass
class Numbers(InputPartition):
    first: int
    last: int


class CountReader(DataSourceStreamReader):
    """Whole numbers from 0; each batch takes the next ``perbatch``, in ``subtasks`` ranges."""

    def __init__(self, options: dict):
        self.per_batch, self.parts = int(options.get("perbatch", 100)), int(options.get("subtasks", 1))
        self.most = int(options.get("most", 0)) or None
        self.now = 0

    def initialOffset(self) -> dict:
        return {"n": 0}

    def latestOffset(self) -> dict:
        self.now = self.now + self.per_batch if self.most is None else min(self.most, self.now + self.per_batch)
        return {"n": self.now}

    def partitions(self, start: dict, end: dict) -> list[Numbers]:
        self.now = max(self.now, end["n"])
        cuts = [start["n"] + (end["n"] - start["n"]) * k // self.parts for k in range(self.parts + 1)]
        return [Numbers(a, b) for a, b in zip(cuts, cuts[1:], strict=False)]

    def read(self, partition: Numbers) -> Iterator[tuple]:
        for n in range(partition.first, partition.last):
            yield (n,)

    def commit(self, end: dict) -> None:
        pass


class CountBatch(DataSourceReader):
    def __init__(self, most: int, parts: int):
        self.most, self.parts = most, parts

    def partitions(self) -> list[Numbers]:
        cuts = [self.most * k // self.parts for k in range(self.parts + 1)]
        return [Numbers(a, b) for a, b in zip(cuts, cuts[1:], strict=False)]

    def read(self, partition: Numbers) -> Iterator[tuple]:
        for n in range(partition.first, partition.last):
            yield (n,)


class Counter(DataSource):
    @classmethod
    def name(cls) -> str:
        return "replayable_counter"

    def schema(self) -> str:
        return "n long"

    def _options(self) -> dict:
        return {k.lower(): v for k, v in self.options.items()}

    def reader(self, schema) -> CountBatch:
        o = self._options()
        return CountBatch(int(o["most"]), int(o.get("subtasks", 1)))

    def streamReader(self, schema) -> CountReader:
        return CountReader(self._options())


class SmokeReader(CountReader):
    def __init__(self, options: dict):
        super().__init__(options)
        self.seed = options.get("seed", "0")

    def read(self, partition: Numbers) -> Iterator[tuple]:
        for n in range(partition.first, partition.last):
            yield ("High" if _gauss(self.seed, n) > 0.8 else "Low",)


class SmokeLevels(Counter):
    """A smoke level a second: High about one time in five."""

    @classmethod
    def name(cls) -> str:
        return "smoke_levels"

    def schema(self) -> str:
        return "level string"

    def streamReader(self, schema) -> SmokeReader:
        return SmokeReader({"perbatch": "1"} | self._options())


ALL = (ReplayableSensors, LiveSensors, Counter, SmokeLevels)


def register(spark: SparkSession) -> None:
    for source in ALL:
        spark.dataSource.register(source)


def count_source(spark: SparkSession, n: int) -> DataFrame:
    """The counter's first ``n`` numbers as a table, made by Spark itself."""
    return spark.range(n).withColumnRenamed("id", "n")


def from_elements(spark: SparkSession, rows: list[tuple], schema) -> DataFrame:
    """A bounded literal source."""
    return spark.createDataFrame(rows, schema)
