"""Keyed stateful operators for ``groupBy(key).transformWithState(...)``.

Rows of a batch are taken in arrival order.  Two-input operators read one
tagged union of both inputs (``kind``), where a control row wins ties.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle


def arrival(rows: Iterator[Row]) -> list[Row]:
    return sorted(rows, key=lambda r: (r["event_id"], r["kind"] == "reading" if "kind" in r else True))


def tagged(readings: DataFrame, control: DataFrame) -> DataFrame:
    """One input of two: rows get ``kind`` reading or control, missing columns are null."""
    return readings.withColumn("kind", F.lit("reading")).unionByName(control.withColumn("kind", F.lit("control")), allowMissingColumns=True)


def replicated(control: DataFrame, buckets: int) -> DataFrame:
    """Control rows for every bucket: what broadcasting them to all instances is."""
    return control.withColumn("bucket", F.explode(F.sequence(F.lit(0), F.lit(buckets - 1))))


class _One(StatefulProcessor):
    """Holds one value state; ``fold`` maps (state, row) to (state, output rows)."""

    STATE = ""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", self.STATE)

    def fold(self, state: tuple | None, row: Row) -> tuple[tuple | None, list[Row]]:
        raise NotImplementedError

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        state = self.state.get() if self.state.exists() else None
        for row in arrival(rows):
            state, out = self.fold(state, row)
            yield from out
        if state is not None:
            self.state.update(state)

    def close(self) -> None:
        pass


class RollingSum(_One):
    """(user_id, event_id, running_sum, carried): input has value and carried."""

    STATE = "total long, carried string"
    OUTPUT = "event_id long, user_id long, running_sum long, event_type string"

    def fold(self, state, row):
        total, carried = state if state else (0, row["event_type"])
        total += row["value"]
        return (total, carried), [Row(event_id=row["event_id"], user_id=row["user_id"], running_sum=total, event_type=carried)]


class RollingMax(_One):
    STATE = "temperature double, ms long"
    OUTPUT = "event_id long, id string, max_temp double, max_ts_ms long"

    def fold(self, state, row):
        now = (row["temperature"], row["ts_ms"])
        best = state if state and state[0] > now[0] else now  # ties go to the newer
        return tuple(best), [Row(event_id=row["event_id"], id=row["id"], max_temp=best[0], max_ts_ms=best[1])]


class ChangeAlert(_One):
    STATE = "temperature double"
    OUTPUT = "event_id long, id string, temperature double, diff double"

    def __init__(self, threshold: float = 1.7, first_counts: bool = True):
        self.threshold, self.first_counts = threshold, first_counts

    def fold(self, state, row):
        last = state[0] if state else 0.0 if self.first_counts else None
        diff = abs(row["temperature"] - last) if last is not None else 0.0
        out = [Row(event_id=row["event_id"], id=row["id"], temperature=row["temperature"], diff=diff)] if diff > self.threshold else []
        return (row["temperature"],), out


class SelfCleaningAlert(StatefulProcessor):
    """Change alerts; an event-time timer clears what a key hasn't renewed in time."""

    OUTPUT = ChangeAlert.OUTPUT

    def __init__(self, threshold: float, ttl_ms: int):
        self.threshold, self.ttl_ms = threshold, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", "temperature double, timer long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        last, timer = self.state.get() if self.state.exists() else (0.0, None)
        if timer is not None and timer <= timerValues.getCurrentWatermarkInMs():
            last = 0.0  # due, though Spark expires timers after a batch's rows
        for row in arrival(rows):
            if timer is not None:
                self.handle.deleteTimer(timer)
            timer = row["ts_ms"] + self.ttl_ms
            self.handle.registerTimer(timer)
            diff = abs(row["temperature"] - last)
            if diff > self.threshold:
                yield Row(event_id=row["event_id"], id=row["id"], temperature=row["temperature"], diff=diff)
            last = row["temperature"]
        self.state.update((last, timer))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        self.state.clear()
        return iter([])

    def close(self) -> None:
        pass


class IncreaseAlert(StatefulProcessor):
    """A message once a sensor has risen and not fallen for ``hold_ms``.

    Works in event and in processing time: ``clock`` gives the time that a
    row's timer counts from.
    """

    OUTPUT = "id string, fired_ms long"

    def __init__(self, hold_ms: int, clock: Callable | None = None):
        self.hold_ms, self.clock = hold_ms, clock

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", "temperature double, timer long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        last, timer = self.state.get() if self.state.exists() else (0.0, 0)
        for row in arrival(rows):
            now = row["temperature"]
            if timer and self.clock is None and row["ts_ms"] >= timer:  # reached within the batch
                self.handle.deleteTimer(timer)
                yield Row(id=key[0], fired_ms=timer)
                timer = 0
            if last != 0.0 and now < last and timer:
                self.handle.deleteTimer(timer)
                timer = 0
            elif last != 0.0 and now > last and not timer:
                timer = (self.clock(timerValues) if self.clock else row["ts_ms"]) + self.hold_ms
                self.handle.registerTimer(timer)
            last = now
        self.state.update((last, timer))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        last, _ = self.state.get()
        self.state.update((last, 0))
        yield Row(id=key[0], fired_ms=expiredTimerInfo.getExpiryTimeInMs())

    def close(self) -> None:
        pass


def processing_clock(timer_values) -> int:
    return timer_values.getCurrentProcessingTimeInMs()


class SwitchFilter(_One):
    """Forwards readings until the time the latest switches of the key allow."""

    STATE = "until long"
    OUTPUT = "event_id long, id string, temperature double"

    def fold(self, state, row):
        until = state[0] if state else 0
        if row["kind"] == "control":
            return (max(until, row["ts_ms"] + row["duration_ms"]),), []
        passed = row["ts_ms"] < until
        return (until,), [Row(event_id=row["event_id"], id=row["id"], temperature=row["temperature"])] if passed else []


class FireAlert(_One):
    """Keyed by bucket; control rows are replicated to every bucket."""

    STATE = "level string"
    OUTPUT = "event_id long, message string, ts_ms long"

    def __init__(self, high: float = 100.0):
        self.high = high

    def fold(self, state, row):
        level = state[0] if state else "Low"
        if row["kind"] == "control":
            return (row["level"],), []
        fire = level == "High" and row["temperature"] > self.high
        return (level,), [Row(event_id=row["event_id"], message="Risk of fire!", ts_ms=row["ts_ms"])] if fire else []


class ThresholdAlert(_One):
    """Alerts by a threshold that control rows of the key set, and remove by 0.0."""

    STATE = "temperature double, threshold double"
    OUTPUT = ChangeAlert.OUTPUT

    def fold(self, state, row):
        last, threshold = state if state else (0.0, None)
        if row["kind"] == "control":
            return (last, row["threshold"] or None), []
        diff = abs(row["temperature"] - last)
        alert = threshold is not None and diff > threshold
        return (row["temperature"], threshold), [Row(event_id=row["event_id"], id=row["id"], temperature=row["temperature"], diff=diff)] if alert else []


class HighCount(_One):
    """Running number of readings above a threshold, of whatever the key is."""

    STATE = "cnt long"
    OUTPUT = "event_id long, bucket int, cnt long"

    def __init__(self, threshold: float = 120.0):
        self.threshold = threshold

    def fold(self, state, row):
        n = state[0] if state else 0
        if not row["temperature"] > self.threshold:
            return (n,), []
        return (n + 1,), [Row(event_id=row["event_id"], bucket=row["bucket"], cnt=n + 1)]


class HighCounts(StatefulProcessor):
    """Keyed by bucket: running numbers of the bucket and of each sensor in it."""

    OUTPUT = "event_id long, id string, key_cnt long, op_cnt long"

    def __init__(self, threshold: float = 10.0):
        self.threshold = threshold

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.total = handle.getValueState("total", "cnt long")
        self.by_sensor = handle.getMapState("by_sensor", "id string", "cnt long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        total = self.total.get()[0] if self.total.exists() else 0
        for row in arrival(rows):
            if row["temperature"] > self.threshold:
                sensor = (row["id"],)
                n = (self.by_sensor.getValue(sensor)[0] if self.by_sensor.containsKey(sensor) else 0) + 1
                self.by_sensor.updateValue(sensor, (n,))
                total += 1
                yield Row(event_id=row["event_id"], id=row["id"], key_cnt=n, op_cnt=total)
        self.total.update((total,))

    def close(self) -> None:
        pass


class EarlyCount(StatefulProcessor):
    """Counts of tumbling windows at each whole step of the watermark and at the window's end."""

    OUTPUT = "id string, end_ms long, eval_ms long, cnt long"

    def __init__(self, size_ms: int, every_ms: int):
        self.size_ms, self.every_ms = size_ms, every_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.counts = handle.getMapState("counts", "end_ms long", "cnt long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        mark = timerValues.getCurrentWatermarkInMs()
        for row in arrival(rows):
            end = (row["ts_ms"] // self.size_ms + 1) * self.size_ms
            if mark >= end:
                continue
            new = not self.counts.containsKey((end,))
            self.counts.updateValue((end,), ((0 if new else self.counts.getValue((end,))[0]) + 1,))
            if new:
                first = (mark if mark > 0 else row["ts_ms"]) // self.every_ms * self.every_ms + self.every_ms
                self.handle.registerTimer(min(first, end))
                self.handle.registerTimer(end)
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        at, ended = expiredTimerInfo.getExpiryTimeInMs(), []
        for (end,), (n,) in list(self.counts.iterator()):
            if at <= end and at > end - self.size_ms - self.every_ms:
                yield Row(id=key[0], end_ms=end, eval_ms=at, cnt=n)
            if at >= end:
                ended.append(end)
            elif at + self.every_ms < end:
                self.handle.registerTimer(at + self.every_ms)
        for end in ended:
            self.counts.removeKey((end,))

    def close(self) -> None:
        pass


class UpdatingCount(StatefulProcessor):
    """First window counts when the watermark closes a window, then an update for each late reading.

    Spark drops rows behind its own watermark before they come here, so the
    stream declares one that lags by ``slack_ms`` = size + lateness more than
    the watermark that windows go by.
    """

    OUTPUT = "id string, end_ms long, cnt long, kind string"

    def __init__(self, size_ms: int, lateness_ms: int):
        self.size_ms, self.lateness_ms, self.slack_ms = size_ms, lateness_ms, size_ms + lateness_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.windows = handle.getMapState("windows", "end_ms long", "cnt long, fired boolean")

    def _due(self, key, mark: int) -> Iterator[Row]:
        for (end,), (n, fired) in list(self.windows.iterator()):
            if mark >= end - 1 and not fired:
                yield Row(id=key[0], end_ms=end, cnt=n, kind="first")
                self.windows.updateValue((end,), (n, True))
            if mark >= end - 1 + self.lateness_ms:
                self.windows.removeKey((end,))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        spark_mark = timerValues.getCurrentWatermarkInMs()
        mark = spark_mark + self.slack_ms if spark_mark > 0 else spark_mark
        yield from self._due(key, mark)
        for row in arrival(rows):
            end = (row["ts_ms"] // self.size_ms + 1) * self.size_ms
            if mark >= end - 1 + self.lateness_ms:
                continue
            n, fired = self.windows.getValue((end,)) if self.windows.containsKey((end,)) else (0, False)
            late = mark >= end - 1
            if late:
                yield Row(id=key[0], end_ms=end, cnt=n + 1, kind="update" if fired else "first")
            else:
                self.handle.registerTimer(end - self.slack_ms)
            self.handle.registerTimer(end + self.lateness_ms - self.slack_ms)
            self.windows.updateValue((end,), (n + 1, fired or late))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        yield from self._due(key, expiredTimerInfo.getExpiryTimeInMs() + self.slack_ms)

    def close(self) -> None:
        pass
