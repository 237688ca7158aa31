"""Queries of the engine by name, with the SQL each is checked against.

A second of the sensor programs is an hour here.  Doubles that are computed
are rounded to four decimals on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.expressions import millis
from ..model import HOUR_MS, THRESHOLD_UPDATE, readings
from ..operators import control, enrich, late, rolling, stateless, windows
from ..sources import generators, jdbc
from ..streaming import jobs

H = HOUR_MS
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: The sensor view in DuckDB; ``W`` windows end at (floor(ms / W) + 1) * W.
VIEW = """WITH r AS (SELECT event_id, user_id, 'sensor_' || user_id AS id, ts, epoch_us(ts) // 1000 AS ms, value AS temperature, event_type FROM events)"""
SHUFFLED = """, s AS (SELECT event_id, id, ms + ((event_id * 7919) % 25200) * 1000 AS ms FROM r),
w AS (SELECT *, max(ms) OVER (ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - 18000000 AS wm FROM s),
e AS (SELECT *, (ms // 36000000 + 1) * 36000000 AS end_ms FROM w)"""
DELAY, LATENESS, MOST_SHIFT = 5 * H, 5 * H, 7 * H


def _end(hours: int) -> str:
    return f"(ms // {hours * H} + 1) * {hours * H}"


def query(name: str, sql: str | None = None, view: str = VIEW):
    def register(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = f"{view} {sql}"
        return f

    return register


def r4(c: Column | str) -> Column:
    return F.round(c, 4)


# Flagship and stateless operators


@query("avg_temp_celsius_per_window", f"SELECT id, {_end(1)} AS end_ms, round(avg((temperature - 32) * (5.0 / 9.0)), 4) AS avg_temp FROM r GROUP BY ALL")
def avg_temp_celsius_per_window(spark, sf_dir):
    return windows.average(stateless.celsius(readings(spark, sf_dir)), "1 hour").withColumn("avg_temp", r4("avg_temp"))


@query("to_celsius", "SELECT event_id, id, ms AS ts_ms, round((temperature - 32) * (5.0 / 9.0), 4) AS celsius FROM r")
def to_celsius(spark, sf_dir):
    c = stateless.celsius(readings(spark, sf_dir))
    return c.select("event_id", "id", millis(F.col("ts")).alias("ts_ms"), r4("temperature").alias("celsius"))


@query("filter_min_temp", "SELECT event_id, id, ms AS ts_ms, temperature FROM r WHERE temperature >= 25")
def filter_min_temp(spark, sf_dir):
    return stateless.at_least(readings(spark, sf_dir)).select("event_id", "id", millis(F.col("ts")).alias("ts_ms"), "temperature")


@query("project_sensor_id", "SELECT id FROM r WHERE temperature >= 25")
def project_sensor_id(spark, sf_dir):
    return stateless.sensor_ids(stateless.at_least(readings(spark, sf_dir)))


@query("split_sensor_id", "SELECT event_id, unnest(string_split(id, '_')) AS part FROM r")
def split_sensor_id(spark, sf_dir):
    return stateless.split_ids(readings(spark, sf_dir), ("event_id",))


@query("freezing_alarms", "SELECT event_id, 'Freezing Alarm for ' || id AS message FROM r WHERE temperature < 32")
def freezing_alarms(spark, sf_dir):
    return stateless.monitor_freezing(readings(spark, sf_dir), ("event_id",))[1]


@query("monitored_readings", "SELECT event_id, id, ms AS ts_ms, temperature FROM r")
def monitored_readings(spark, sf_dir):
    main, _ = stateless.monitor_freezing(readings(spark, sf_dir))
    return main.select("event_id", "id", millis(F.col("ts")).alias("ts_ms"), "temperature")


# Rolling operators


@query(
    "rolling_sum",
    """SELECT event_id, user_id, CAST(sum(CAST(floor(temperature * 100) AS BIGINT)) OVER w AS BIGINT) AS running_sum, first_value(event_type) OVER w AS event_type
FROM r WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING)""",
)
def rolling_sum(spark, sf_dir):
    r = readings(spark, sf_dir).withColumn("cents", F.floor(F.col("temperature") * 100).cast("long"))
    return rolling.rolling_sum(r, "user_id", "cents", "event_type", "event_id")


@query(
    "rolling_max_reading",
    """, b AS (SELECT event_id, id, max({'t': temperature, 'e': event_id, 'ms': ms}) OVER (PARTITION BY id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS m FROM r)
SELECT event_id, id, m.t AS max_temp, m.ms AS max_ts_ms FROM b""",
)
def rolling_max_reading(spark, sf_dir):
    return rolling.rolling_max(readings(spark, sf_dir))


# Windows


@query("window_min_temp", f"SELECT id, {_end(15)} AS end_ms, min(temperature) AS min_temp FROM r GROUP BY ALL")
def window_min_temp(spark, sf_dir):
    return windows.minimum(readings(spark, sf_dir), "15 hours")


@query("window_min_temp_udf", f"SELECT id, {_end(15)} AS end_ms, min(temperature) AS min_temp FROM r GROUP BY ALL")
def window_min_temp_udf(spark, sf_dir):
    return windows.reduced(readings(spark, sf_dir), "15 hours", min, "min_temp")


class MeanFold:
    """An average as (sum, count)."""

    def create(self) -> tuple[float, int]:
        return 0.0, 0

    def add(self, acc: tuple[float, int], value: float) -> tuple[float, int]:
        return acc[0] + value, acc[1] + 1

    def merge(self, a: tuple[float, int], b: tuple[float, int]) -> tuple[float, int]:
        return a[0] + b[0], a[1] + b[1]

    def result(self, acc: tuple[float, int]) -> float | None:
        return acc[0] / acc[1] if acc[1] else None


@query("window_avg_temp_by_fold", f"SELECT id, {_end(15)} AS end_ms, round(avg(temperature), 4) AS avg_temp FROM r GROUP BY ALL")
def window_avg_temp_by_fold(spark, sf_dir):
    return windows.folded(readings(spark, sf_dir), "15 hours", MeanFold(), "double", "avg_temp").withColumn("avg_temp", r4("avg_temp"))


def _spread(key: tuple, start: int, end: int, rows: dict[str, list]) -> list[tuple]:
    """A window function that needs all values at once: the median of a window, its length and its end."""
    known = sorted((t for t in rows["temperature"] if t is not None), key=lambda t: (t != t, t))  # NaN last, as in SQL
    middle = len(known) // 2
    return [(*key, end, (end - start) // 1000, len(rows["temperature"]), (known[middle] + known[~middle]) / 2 if known else None)]


@query("window_process_function", f"SELECT id, {_end(5)} AS end_ms, CAST({5 * H} // 1000 AS BIGINT) AS seconds, count(*) AS cnt, round(median(temperature), 4) AS median_temp FROM r GROUP BY ALL")
def window_process_function(spark, sf_dir):
    told = windows.processed(readings(spark, sf_dir), "5 hours", _spread, "id string, end_ms long, seconds long, cnt long, median_temp double")
    return told.withColumn("median_temp", r4("median_temp"))


@query("window_avg_temp", f"SELECT id, {_end(15)} AS end_ms, round(avg(temperature), 4) AS avg_temp FROM r GROUP BY ALL")
def window_avg_temp(spark, sf_dir):
    return windows.average(readings(spark, sf_dir), "15 hours").withColumn("avg_temp", r4("avg_temp"))


MIN_MAX = f"SELECT id, {_end(5)} AS end_ms, min(temperature) AS min_temp, max(temperature) AS max_temp FROM r GROUP BY ALL"


@query("window_min_max_temp", MIN_MAX)
def window_min_max_temp(spark, sf_dir):
    return windows.min_max(readings(spark, sf_dir), "5 hours")


@query("window_min_max_temp_incremental", MIN_MAX)
def window_min_max_temp_incremental(spark, sf_dir):
    """The fold of pairs (min, max), then the window's end attached: Catalyst's partial aggregation."""
    aggregates = [F.min("temperature").alias("min_temp"), F.max("temperature").alias("max_temp")]
    folded = windows.tumbling(readings(spark, sf_dir), "5 hours", aggregates)
    return folded.select("id", millis(F.col("window.end")).alias("end_ms"), "min_temp", "max_temp")


@query(
    "window_max_temp_latest",
    f""", m AS (SELECT id, {_end(10)} AS end_ms, max(temperature) AS max_temp FROM r GROUP BY ALL)
SELECT id, max(end_ms) AS end_ms, arg_max(max_temp, end_ms) AS max_temp FROM m GROUP BY id""",
)
def window_max_temp_latest(spark, sf_dir):
    return windows.latest_window(windows.maximum(readings(spark, sf_dir), "10 hours"), "max_temp")


GLOBAL_AVERAGE = f"SELECT strftime(make_timestamp(({_end(1)}) * 1000), '%Y-%m-%dT%H:%M:%S') AS window_end, round(avg(temperature), 4) AS avg_temp FROM r GROUP BY ALL"


@query("global_window_avg", GLOBAL_AVERAGE)
def global_window_avg(spark, sf_dir):
    return windows.global_average(readings(spark, sf_dir), "1 hour").withColumn("avg_temp", r4("avg_temp"))


@query("custom_window_count", f"SELECT id, {_end(30)} AS end_ms, count(*) AS cnt FROM r GROUP BY ALL")
def custom_window_count(spark, sf_dir):
    counted = windows.assigned(readings(spark, sf_dir), windows.aligned(30 * H, F.col("ts")), [F.count(F.lit(1)).alias("cnt")])
    return counted.select("id", millis(F.col("window.end")).alias("end_ms"), "cnt")


@query(
    "early_window_counts",
    f""", w AS (SELECT event_id, id, ms, max(ms) OVER (ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - {DELAY} AS wm FROM r),
a AS (SELECT id, {_end(30)} AS end_ms, (coalesce(wm, ms - {DELAY}) // {H} + 1) * {H} AS fire FROM w),
f AS (SELECT id, end_ms, unnest(generate_series(min(fire), end_ms, {H})) AS eval_ms FROM a GROUP BY id, end_ms)
SELECT f.id, f.end_ms, f.eval_ms, count(*) AS cnt FROM f JOIN a ON f.id = a.id AND f.end_ms = a.end_ms AND a.fire <= f.eval_ms
WHERE f.eval_ms <= (SELECT max(ms) - {DELAY} FROM r) OR f.eval_ms = f.end_ms GROUP BY ALL""",
)
def early_window_counts(spark, sf_dir):
    return late.early_windows(readings(spark, sf_dir), 30 * H, DELAY)


# Late data and watermarks


def _shuffled(spark, sf_dir):
    return stateless.shuffle_timestamps(readings(spark, sf_dir), MOST_SHIFT)


@query("late_filter_ontime", f"{SHUFFLED} SELECT event_id, id, ms AS ts_ms FROM w WHERE wm IS NULL OR ms >= wm")
def late_filter_ontime(spark, sf_dir):
    return late.split_late(_shuffled(spark, sf_dir), DELAY)[0].select("event_id", "id", millis(F.col("ts")).alias("ts_ms"))


@query("late_filter_late", f"{SHUFFLED} SELECT event_id, ms AS ts_ms, '*** late reading *** ' || id AS message FROM w WHERE ms < wm")
def late_filter_late(spark, sf_dir):
    return late.split_late(_shuffled(spark, sf_dir), DELAY)[1].select("event_id", millis(F.col("ts")).alias("ts_ms"), "message")


@query("late_window_counts", f"{SHUFFLED} SELECT id, end_ms, count(*) AS cnt FROM e WHERE wm IS NULL OR end_ms - 1 > wm GROUP BY ALL")
def late_window_counts(spark, sf_dir):
    return late.late_windows(_shuffled(spark, sf_dir), 10 * H, DELAY)[0]


@query("late_window_side_output", f"{SHUFFLED} SELECT event_id, id, ms AS ts_ms, '*** late reading *** ' || id AS message FROM e WHERE end_ms - 1 <= wm")
def late_window_side_output(spark, sf_dir):
    return late.late_windows(_shuffled(spark, sf_dir), 10 * H, DELAY)[1].select("event_id", "id", millis(F.col("ts")).alias("ts_ms"), "message")


@query(
    "updating_window_counts",
    f"""{SHUFFLED}, k AS (SELECT *, (wm IS NULL OR wm < end_ms - 1) AS open FROM e WHERE wm IS NULL OR wm < end_ms - 1 + {LATENESS}),
n AS (SELECT *, count(*) OVER (PARTITION BY id, end_ms ORDER BY event_id) AS cnt, count(*) FILTER (WHERE open) OVER (PARTITION BY id, end_ms) AS base,
             row_number() OVER (PARTITION BY id, end_ms, open ORDER BY event_id) AS nth FROM k)
SELECT id, end_ms, max(base) AS cnt, 'first' AS kind FROM n WHERE open GROUP BY id, end_ms
UNION ALL SELECT id, end_ms, base + nth AS cnt, CASE WHEN base = 0 AND nth = 1 THEN 'first' ELSE 'update' END AS kind FROM n WHERE NOT open""",
)
def updating_window_counts(spark, sf_dir):
    return late.updating_windows(_shuffled(spark, sf_dir), 10 * H, DELAY, LATENESS)


@query("watermark_periodic", f"{SHUFFLED} SELECT event_id, max(ms) OVER (ORDER BY event_id ROWS UNBOUNDED PRECEDING) - {60 * H} AS wm_ms FROM s")
def watermark_periodic(spark, sf_dir):
    return late.periodic_watermark(_shuffled(spark, sf_dir), 60 * H)


@query("watermark_punctuated", f"SELECT event_id, ms - {60 * H} AS wm_ms FROM r WHERE id = 'sensor_1'")
def watermark_punctuated(spark, sf_dir):
    return late.punctuated_watermark(readings(spark, sf_dir), 60 * H)


# Keyed state, timers, two inputs

LAGGED = ", l AS (SELECT *, lag(temperature) OVER (PARTITION BY id ORDER BY event_id) AS last FROM r)"


def _rounded(alerts: DataFrame) -> DataFrame:
    return alerts.withColumn("diff", r4("diff"))


@query("temp_change_alerts", f"{LAGGED} SELECT event_id, id, temperature, round(abs(temperature - coalesce(last, 0.0)), 4) AS diff FROM l WHERE abs(temperature - coalesce(last, 0.0)) > 1.7")
def temp_change_alerts(spark, sf_dir):
    return _rounded(rolling.change_alerts(readings(spark, sf_dir), 1.7))


@query("temp_change_alerts_with_option_state", f"{LAGGED} SELECT event_id, id, temperature, round(abs(temperature - last), 4) AS diff FROM l WHERE abs(temperature - last) > 1.7")
def temp_change_alerts_with_option_state(spark, sf_dir):
    return _rounded(rolling.change_alerts(readings(spark, sf_dir), 1.7, first_counts=False))


@query(
    "self_cleaning_alerts",
    f""", l AS (SELECT *, lag(temperature) OVER k AS last, lag(ms) OVER k AS last_ms, lag(ms) OVER (ORDER BY event_id) - {DELAY} AS wm FROM r WINDOW k AS (PARTITION BY id ORDER BY event_id)),
c AS (SELECT *, abs(temperature - CASE WHEN last IS NULL OR wm >= last_ms + {24 * H} THEN 0.0 ELSE last END) AS diff FROM l)
SELECT event_id, id, temperature, round(diff, 4) AS diff FROM c WHERE diff > 1.5""",
)
def self_cleaning_alerts(spark, sf_dir):
    return _rounded(control.self_cleaning_alerts(readings(spark, sf_dir), 1.5, 24 * H, DELAY))


ORACLES["temp_increase_alerts"] = f"""WITH RECURSIVE r AS (SELECT event_id, 'sensor_' || user_id AS id, epoch_us(ts) // 1000 AS ms, value AS temperature FROM events),
l AS (SELECT *, lag(temperature) OVER (PARTITION BY id ORDER BY event_id) AS last FROM r),
u AS (SELECT id, event_id, ms, last <> 0 AND temperature > last AS up, sum(CASE WHEN last <> 0 AND temperature < last THEN 1 ELSE 0 END) OVER (PARTITION BY id ORDER BY event_id) AS run FROM l),
g AS (SELECT id, run, coalesce(lead(min(ms)) OVER (PARTITION BY id ORDER BY run), (SELECT max(ms) FROM r)) AS until FROM u GROUP BY id, run),
t AS (SELECT id, run, min(ms) + {24 * H} AS fired FROM u WHERE up GROUP BY id, run
      UNION ALL
      SELECT t.id, t.run, (SELECT min(ms) FROM u WHERE u.id = t.id AND u.run = t.run AND u.up AND u.ms >= t.fired) + {24 * H} FROM t WHERE t.fired IS NOT NULL)
SELECT t.id, fired AS fired_ms, 'Temperature of sensor ''' || t.id || ''' monotonically increased for 1 second.' AS message
FROM t JOIN g ON t.id = g.id AND t.run = g.run WHERE fired <= until"""


@query("temp_increase_alerts")
def temp_increase_alerts(spark, sf_dir):
    return control.increase_alerts(readings(spark, sf_dir), 24 * H)


@query(
    "switch_filtered_readings",
    f"""SELECT event_id, id, ms AS ts_ms, temperature FROM r WHERE event_type <> 'signup' AND EXISTS (
  SELECT 1 FROM r c WHERE c.event_type = 'signup' AND c.id = r.id AND c.ms <= r.ms AND r.ms < c.ms + {10 * H})""",
)
def switch_filtered_readings(spark, sf_dir):
    passed = control.switched(readings(spark, sf_dir), F.col("event_type") == "signup", 10 * H)
    return passed.select("event_id", "id", millis(F.col("ts")).alias("ts_ms"), "temperature")


@query(
    "fire_alerts",
    """, v AS (SELECT *, CASE event_type WHEN 'error' THEN 'High' WHEN 'signup' THEN 'Low' END AS level FROM r),
l AS (SELECT *, last_value(level IGNORE NULLS) OVER (ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS latest FROM v)
SELECT event_id, 'Risk of fire!' AS message, ms AS ts_ms FROM l WHERE level IS NULL AND latest = 'High' AND temperature > 100""",
)
def fire_alerts(spark, sf_dir):
    level = F.when(F.col("event_type") == "error", "High").when(F.col("event_type") == "signup", "Low")
    return control.fire_alerts(readings(spark, sf_dir), level)


#: The literal control stream: thresholds in order, 0.0 removes one.  Fixed values.
THRESHOLDS = [("sensor_1", 5.0), ("sensor_2", 0.9), ("sensor_3", 0.5), ("sensor_1", 1.2), ("sensor_3", 0.0)]


@query(
    "dynamic_threshold_alerts",
    """, l AS (SELECT *, lag(temperature) OVER (PARTITION BY id ORDER BY event_id) AS last FROM r), t(id, threshold) AS (VALUES ('sensor_1', 1.2), ('sensor_2', 0.9))
SELECT event_id, l.id, temperature, round(abs(temperature - coalesce(last, 0.0)), 4) AS diff FROM l JOIN t ON l.id = t.id WHERE abs(temperature - coalesce(last, 0.0)) > threshold""",
)
def dynamic_threshold_alerts(spark, sf_dir):
    updates = generators.from_elements(spark, THRESHOLDS, THRESHOLD_UPDATE).withColumn("seq", F.monotonically_increasing_id())
    return _rounded(control.threshold_alerts(readings(spark, sf_dir), updates))


@query("high_temp_count_per_bucket", "SELECT event_id, CAST(user_id % 4 AS INT) AS bucket, row_number() OVER (PARTITION BY user_id % 4 ORDER BY event_id) AS cnt FROM r WHERE temperature > 120")
def high_temp_count_per_bucket(spark, sf_dir):
    return rolling.high_counts_per_bucket(readings(spark, sf_dir))


@query(
    "high_temp_counts",
    """SELECT event_id, id, row_number() OVER (PARTITION BY id ORDER BY event_id) AS key_cnt, row_number() OVER (PARTITION BY user_id % 4 ORDER BY event_id) AS op_cnt
FROM r WHERE temperature > 10""",
)
def high_temp_counts(spark, sf_dir):
    return rolling.high_counts(readings(spark, sf_dir))


# Enrichment, sources and sinks


def locations(spark: SparkSession) -> DataFrame:
    """Rooms of sensors 1 to 80."""
    return spark.range(1, 81).select(F.concat(F.lit("sensor_"), F.col("id")).alias("sensor"), F.concat(F.lit("room_"), F.col("id") % 10).alias("room"))


ENRICHED = """, d AS (SELECT 'sensor_' || i AS id, 'room_' || (i % 10) AS room FROM range(1, 81) t(i))
SELECT event_id, r.id, temperature, coalesce(room, 'UNKNOWN ROOM') AS room FROM r LEFT JOIN d ON r.id = d.id"""


@query("sensor_location_enrichment", ENRICHED)
def sensor_location_enrichment(spark, sf_dir):
    return enrich.with_room(readings(spark, sf_dir), locations(spark)).select("event_id", "id", "temperature", "room")


def _room(sensor: str) -> str | None:
    n = int(sensor.rpartition("_")[2])
    return f"room_{n % 10}" if 1 <= n <= 80 else None


@query("sensor_location_lookup_async", ENRICHED)
def sensor_location_lookup_async(spark, sf_dir):
    return enrich.with_room_async(readings(spark, sf_dir).select("event_id", "id", "temperature"), _room)


@query("upsert_latest_temp", "SELECT id, round((arg_max(temperature, event_id) - 32) * (5.0 / 9.0), 4) AS temp FROM r GROUP BY id ORDER BY id")
def upsert_latest_temp(spark, sf_dir):
    latest = enrich.latest_by_key(stateless.celsius(readings(spark, sf_dir)), "id", "temperature", "event_id")
    return latest.select("id", r4("temperature").alias("temp")).orderBy("id")


@query("count_source", "SELECT range AS n FROM range(0, 10000)", view="")
def count_source(spark, sf_dir):
    return generators.count_source(spark, 10_000)


@query("replayable_count_source", "SELECT range AS n FROM range(0, 10000)", view="")
def replayable_count_source(spark, sf_dir):
    generators.register(spark)
    return spark.read.format("replayable_counter").options(most=10_000, subtasks=4).load()


@query("exactly_once_file_sink", GLOBAL_AVERAGE)
def exactly_once_file_sink(spark, sf_dir):
    return jobs.averages_through_files(spark, readings(spark, sf_dir))


@query("write_ahead_sink", GLOBAL_AVERAGE)
def write_ahead_sink(spark, sf_dir):
    return jobs.averages_through_write_ahead(spark, readings(spark, sf_dir))


@query("two_phase_file_sink", GLOBAL_AVERAGE)
def two_phase_file_sink(spark, sf_dir):
    return jobs.averages_through_transactions(spark, readings(spark, sf_dir))


@query("upsert_sink", "SELECT id, round((arg_max(temperature, event_id) - 32) * (5.0 / 9.0), 4) AS temp FROM r GROUP BY id")
def upsert_sink(spark, sf_dir):
    """Over a database in the driver's process; ``jobs`` takes any address."""
    with jdbc.own_database(spark) as url:
        return jobs.latest_through_upserts(spark, stateless.celsius(readings(spark, sf_dir)), url).select("id", r4("temp").alias("temp"))
