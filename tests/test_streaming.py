"""Streams against tables, goldens of stateful operators, sources, sinks and restarts."""

import os
import socket
import subprocess
import sys
import threading
import time
import uuid
from pathlib import Path

import pyspark
import pytest
from pyspark.sql import functions as F
from test_goldens import ARRIVALS, table

import __spark_entry__ as entry
from tidemill.functions.expressions import iso_time, millis
from tidemill.model import readings
from tidemill.operators import control, late, rolling, windows
from tidemill.sources import generators, jdbc
from tidemill.streaming import jobs, live, processors, sinks


def drain(df, folder, mode="append", **options):
    name = f"t{uuid.uuid4().hex}"
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", f"{folder}/{name}").options(**options).trigger(availableNow=True).start()
    q.awaitTermination()
    return df.sparkSession.table(name)


def stateful(df, key, processor, time_mode="None"):
    return df.groupBy(key).transformWithState(processor, processor.OUTPUT, "append", time_mode)


def stream(spark, df, tmp_path, files=3):
    return jobs.replay(spark, df, f"{tmp_path}/{uuid.uuid4().hex}", "event_id", files)


def same(a, b):
    columns = sorted(a.columns)
    return sorted(map(tuple, a.select(columns).collect())) == sorted(map(tuple, b.select(columns).collect()))


@pytest.fixture
def some(spark, sf_dir):
    return readings(spark, sf_dir).filter("event_id < 120").withColumn("ts_ms", millis(F.col("ts")))


def test_window_stream_equals_table(spark, some, tmp_path):
    running = windows.average(stream(spark, some, tmp_path).withWatermark("ts", "5 hours"), "1 hour")
    assert same(drain(running, tmp_path, "complete"), windows.average(some, "1 hour"))


def test_change_alert_stream_equals_table(spark, some, tmp_path):
    running = stateful(stream(spark, some, tmp_path), "id", processors.ChangeAlert(1.7))
    assert same(drain(running, tmp_path), rolling.change_alerts(some, 1.7))


def test_rolling_streams_equal_tables(spark, some, tmp_path):
    running = stateful(stream(spark, some, tmp_path), "id", processors.RollingMax())
    assert same(drain(running, tmp_path), rolling.rolling_max(some))
    cents = some.withColumn("value", F.floor(F.col("temperature") * 100).cast("long"))
    running = stateful(stream(spark, cents, tmp_path), "user_id", processors.RollingSum())
    assert same(drain(running, tmp_path), rolling.rolling_sum(cents, "user_id", "value", "event_type", "event_id"))


def test_counters_stream_equals_table(spark, some, tmp_path):
    bucketed = some.withColumn("bucket", rolling.bucket("user_id", 4))
    running = stateful(stream(spark, bucketed, tmp_path), "bucket", processors.HighCount(120.0))
    assert same(drain(running, tmp_path), rolling.high_counts_per_bucket(some))
    running = stateful(stream(spark, bucketed, tmp_path), "bucket", processors.HighCounts(10.0))
    assert same(drain(running, tmp_path), rolling.high_counts(some))


def test_two_input_streams_equal_tables(spark, some, tmp_path):
    is_switch = F.col("event_type") == "signup"
    both = processors.tagged(some.filter(~is_switch), some.filter(is_switch).withColumn("duration_ms", F.lit(36_000_000).cast("long")))
    running = stateful(stream(spark, both, tmp_path), "id", processors.SwitchFilter())
    assert same(drain(running, tmp_path), control.switched(some, is_switch, 36_000_000).select("event_id", "id", "temperature"))

    level = F.when(F.col("event_type") == "error", "High").when(is_switch, "Low")
    marked = some.withColumn("level", level)
    data = marked.filter("level is null").withColumn("bucket", rolling.bucket("user_id", 2))
    both = processors.tagged(data, processors.replicated(marked.filter("level is not null"), 2))
    running = stateful(stream(spark, both, tmp_path), "bucket", processors.FireAlert())
    assert same(drain(running, tmp_path), control.fire_alerts(some, level))


def test_threshold_stream(spark, tmp_path):
    data = table(spark, [("s_1", 1, 50), ("s_1", 2, 50.5), ("s_1", 3, 52), ("s_3", 4, 9)]).withColumn("event_id", F.col("event_id") + 10)
    updates = spark.createDataFrame([(0, "s_1", 1.2), (1, "s_3", 0.5), (2, "s_3", 0.0)], "event_id long, id string, threshold double")
    running = stateful(stream(spark, processors.tagged(data, updates), tmp_path), "id", processors.ThresholdAlert())
    assert sorted((r["id"], r["diff"]) for r in drain(running, tmp_path).collect()) == [("s_1", 1.5), ("s_1", 50.0)]


BASE = 1000  # seconds; Spark's watermark starts at the epoch, and what lies there would be late


def one_by_one(spark, rows, tmp_path, delay):
    """A batch for each row, so the watermark moves after each; a last row far ahead lets timers expire."""
    df = table(spark, [(r[0], r[1] + BASE, *r[2:]) for r in rows]).withColumn("ts_ms", millis(F.col("ts")))
    return stream(spark, df, tmp_path, files=len(rows)).withWatermark("ts", delay)


def test_self_cleaning_stream(spark, tmp_path):
    running = one_by_one(spark, [("a", 0, 70), ("a", 10, 71), ("b", 3700, 1), ("a", 3701, 71)], tmp_path, "5 seconds")
    got = drain(stateful(running, "id", processors.SelfCleaningAlert(1.5, 3_600_000), "EventTime"), tmp_path)
    assert sorted((r["id"], r["temperature"], r["diff"]) for r in got.collect()) == [("a", 70.0, 70.0), ("a", 71.0, 71.0)]


def test_increase_stream(spark, tmp_path):
    running = one_by_one(spark, [("s", 0, 10), ("s", 0.1, 11), ("s", 0.6, 12), ("s", 1.2, 13), ("s", 1.3, 12), ("z", 9, 1)], tmp_path, "0 seconds")
    got = drain(stateful(running, "id", processors.IncreaseAlert(1000), "EventTime"), tmp_path)
    assert [(r["id"], r["fired_ms"] - 1000 * BASE) for r in got.collect()] == [("s", 1100)]


def test_updating_window_stream(spark, tmp_path):
    running = one_by_one(spark, [*ARRIVALS, ("z", 100, 0), ("z", 200, 0)], tmp_path, "20 seconds")
    got = drain(stateful(running, "id", processors.UpdatingCount(10_000, 5000), "EventTime"), tmp_path)
    found = sorted((r["end_ms"] - 1000 * BASE, r["cnt"], r["kind"]) for r in got.collect() if r["id"] == "s")
    assert found == [(10000, 2, "first"), (10000, 3, "update"), (20000, 3, "first"), (40000, 1, "first")]


def test_early_window_stream(spark, tmp_path):
    running = one_by_one(spark, [("s", 1, 0), ("s", 2, 0), ("s", 3, 0), ("z", 20, 0), ("z", 40, 0)], tmp_path, "0 seconds")
    got = drain(stateful(running, "id", processors.EarlyCount(10_000, 1000), "EventTime"), tmp_path)
    found = sorted((r["end_ms"] - 1000 * BASE, r["eval_ms"] - 1000 * BASE, r["cnt"]) for r in got.collect() if r["id"] == "s")
    assert (10000, 10000, 3) in found and len([x for x in found if x[1] == 10000]) == 1


def test_sources_replay_alike(spark, tmp_path):
    generators.register(spark)
    options = dict(maxticks=6, ticksperbatch=3, subtasks=2, seed="7")
    once = drain(spark.readStream.format("replayable_sensors").options(**options).load(), tmp_path)
    again = drain(spark.readStream.format("replayable_sensors").options(**options).load(), tmp_path)
    assert same(once, again)
    assert {r["id"] for r in once.select("id").distinct().collect()} == {f"sensor_{k}" for k in range(20)}


def test_counter_and_smoke_streams(spark, tmp_path):
    generators.register(spark)

    def first(source, **options):
        name = f"t{uuid.uuid4().hex}"
        q = spark.readStream.format(source).options(**options).load().writeStream.format("memory").queryName(name).option("checkpointLocation", f"{tmp_path}/{name}").start()
        deadline = time.time() + 60
        while spark.table(name).count() < 20 and time.time() < deadline:
            time.sleep(0.2)
        q.stop()
        return [r[0] for r in spark.table(name).collect()]

    assert sorted(first("replayable_counter", most=30, perbatch=10, subtasks=2))[:20] == list(range(20))
    assert set(first("smoke_levels", perbatch=20)) <= {"High", "Low"}


def test_generator_is_a_function_of_its_offsets():
    reader = generators.SensorReader({"ticksperbatch": "4"})
    start = reader.initialOffset()
    middle, end = reader._ahead(start), reader._ahead(reader._ahead(start))
    rows = lambda a, b: [r for p in reader.partitions(a, b) for r in reader.read(p)]
    assert rows(start, end) == rows(start, middle) + rows(middle, end)


def test_sensors_are_dealt_over_subtasks_and_dealt_again_on_restart():
    one, three = (generators.SensorReader({"ticksperbatch": "4", "subtasks": str(n)}) for n in (1, 3))
    start = three.initialOffset()
    middle, end = three._ahead(start), three._ahead(three._ahead(start))
    rows = lambda reader, a, b: sorted(r for p in reader.partitions(a, b) for r in reader.read(p))
    assert [len(p.numbers) for p in three.partitions(start, end)] == [10, 10, 10]
    whole = rows(three, start, end)
    assert len(whole) == 30 * 8 and rows(one, start, end) == whole  # the rows don't depend on how they are dealt
    assert sorted(rows(three, start, middle) + rows(one, middle, end)) == whole


def test_a_commit_that_fails_half_way_repeats_no_line(spark, some):
    whole = jobs.averages_through_transactions(spark, some, fail_in=None)
    assert same(jobs.averages_through_transactions(spark, some, fail_in=1), whole)


def test_replay_keeps_rows_of_null_order_and_takes_files_in_order(spark, tmp_path):
    df = spark.createDataFrame([(k if k else None, k) for k in range(40)], "o long, v long").repartition(5)
    seen = []
    stream = jobs.replay(spark, df, f"{tmp_path}/in", "o", 4)
    jobs.run_to_end(stream.writeStream.foreachBatch(lambda b, n: seen.append(sorted(r["v"] for r in b.collect()))).option("checkpointLocation", f"{tmp_path}/c"))
    assert len(seen) == 4 and [v for some in seen for v in some] == list(range(40))


@pytest.mark.parametrize("job", [jobs.averages_through_files, jobs.averages_through_write_ahead])
def test_restart_neither_loses_nor_repeats(spark, some, job):
    failed, clean = job(spark, some, files=3, fail_in=1), job(spark, some, files=3, fail_in=None)
    want = some.groupBy(iso_time(F.window("ts", "1 hour").end).alias("window_end")).agg(F.round(F.avg("temperature"), 4).alias("avg_temp"))
    assert same(failed, clean) and same(clean, want)


def test_commit_mark(spark, tmp_path):
    mark = sinks.CommitMark(spark, str(tmp_path), "job")
    assert not mark.committed(0)
    mark.commit(26)
    assert (tmp_path / "job" / "0").read_text() == "0x000000000000001a"
    assert mark.committed(26) and mark.committed(3) and not mark.committed(27)


def test_transactional_files(spark, some, tmp_path):
    spark.dataSource.register(sinks.TransactionalFiles)
    lines = stream(spark, some, tmp_path).select(F.col("event_id").cast("string").alias("value"))
    writer = lines.writeStream.format("transactional_files").option("path", f"{tmp_path}/out").option("temp", f"{tmp_path}/temp").option("checkpointLocation", f"{tmp_path}/check")
    writer.trigger(availableNow=True).start().awaitTermination()
    assert sorted(map(int, sinks.committed_lines(f"{tmp_path}/out"))) == list(range(120))
    assert not [x for x in (tmp_path / "temp").iterdir()]


def test_socket_sink(spark, tmp_path):
    server, got = socket.create_server(("127.0.0.1", 0)), []

    def serve():
        server.settimeout(60)
        while len(got) < 5:
            conn, _ = server.accept()
            with conn, conn.makefile() as f:
                got.extend(f.read().splitlines())

    thread = threading.Thread(target=serve, daemon=True)
    thread.start()
    df = stream(spark, spark.range(5).withColumnRenamed("id", "event_id"), tmp_path, files=1)
    df.coalesce(1).writeStream.foreach(sinks.SocketSink("127.0.0.1", server.getsockname()[1])).option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start().awaitTermination()
    thread.join(30)
    assert len(got) == 5


def test_upsert_sink(spark, tmp_path):
    url = jdbc.memory_url(f"u{uuid.uuid4().hex[:8]}")
    jdbc.execute(spark, url, "CREATE TABLE temperatures (sensor VARCHAR(16) PRIMARY KEY, temp DOUBLE)")
    jdbc.insert(spark, url, "INSERT INTO temperatures (sensor, temp) VALUES (?, ?)", [("z", 5.0)])
    rows = [(0, "a", 1.0), (1, "b", 2.0), (2, "a", 9.0), (3, "c", 3.0)]
    df = spark.createDataFrame(rows, "event_id long, sensor string, temp double")
    write = sinks.upsert_sink(url, "temperatures", "sensor", "temp", "event_id")
    for _ in range(2):  # a replay changes nothing
        write(df, 0)
    got = jdbc.read(spark, url, "temperatures").orderBy("sensor")
    assert jdbc.lines(got) == ["a, 9.0", "b, 2.0", "c, 3.0", "z, 5.0"]


CLUSTER = """
import sys
from pyspark.sql import SparkSession
conf = {"spark.master": "local-cluster[2,1,1024]", "spark.ui.enabled": "false", "spark.sql.session.timeZone": "UTC", "spark.driver.host": "127.0.0.1", "spark.checkpoint.dir": sys.argv[2], "spark.sql.shuffle.partitions": "4"}
spark = SparkSession.builder.config(map=conf).getOrCreate()
import __spark_entry__ as entry
entry.queries()["upsert_sink"](spark, sys.argv[1]).write.parquet(sys.argv[2] + "/got")
spark.stop()
"""


def test_upserts_from_executors_of_their_own_processes(spark, sf_dir, tmp_path):
    """A database in the driver's process can't be opened by executors; each would find an empty one of its own."""
    home = tmp_path / "home"
    (home / "work").mkdir(parents=True)
    for p in Path(pyspark.__file__).parent.iterdir():  # executors' logs go to work in Spark's home
        if p.name != "work":
            (home / p.name).symlink_to(p)
    gone = ("SPARK_ENV_LOADED", "PYSPARK_GATEWAY_PORT", "PYSPARK_GATEWAY_SECRET")
    env = {k: v for k, v in os.environ.items() if k not in gone} | {"SPARK_HOME": str(home), "SPARK_SCALA_VERSION": "2.13", "SPARK_LOCAL_IP": "127.0.0.1", "SPARK_LOCAL_DIRS": f"{tmp_path}/local", "PYSPARK_PYTHON": sys.executable}
    subprocess.run([sys.executable, "-c", CLUSTER, sf_dir, str(tmp_path)], env=env, cwd=tmp_path, check=True, timeout=180, capture_output=True)
    assert same(spark.read.parquet(f"{tmp_path}/got"), entry.queries()["upsert_latest_temp"](spark, sf_dir))


def test_upserts_of_odd_keys_through_the_driver(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(jdbc, "PART_ROWS", 2)
    keys = ['with "quotes"', "with, comma", "line\nbreak", "é ü 日本", " blank "]
    with jdbc.own_database(spark) as url:
        jdbc.execute(spark, url, "CREATE TABLE temperatures (sensor VARCHAR(255) PRIMARY KEY, temp DOUBLE)")
        write = sinks.upsert_sink(url, "temperatures", "sensor", "temp", "event_id")
        for turn in range(2):
            rows = [(k, key, None if turn and k == 1 else 1e-20 / 3 + k + turn) for k, key in enumerate(keys)]
            write(spark.createDataFrame(rows, "event_id long, sensor string, temp double"), turn)
        got = jdbc.read_through(spark, url, "temperatures", f"{tmp_path}/out")
    assert {tuple(r) for r in got.collect()} == {(r[1], r[2]) for r in rows}
    assert not os.path.exists(url.split(":")[2].split(";")[0])


def test_lookup_of_live_results(spark, some, tmp_path):
    running = stream(spark, some, tmp_path).groupBy("id").agg(F.max("temperature").alias("m"))
    name = f"t{uuid.uuid4().hex}"
    running.writeStream.format("memory").queryName(name).outputMode("complete").option("checkpointLocation", f"{tmp_path}/look").trigger(availableNow=True).start().awaitTermination()
    got = sinks.lookup(spark, f"{tmp_path}/look", ["sensor_1"]).collect()
    want = some.filter("id = 'sensor_1'").agg(F.max("temperature")).first()[0]
    assert [r["value"]["max"] if "max" in r["value"] else r["value"][0] for r in got] == [want]


def test_late_split_is_exact_across_batches_and_restarts(spark, tmp_path):
    df = table(spark, [(r[0], r[1] + BASE, *r[2:]) for r in ARRIVALS])
    want = [sorted(r["event_id"] for r in part.collect()) for part in late.split_late(df, 5000)]
    fail, got = jobs.FailOnce(2), ({}, {})

    def keep(into):
        return lambda part, batch_id: into.__setitem__(batch_id, [r["event_id"] for r in part.collect()])

    split = live.LateSplit(f"{tmp_path}/seen", 5000, keep(got[0]), keep(got[1]))

    def batch(part, batch_id):
        split(part, batch_id)
        fail(batch_id)

    assert jobs.run_to_end(stream(spark, df, tmp_path, files=4).writeStream.foreachBatch(batch).option("checkpointLocation", f"{tmp_path}/c")) == 1
    assert [sorted(x for rows in side.values() for x in rows) for side in got] == want


def test_dashboard_and_pollers(spark):
    shown = []
    board = live.dashboard(lambda: {"sensor_1": 1.0, "sensor_3": 2.34567}, ["sensor_1", "sensor_2", "sensor_3"], shown.append, 0.01)
    board.start()
    while not shown:
        time.sleep(0.01)
    board.stop()
    assert shown[0] == "1.000\t| -\t| 2.346"

    url = jdbc.memory_url(f"u{uuid.uuid4().hex[:8]}")
    jdbc.execute(spark, url, "CREATE TABLE locations (sensor VARCHAR(16) PRIMARY KEY, room VARCHAR(16))")
    jdbc.insert(spark, url, "INSERT INTO locations VALUES (?, ?)", [("sensor_1", "room_1")])
    writer = jdbc.updater(spark, url, "UPDATE locations SET room = ? WHERE sensor = ?", lambda rng: (f"room_{rng.randint(10, 20)}", "sensor_1"), 0.01)
    writer.start()
    deadline = time.time() + 30
    while jdbc.lines(jdbc.read(spark, url, "locations")) == ["sensor_1, room_1"] and time.time() < deadline:
        time.sleep(0.05)
    writer.stop()
    assert jdbc.lines(jdbc.read(spark, url, "locations"))[0].startswith("sensor_1, room_1") and jdbc.lines(jdbc.read(spark, url, "locations")) != ["sensor_1, room_1"]
