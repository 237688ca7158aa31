"""Small cases worked out by hand."""

from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from tidemill.functions import expressions as X
from tidemill.operators import control, enrich, late, rolling, stateless, windows

R = "event_id long, id string, ts timestamp, temperature double, user_id long, event_type string"


def at(seconds):
    return datetime.fromtimestamp(seconds, timezone.utc)


def table(spark, rows):
    """Rows (id, seconds, temperature[, type]) in order of arrival."""
    return spark.createDataFrame([(k, r[0], at(r[1]), float(r[2]), int(r[0].rpartition("_")[2]) if r[0][-1].isdigit() else 0, r[3] if len(r) > 3 else "view") for k, r in enumerate(rows)], R)


def rows(df, *columns):
    return [tuple(r[c] for c in columns) for r in df.collect()]


def in_order(df, *columns):
    return rows(df.orderBy("event_id"), *columns)


def test_rolling_sum(spark):
    data = [(0, 1, 2, 2), (1, 2, 3, 1), (2, 2, 2, 4), (3, 1, 5, 3)]
    df = spark.createDataFrame(data, "event_id long, key int, value long, third int")
    got = rolling.rolling_sum(df, "key", "value", "third", "event_id")
    assert in_order(got, "key", "running_sum", "third") == [(1, 2, 2), (2, 3, 1), (2, 5, 1), (1, 7, 2)]


def test_rolling_max_takes_the_newer_of_equals(spark):
    got = rolling.rolling_max(table(spark, [("a", 1, 70), ("a", 2, 72), ("a", 3, 71), ("a", 4, 72)]))
    assert in_order(got, "max_ts_ms", "max_temp") == [(1000, 70), (2000, 72), (2000, 72), (4000, 72)]


def test_window_average(spark):
    got = windows.average(stateless.celsius(table(spark, [("sensor_1", 0, 32), ("sensor_1", 0.9, 212)])), "1 second")
    assert rows(got, "id", "end_ms", "avg_temp") == [("sensor_1", 1000, pytest.approx(50.0))]


def test_split_and_freezing(spark):
    df = table(spark, [("sensor_7", 0, 31.9), ("sensor_8", 0, 32)])
    assert rows(stateless.split_ids(df.limit(1)), "part") == [("sensor",), ("7",)]
    main, cold = stateless.monitor_freezing(df)
    assert main.count() == 2
    assert rows(cold, "message") == [("Freezing Alarm for sensor_7",)]


def test_filter_is_inclusive(spark):
    assert rows(stateless.at_least(table(spark, [("a", 0, 25), ("a", 1, 24.9)])), "temperature") == [(25.0,)]


def test_change_alerts(spark):
    df = table(spark, [("a", 1, 70), ("a", 2, 71), ("a", 3, 73), ("a", 4, 73), ("b", 5, 1), ("b", 6, 2)])
    assert in_order(rolling.change_alerts(df), "id", "temperature", "diff") == [("a", 70, 70), ("a", 73, 2)]
    assert in_order(rolling.change_alerts(df, first_counts=False), "id", "temperature", "diff") == [("a", 73, 2)]


def test_self_cleaning_alerts(spark):
    df = table(spark, [("a", 0, 70), ("a", 10, 71), ("b", 3700, 1), ("a", 3701, 71)])
    got = control.self_cleaning_alerts(df, 1.5, 3_600_000, 5000)
    assert in_order(got, "id", "temperature", "diff") == [("a", 70, 70), ("a", 71, 71)]


def test_increase_alerts(spark):
    df = table(spark, [("s", 0, 10), ("s", 0.1, 11), ("s", 0.6, 12), ("s", 1.2, 13), ("s", 1.3, 12)])
    assert rows(control.increase_alerts(df, 1000), "id", "fired_ms") == [("s", 1100)]


def test_increase_alerts_fire_again_and_ignore_zero(spark):
    df = table(spark, [("s", 0, 0), ("s", 1, 5), ("s", 2, 6), ("s", 4, 7), ("s", 6, 7), ("t", 9, 1)])
    assert sorted(rows(control.increase_alerts(df, 1000), "id", "fired_ms")) == [("s", 3000), ("s", 5000)]


def test_switch_is_half_open(spark):
    df = table(spark, [("sensor_2", 0, 0, "on"), ("sensor_2", 5, 1), ("sensor_1", 5, 2), ("sensor_2", 10, 3), ("sensor_2", 11, 4)])
    got = control.switched(df, F.col("event_type") == "on", 10_000)
    assert in_order(got, "id", "temperature") == [("sensor_2", 1.0)]


def test_fire_alert(spark):
    data = [("x", 1, 120), ("c", 2, 0, "High"), ("x", 2, 100), ("x", 3, 101), ("c", 4, 0, "Low"), ("x", 4, 150)]
    level = F.when(F.col("event_type").isin("High", "Low"), F.col("event_type"))
    got = control.fire_alerts(table(spark, data), level)
    assert rows(got, "message", "ts_ms") == [("Risk of fire!", 3000)]


def test_dynamic_thresholds(spark):
    updates = spark.createDataFrame([(0, "sensor_1", 5.0), (1, "sensor_2", 0.9), (2, "sensor_3", 0.5), (3, "sensor_1", 1.2), (4, "sensor_3", 0.0)], "seq long, id string, threshold double")
    df = table(spark, [("sensor_1", 1, 50), ("sensor_1", 2, 50.5), ("sensor_1", 3, 52), ("sensor_2", 4, 10), ("sensor_2", 5, 10.5), ("sensor_3", 6, 9)])
    got = control.threshold_alerts(df, updates)
    assert in_order(got, "id", "temperature", "diff") == [("sensor_1", 50, 50), ("sensor_1", 52, 1.5), ("sensor_2", 10, 10)]


def test_key_and_bucket_counts(spark):
    df = table(spark, [("a_4", 0, 11), ("b_8", 1, 5), ("b_8", 2, 12), ("a_4", 3, 13)])
    assert in_order(rolling.high_counts(df), "id", "key_cnt", "op_cnt") == [("a_4", 1, 1), ("b_8", 1, 2), ("a_4", 2, 3)]


ARRIVALS = [("s", x, 0) for x in (1, 2, 16, 3, 12, 10.5, 30, 14)]


def test_late_filter(spark):
    on_time, tardy = late.split_late(table(spark, ARRIVALS), 5000)
    ms = lambda d: in_order(d.withColumn("ms", F.unix_millis("ts")), "ms")
    assert ms(tardy) == [(3000,), (10500,), (14000,)]
    assert ms(on_time) == [(1000,), (2000,), (16000,), (12000,), (30000,)]


def test_late_windows(spark):
    counts, side = late.late_windows(table(spark, ARRIVALS), 10_000, 5000)
    assert sorted(rows(counts, "end_ms", "cnt")) == [(10000, 2), (20000, 3), (40000, 1)]
    assert in_order(side.withColumn("ms", F.unix_millis("ts")), "ms") == [(3000,), (14000,)]


def test_updating_windows(spark):
    got = late.updating_windows(table(spark, ARRIVALS), 10_000, 5000, 5000)
    assert sorted(rows(got, "end_ms", "cnt", "kind")) == [(10000, 2, "first"), (10000, 3, "update"), (20000, 3, "first"), (40000, 1, "first")]


def test_early_windows(spark):
    got = late.early_windows(table(spark, [("s", 1, 0), ("s", 2, 0), ("s", 9, 0)]), 5000, 1000, every_ms=1000)
    assert sorted(rows(got, "end_ms", "eval_ms", "cnt")) == [(5000, 1000, 2), (5000, 2000, 2), (5000, 3000, 2), (5000, 4000, 2), (5000, 5000, 2), (10000, 2000, 1), (10000, 3000, 1), (10000, 4000, 1), (10000, 5000, 1), (10000, 6000, 1), (10000, 7000, 1), (10000, 8000, 1), (10000, 10000, 1)]


def test_empty_inputs(spark):
    none = table(spark, [("a", 0, 0)]).limit(0)
    assert rolling.change_alerts(none).count() == 0
    assert late.late_windows(none, 10_000, 5000)[0].count() == 0
    assert windows.min_max(none, "5 seconds").count() == 0


def test_enrichment(spark):
    from tidemill.plans.catalog import locations

    df = table(spark, [("sensor_1", 0, 0), ("sensor_80", 1, 0), ("sensor_81", 2, 0)])
    expected = [("sensor_1", "room_1"), ("sensor_80", "room_0"), ("sensor_81", "UNKNOWN ROOM")]
    assert in_order(enrich.with_room(df, locations(spark)), "id", "room") == expected
    found = {"sensor_1": "room_1", "sensor_80": "room_0"}
    assert in_order(enrich.with_room_async(df, lambda k: found.get(k)), "id", "room") == expected


def test_latest_by_key(spark):
    df = table(spark, [("a", 0, 1), ("b", 1, 2), ("a", 2, 9), ("c", 3, 3)])
    assert sorted(rows(enrich.latest_by_key(df, "id", "temperature", "event_id"), "id", "temperature")) == [("a", 9.0), ("b", 2.0), ("c", 3.0)]


def test_expressions(spark):
    one = spark.range(1)
    got = one.select(
        X.checkpoint_mark(F.lit(26)).alias("mark"),
        X.parse_checkpoint_mark(F.lit("0x000000000000001a")).alias("back"),
        X.iso_time(F.timestamp_millis(F.lit(1546300801000))).alias("iso"),
        X.dashboard_line(F.lit(1.0), F.lit(2.34567)).alias("line"),
    ).first()
    assert tuple(got) == ("0x000000000000001a", 26, "2019-01-01T00:00:01", "1.000\t| 2.346")


def test_injected_failure_hits_the_row_after_the_interval(spark):
    df = spark.range(20).withColumnRenamed("id", "n")
    assert stateless.fail_on(df.filter("n < 16"), 17, "n").count() == 16
    with pytest.raises(Exception, match="injected failure at row 17"):
        stateless.fail_on(df, 17, "n").collect()


def test_punctuated_and_periodic_watermarks(spark):
    df = table(spark, [("sensor_1", 100, 0), ("sensor_2", 200, 0), ("sensor_1", 150, 0)])
    assert in_order(late.punctuated_watermark(df, 60_000), "wm_ms") == [(40_000,), (90_000,)]
    assert in_order(late.periodic_watermark(df, 60_000), "wm_ms") == [(40_000,), (140_000,), (140_000,)]
