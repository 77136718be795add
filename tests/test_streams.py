"""Streams against their batch twins, with late rows, repeats and replays."""

import time
from datetime import datetime, timedelta
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from aqspark.functions import fixed
from aqspark.plans import features, forecast
from aqspark.queries import streams as stream_queries
from aqspark.sources import schemas
from aqspark.sources.readers import stream_readings
from aqspark.storage import new_path
from aqspark.streaming import changes, station_state, streams

START = datetime(2024, 1, 1)


@pytest.fixture
def feed(spark):
    """A landing folder; ``add`` drops one file of (station, minutes, value) into it."""
    class Feed:
        path, out, state = (new_path(spark, n) for n in ("in", "out", "state"))

        def add(self, rows):
            spark.createDataFrame(
                [(int(s[1:]), s, START + timedelta(minutes=m), v) for s, m, v in rows],
                schemas.READINGS).coalesce(1).write.mode("append").parquet(self.path)

        def stream(self):
            return stream_readings(spark, self.path, files_per_trigger=1)

        def drain(self, stream):
            streams.run_available(stream, self.out, self.state)
            return spark.read.schema(stream.schema).parquet(self.out).collect()
    return Feed()


def test_late_rows_within_and_beyond_the_bound(feed):
    feed.add([("s1", 10, 10.0), ("s1", 50, 20.0), ("s1", 170, 5.0)])
    feed.drain(streams.stream_hourly_mean(feed.stream()))
    # one hour late counts; once the first hour is closed, it does not
    feed.add([("s1", 55, 60.0), ("s1", 400, 1.0)])
    feed.drain(streams.stream_hourly_mean(feed.stream()))
    feed.add([("s1", 20, 999.0), ("s1", 800, 1.0)])
    got = feed.drain(streams.stream_hourly_mean(feed.stream()))
    assert sorted((r.timestamp.hour, r.pm25) for r in got) == [(0, 30.0), (2, 5.0), (6, 1.0)]


def test_repeats_over_two_files(feed):
    feed.add([("s1", 10, 10.0), ("s2", 10, 20.0)])
    feed.drain(streams.stream_dedupe(feed.stream()))
    feed.add([("s1", 10, 10.0), ("s1", 30, 11.0)])
    got = feed.drain(streams.stream_dedupe(feed.stream()))
    assert sorted((r.station, r.pm25) for r in got) == [("s1", 10.0), ("s1", 11.0), ("s2", 20.0)]


@pytest.fixture
def sites(spark):
    return spark.createDataFrame([("s1", 28.0, 77.0, "x"), ("s2", 20.0, 77.0, "x")],
                                 "station string, lat double, lon double, city string")


def features_of(spark, feed):
    return changes.latest_rows(spark, feed.out).toPandas().sort_values(["station", "timestamp"])


def assert_same_features(got, twin):
    twin = twin.toPandas().sort_values(["station", "timestamp"])
    assert got.timestamp.tolist() == twin.timestamp.tolist()
    for c in fixed.FEATURES:
        assert got[c].astype(float).tolist() == pytest.approx(twin[c].astype(float).tolist()), c


def test_features_follow_late_readings(spark, feed, sites, hours):
    """The state outlives the stream: each run starts from the checkpoint of the one before."""
    def run():
        streams.stream_features(feed.stream(), feed.out, feed.state, sites).awaitTermination()
    feed.add([("s1", h * 60, float(h)) for h in range(100)] + [("s2", h * 60, 1.0) for h in range(80)])
    run()
    # a second reading of an old hour changes its mean, and a new hour arrives
    feed.add([("s1", 95 * 60 + 5, 200.0), ("s1", 100 * 60, 7.0)])
    run()
    rows = [("s1", h, 147.5 if h == 95 else float(h)) for h in range(100)] + [("s1", 100, 7.0)]
    # a station that a batch does not touch keeps its rows
    rows += [("s2", h, 1.0) for h in range(80)]
    assert_same_features(features_of(spark, feed), features.live_window(hours(rows), sites))


def test_a_batch_that_runs_again_replaces_itself(spark, feed):
    rows = spark.createDataFrame([("s1", 1.0), ("s1", 2.0), ("s2", 3.0)], "station string, pm25 double")
    assert changes.latest_rows(spark, feed.out, rows.schema).count() == 0
    for _ in range(2):
        changes.add_changes(rows, feed.out, 0)
    changes.add_changes(rows.limit(0), feed.out, 1)
    changes.add_changes(rows.filter("pm25 = 2"), feed.out, 2)
    assert sorted(map(tuple, changes.latest_rows(spark, feed.out, rows.schema).collect())) == [("s1", 2.0), ("s2", 3.0)]


def test_compaction_keeps_the_latest_rows(spark, feed):
    def log(rows, batch):
        changes.add_changes(spark.createDataFrame(rows, "station string, pm25 double"), feed.out, batch)

    def shown():
        return sorted(map(tuple, changes.latest_rows(spark, feed.out).collect()))
    log([("s1", 1.0), ("s2", 1.0)], 0)
    log([("s1", 2.0)], 3)
    for _ in range(2):
        changes.compact(spark, feed.out)
        assert shown() == [("s1", 2.0), ("s2", 1.0)]
        assert {r[0] for r in changes.changes(spark, feed.out).select("batch").distinct().collect()} == {7}
    log([("s2", 9.0)], 4)
    assert shown() == [("s1", 2.0), ("s2", 9.0)]


def test_updates_of_open_hours(feed, spark):
    """In update mode an hour shows at once, and again with every reading that is not too late for it."""
    def shown():
        streams.run_updates(streams.stream_hourly_mean(feed.stream()), feed.out, feed.state)
        rows = changes.latest_rows(spark, feed.out, keys=["station", "timestamp"]).collect()
        return sorted((r.timestamp.hour, r.pm25) for r in rows)
    feed.add([("s1", 10, 10.0), ("s1", 170, 5.0)])
    assert shown() == [(0, 10.0), (2, 5.0)]
    feed.add([("s1", 55, 60.0), ("s1", 400, 1.0)])
    assert shown() == [(0, 35.0), (2, 5.0), (6, 1.0)]
    feed.add([("s1", 20, 999.0), ("s1", 399, 3.0)])
    assert shown() == [(0, 35.0), (2, 5.0), (6, 2.0)]


def test_scores_of_touched_stations(spark, feed, sites):
    feed.add([("s1", h * 60, float(h)) for h in range(90)] + [("s2", 0, 3.0)])
    load = forecast.persistence(fixed.FEATURES.index("pm25"))
    streams.stream_score(feed.stream(), feed.out, feed.state, sites, load, {}, (0.0, 1.0)).awaitTermination()
    got = changes.latest_rows(spark, feed.out, "station string, current_pm25 double, "
                              "forecast map<string, struct<pm25: double>>", "json").collect()
    assert [(r.station, r.current_pm25, r.forecast["+3h"].pm25) for r in got] == [("s1", 89.0, 89.0)]


def test_a_fast_clock_does_not_silence_other_stations(spark, feed, sites, hours):
    """One station runs two months ahead; every station keeps its own newest rows."""
    feed.add([("s1", h * 60, float(h)) for h in range(100)])
    feed.add([("s2", (60 * 24 + h) * 60, 1.0) for h in range(80)] + [("s1", 100 * 60, 7.0)])
    feed.add([("s1", 101 * 60, 8.0)])
    streams.stream_features(feed.stream(), feed.out, feed.state, sites).awaitTermination()
    rows = [("s1", h, float(h)) for h in range(100)] + [("s1", 100, 7.0), ("s1", 101, 8.0)]
    rows += [("s2", 60 * 24 + h, 1.0) for h in range(80)]
    assert_same_features(features_of(spark, feed), features.live_window(hours(rows), sites))


def test_impossible_hours_do_not_push_valid_ones_out(spark, feed, sites, hours):
    """A sensor fails for 100 hours (s1) or for one (s2); windows and lags reach back over these hours."""
    rows = [("s1", h, -999.0 if 200 <= h < 300 else float(h)) for h in range(320)]
    rows += [("s2", h, 5000.0 if h == 100 else float(h + 1)) for h in range(150)]
    for first, end in ((0, 200), (200, 300), (300, 320)):
        feed.add([(s, h * 60, v) for s, h, v in rows if first <= h < end])
    streams.stream_features(feed.stream(), feed.out, feed.state, sites).awaitTermination()
    assert_same_features(features_of(spark, feed), features.live_window(streams.valid_range(hours(rows)), sites))
    kept = station_state.stored_hours(spark, feed.state).groupBy("station").count().collect()
    assert {r["station"]: r["count"] for r in kept} == {"s1": 244, "s2": 145}
    means = station_state.stored_means(spark, feed.state).groupBy("station").count().collect()
    assert {r["station"]: r["count"] for r in means} == {"s1": 144, "s2": 144}


def test_history_to_begin_with(spark, feed, sites, hours):
    """A stream that starts with stored hours scores from its first reading on."""
    past = [("s1", h, float(h)) for h in range(99)]
    feed.add([("s1", 98 * 60 + 30, 0.0), ("s1", 99 * 60, 5.0)])
    streams.stream_features(feed.stream(), feed.out, feed.state, sites, history=hours(past)).awaitTermination()
    rows = past[:98] + [("s1", 98, 49.0), ("s1", 99, 5.0)]
    assert_same_features(features_of(spark, feed), features.live_window(hours(rows), sites))


def test_silent_stations_are_forgotten(spark, feed):
    """By processing time, in a stream that goes on."""
    feed.add([("s1", 60, 1.0), ("s2", 60, 1.0)])
    with pytest.raises(ValueError):
        streams.start_windows(feed.stream(), feed.state, print, silence_ms=1)
    sizes = []
    query = streams.start_windows(feed.stream(), feed.state, lambda rows, i: sizes.append(rows.count()), silence_ms=1,
                                  trigger={"processingTime": "200 milliseconds"})
    try:
        deadline = time.time() + 60
        while len(sizes) < 4 and time.time() < deadline:
            query.awaitTermination(1)
    finally:
        query.stop()
    assert sizes[0] == 2 and set(sizes[1:]) == {0}
    assert station_state.stored_hours(spark, feed.state).count() == 0


def test_readings_are_added_up_before_they_travel(spark, feed):
    """Many readings of one station leave each batch as one row per hour; nulls do not count."""
    feed.add([("s1", m, 2.0) for m in range(0, 120)] + [("s1", 5, None)])
    batch = spark.read.schema(schemas.READINGS).parquet(feed.path)
    rows = station_state.hour_sums(batch).collect()
    assert sorted((r.hour - 473352, r.total, r.n) for r in rows) == [(0, 120.0, 60), (1, 120.0, 60)]


def test_fire_hours_of_one_place_are_kept_once(spark):
    """Late detections count until their hour is closed, and the state holds places, not stations."""
    path, out, state = (new_path(spark, n) for n in ("in", "out", "state"))
    stations = spark.createDataFrame([(f"s{i}", 21.0, 75.0) for i in range(30)], "station string, lat double, lon double")

    def add(rows):
        spark.createDataFrame([(START + timedelta(minutes=m), 21.1, 75.0, v, 300.0, None) for m, v in rows],
                              schemas.FIRE_EVENTS).coalesce(1).write.mode("append").parquet(path)

    add([(10, 2.0), (70, 1.0)])
    add([(20, 4.0), (600, 1.0)])
    add([(30, 8.0), (1200, 1.0)])
    add([(40, 16.0), (1800, 1.0)])
    fires = stream_readings(spark, path, schemas.FIRE_EVENTS, files_per_trigger=1)
    query = (streams.stream_fire_hours(fires, stations).writeStream.format("parquet").option("checkpointLocation", state)
             .trigger(availableNow=True).start(out))
    query.awaitTermination()
    got = spark.read.parquet(out).collect()
    assert len(got) == 120
    assert {(r.timestamp.hour, r.fire_count, r.frp_sum) for r in got} == {(0, 3, 14.0), (1, 1, 1.0), (10, 1, 1.0), (20, 1, 1.0)}
    assert max(o["numRowsTotal"] for p in query.recentProgress for o in p["stateOperators"]) <= 4


def test_no_rows_of_closed_hours_are_collected(spark, capsys):
    """The batch that closes the last hours has no new rows, so it is planned as empty: its spots must not be broadcast for that."""
    path, out, state = (new_path(spark, n) for n in ("in", "out", "state"))
    stations = spark.createDataFrame([(f"s{i}", 21.0 + i / 50, 75.0) for i in range(30)], "station string, lat double, lon double")
    spark.createDataFrame([(START + timedelta(minutes=m), 21.1 + m % 7 / 10, 75.0, 1.0, 300.0, None) for m in range(0, 1200, 5)],
                          schemas.FIRE_EVENTS).coalesce(1).write.parquet(path)
    fires = stream_readings(spark, path, schemas.FIRE_EVENTS, files_per_trigger=1)
    query = (streams.stream_fire_hours(fires, stations).writeStream.format("parquet").option("checkpointLocation", state)
             .trigger(availableNow=True).start(out))
    query.awaitTermination()
    query.explain()
    plan = capsys.readouterr().out
    assert "StateStoreSave" in plan and "LocalTableScan <empty>" in plan and "Join" in plan
    assert "BroadcastHashJoin" not in plan
    assert spark.read.parquet(out).count() == 30 * 17


@pytest.mark.parametrize("bytes_", [64 << 20, 3000])
def test_a_large_file_lands_in_parts_that_come_together(spark, monkeypatch, bytes_):
    """Every batch has the rows of its file, all of them and in order, however many parts they lie in; the last file may be small."""
    monkeypatch.setattr(stream_queries, "LANDED_BYTES", bytes_)
    # the second quarter of the time has few rows
    table = spark.range(4000).where("id % 4000 NOT BETWEEN 1000 AND 1995").selectExpr(
        "id AS sensor_id", "concat('s', id % 7) AS station", "timestamp_seconds(id * 60) AS ts", "rand(1) AS pm25")
    landed = stream_queries.Delivery("raw", "sensor_id").land(SimpleNamespace(spark=spark), table, schemas.READINGS)
    seen = {}

    def keep(rows, batch_id):
        found = rows.select("sensor_id", F.input_file_name().alias("file")).collect()
        seen[batch_id] = ({r.sensor_id for r in found}, len({r.file for r in found}))

    landed.writeStream.foreachBatch(keep).option("checkpointLocation", new_path(spark, "state")).trigger(availableNow=True).start().awaitTermination()
    want = {n: set() for n in range(4)}
    for i in (r.sensor_id for r in table.collect()):
        want[min(3, i * 60 * 4 // (3999 * 60 + 1) + max(0, i % 10 - 6))].add(i)
    assert {n: ids for n, (ids, _) in seen.items()} == want
    files = [n for _, n in seen.values()]
    assert files == [1] * 4 if bytes_ > 3000 else max(files) > 1
