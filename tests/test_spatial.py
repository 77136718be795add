import math
import random

import pytest
from pyspark.sql import functions as F

from aqspark.operators import joins, spatial


def km(a, b, c, d):
    la, lb = math.radians(a), math.radians(c)
    x = (math.sin((lb - la) / 2) ** 2
         + math.cos(la) * math.cos(lb) * math.sin(math.radians(d - b) / 2) ** 2)
    return 2 * 6371.0 * math.asin(math.sqrt(min(1, max(0, x))))


@pytest.mark.parametrize("radius", [5, 81, 300, 2500])
def test_grid_join_equals_all_pairs(spark, radius):
    rng = random.Random(radius)

    def spot():
        pole = rng.random()
        lat = rng.uniform(-90, 90) if pole < 0.5 else rng.choice([-1, 1]) * rng.uniform(86, 90)
        lon = rng.uniform(-180, 180) if pole < 0.8 else rng.choice([-179.99, 179.99])
        return lat, lon
    places = [(f"p{i}", *spot()) for i in range(40)]
    # half of the points near a place, so that small radii match too
    points = [(i, *spot()) for i in range(150)]
    points += [(150 + i, max(-90, min(90, p[1] + rng.uniform(-.05, .05))), p[2])
               for i, p in enumerate(places)]
    out = spatial.radius_join(
        spark.createDataFrame(places, "station string, lat double, lon double"),
        spark.createDataFrame(points, "i int, latitude double, longitude double"), radius)
    got = sorted((r.station, r.i) for r in out.collect())
    want = sorted((p[0], q[0]) for p in places for q in points
                  if km(p[1], p[2], q[1], q[2]) <= radius)
    assert got == want and got


def north(distance):
    return math.degrees(distance / 6371.0)


def test_radius_edge_and_two_stations(spark):
    stations = spark.createDataFrame([("a", 21.0, 75.0), ("b", 21.0 + north(500), 75.0)],
                                     "station string, lat double, lon double")
    fires = spark.createDataFrame(
        [("2024-01-01 00:10:00", 21.0 + north(d), 75.0, f, 300.0, None)
         for d, f in ((299.9, 1.0), (300.1, 2.0), (250.0, 4.0), (250.0, 4.0))],
        "timestamp string, latitude double, longitude double, frp double, "
        "bright_ti4 double, bright_ti5 double").selectExpr(
        "cast(timestamp as timestamp) timestamp", "latitude", "longitude", "frp",
        "bright_ti4", "bright_ti5")
    got = {r.station: r for r in spatial.fire_hourly(stations, fires).collect()}
    assert (got["a"].fire_count, got["a"].frp_sum, got["a"].frp_max) == (3, 9.0, 4.0)
    assert (got["b"].fire_count, got["b"].frp_sum) == (4, 11.0)
    assert got["a"].bright_ti4_mean == 300.0 and got["a"].bright_ti5_mean is None
    only = fires.drop("bright_ti4", "bright_ti5")
    assert {r.bright_ti5_mean for r in spatial.fire_hourly(stations, only).collect()} == {0.0}


def test_nearest_city_cutoff_and_ties(spark):
    refs = spark.createDataFrame([(0, "first", "s0", 20.0, 80.0), (1, "twin", "s1", 20.0, 80.0)],
                                 "ord int, city string, state string, lat double, lon double")
    points = spark.createDataFrame(
        [(str(d), 20.0 + north(d), 80.0) for d in (0.0, 79.0, 80.5, 81.5)] + [("none", None, 80.0)],
        "station string, lat double, lon double")
    got = {r.station: r.city for r in spatial.nearest_join(points, refs).collect()}
    assert got == {"0.0": "first", "79.0": "first", "80.5": "first", "81.5": "Unknown",
                   "none": None}


def test_crowded_cells_are_split_by_their_counts(spark):
    rng = random.Random(9)
    # nine points of ten lie in one cell of the grid of 300 km
    points = [(i, 21.5 + rng.uniform(-.4, .4), 75.5 + rng.uniform(-.4, .4)) for i in range(4500)]
    points += [(4500 + i, rng.uniform(10, 35), rng.uniform(65, 95)) for i in range(500)]
    places = [(f"p{i}", rng.uniform(18, 25), rng.uniform(72, 79)) for i in range(12)]
    near = spark.createDataFrame(places, "station string, lat double, lon double")
    table = spark.createDataFrame(points, "i int, latitude double, longitude double")
    cells = table.selectExpr("floor(latitude / 3) AS _row", "floor(longitude / 3) AS _col")
    parts = {(r["_row"], r["_col"]): r["_parts"] for r in spatial.crowded_cells(cells, 300).collect()}
    assert len(parts) == 1 and next(iter(parts.values())) >= 15
    found = {salts: sorted((r.station, r.i) for r in spatial.radius_join(near, table, 300, salts=salts, crowd=crowd).collect())
             for salts, crowd in ((None, 300), (1, 300), (3, 300))}
    assert found[None] == found[1] == found[3]
    assert found[None] == sorted((p[0], q[0]) for p in places for q in points if km(p[1], p[2], q[1], q[2]) <= 300)


def test_no_task_of_the_join_holds_a_crowded_cell(spark):
    """The rows of each part, as the join deals them, before any pair is made."""
    table = spark.range(50_000).selectExpr("id AS i", "21.5 + id % 7 / 100 AS latitude", "75.5 + id % 11 / 100 AS longitude")
    cells = table.selectExpr("i", "floor(latitude / 3) AS _row", "floor(longitude / 3) AS _col", "latitude", "longitude")
    (cell,) = spatial.crowded_cells(cells, 2000).collect()
    assert cell["_parts"] == 25
    sizes = [r["count"] for r in table.groupBy(F.pmod(F.xxhash64("i", "latitude", "longitude"), F.lit(cell["_parts"]))).count().collect()]
    assert len(sizes) == 25 and max(sizes) < 1.2 * 2000
    one = spark.createDataFrame([("a", 21.5, 75.5)], "station string, lat double, lon double")
    assert spatial.radius_join(one, table, 300, crowd=2000).count() == 50_000


def test_tasks_follow_the_pairs(spark):
    """Few bytes in one partition make many pairs, all in one cell; no task may make most of them."""
    places = spark.range(0, 200, 1, 1).selectExpr("concat('p', id) AS station", "21.3 + id % 20 / 100 AS lat", "75.3 + id % 30 / 100 AS lon")
    points = spark.range(0, 5000, 1, 1).selectExpr("id AS i", "21.5 + id % 70 / 1000 AS latitude", "75.5 + id % 110 / 1000 AS longitude")
    made = [r["count"] for r in spatial.radius_join(places, points, 300).groupBy(F.spark_partition_id()).count().collect()]
    assert sum(made) == 200 * 5000
    assert len(made) >= 8 and max(made) < 0.3 * sum(made)


@pytest.mark.parametrize("to", [(21.0, 75.0000001), (21.01, 75.02), (23.1, 76.9), (-60.0, 170.0)])
def test_pairs_at_the_very_edge(spark, to):
    """A pair whose distance is the radius itself counts, unless ``strict``; nulls and NaN never do."""
    places = spark.createDataFrame([("a", 21.0, 75.0), ("none", None, 75.0), ("nan", float("nan"), 75.0)], "station string, lat double, lon double")
    points = spark.createDataFrame([(1, *to), (2, None, 75.0), (3, float("nan"), float("nan"))], "i int, latitude double, longitude double")
    (one,) = places.crossJoin(points).where("station = 'a' AND i = 1").select(
        spatial.haversine_km("lat", "lon", "latitude", "longitude").alias("km")).collect()
    for km_, strict, want in ((one.km, False, 1), (one.km, True, 0), (one.km * (1 - 1e-12), False, 0), (one.km * (1 + 1e-12), True, 1)):
        got = spatial.radius_join(places, points, km_, strict=strict).select("station", "i", "distance_km").collect()
        assert [tuple(r) for r in got] == [("a", 1, one.km)] * want


def fire_table(spark, rows):
    return spark.createDataFrame(rows, "hour int, latitude double, longitude double, frp double, bright_ti4 double, bright_ti5 double").selectExpr(
        "timestamp_seconds(hour * 3600 + 60) AS timestamp", "* EXCEPT (hour)")


def test_stations_of_one_place_meet_fires_once(spark):
    """Forty stations of one place are one site; lists of places, repeated rows and null names count as they come."""
    rows = [(f"s{i}", 21.0, 75.0) for i in range(40)]
    rows += [("two", 21.0, 75.0), ("two", 30.0, 80.0), ("twice", 21.0, 75.0), ("twice", 21.0, 75.0), (None, 21.0, 75.0), ("lost", None, 75.0)]
    stations = spark.createDataFrame(rows, "station string, lat double, lon double")
    sites, members = spatial.shared_sites(stations)
    assert sites.count() == 4 and members.count() == 43
    fires = fire_table(spark, [(0, 21.1, 75.0, 2.0, 300.0, None), (0, 21.2, 75.1, 4.0, 310.0, 290.0), (1, 30.0, 80.1, 8.0, 320.0, 280.0),
                               (1, 50.0, 10.0, 1.0, 300.0, 280.0)])
    spots = fires.withColumn("timestamp", F.date_trunc("hour", "timestamp"))
    assert spatial.site_hours(sites, spots, 300).count() == 2 + (2 + 1) + 2
    got = {(r.station, r.timestamp.hour): r for r in spatial.fire_hourly(stations, fires).collect()}
    assert set(got) == {(s, 0) for s in [*(f"s{i}" for i in range(40)), "two", "twice", None]} | {("two", 1)}
    for name, n in (("s7", 2), ("two", 2), ("twice", 4), (None, 2)):
        row = got[name, 0]
        assert (row.fire_count, row.frp_sum, row.frp_mean, row.frp_max) == (n, 3.0 * n, 3.0, 4.0)
        assert (row.bright_ti4_mean, row.bright_ti5_mean) == (305.0, 290.0)
    assert (got["two", 1].fire_count, got["two", 1].frp_sum) == (1, 8.0)


@pytest.mark.parametrize("crowd", [spatial.CROWD, 5])
def test_pairs_of_a_site_and_hour_meet_in_one_task(spark, crowd):
    rng = random.Random(3)
    places = [(f"p{i}", rng.uniform(10, 35), rng.uniform(65, 95)) for i in range(60)]
    points = [(h, rng.uniform(10, 35), rng.uniform(65, 95), 1.0, None, None) for h in range(10) for _ in range(80)]
    sites, members = spatial.shared_sites(spark.createDataFrame(places, "station string, lat double, lon double"))
    spots = fire_table(spark, points)
    pairs = spatial.site_hours(sites, spots, 300, crowd=crowd).withColumn("task", F.spark_partition_id())
    assert pairs.count() == sum(km(p[1], p[2], q[1], q[2]) <= 300 for p in places for q in points)
    if crowd == spatial.CROWD:
        assert pairs.groupBy("_site", "timestamp").agg(F.countDistinct("task").alias("n")).where("n > 1").isEmpty()


def test_fires_are_joined_by_site(spark):
    """Readings get what station rows would give them, from one row per site and hour; only hours asked for are summed."""
    stations = spark.createDataFrame([(f"s{i}", 21.0, 75.0) for i in range(40)] + [("two", 21.0, 75.0), ("two", 30.0, 80.0), ("lost", None, 75.0)],
                                     "station string, lat double, lon double")
    fires = fire_table(spark, [(0, 21.1, 75.0, 2.0, 300.0, None), (0, 21.2, 75.1, 4.0, 310.0, 290.0), (1, 30.0, 80.1, 8.0, 320.0, 280.0)])
    by_site = spatial.fire_hourly(stations, fires, shared=True)
    assert by_site.sums.count() == 3 and by_site.members.count() == 41
    readings = spark.createDataFrame([(s, h, 1.0) for s in ("s1", "s2", "two", "lost", "unknown", None) for h in (0, 1, 2)] + [("s1", 0, 2.0)],
                                     "station string, hour int, pm25 double").selectExpr("station", "timestamp_seconds(hour * 3600) AS timestamp", "pm25")
    wanted = joins.join_fires(readings, spatial.fire_hourly(stations, fires))
    got = joins.join_fires(readings, by_site)
    assert got.columns == wanted.columns
    assert sorted(map(str, got.collect())) == sorted(map(str, wanted.collect()))
    late = readings.filter("hour(timestamp) = 1")
    (one,) = spatial.fire_hourly(stations, fires, shared=True, hours=late).sums.collect()
    assert (one.timestamp.hour, one.frp_sum) == (1, 8.0)
