"""Facts, features and products on small hand-made data."""

import math
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from aqspark.functions import fixed
from aqspark.operators import aggregate, metrics, spatial
from aqspark.operators.joins import join_news, news_for_station
from aqspark.operators.windows import interpolate, last_n
from aqspark.plans import features, forecast, history, learning, linear, registry
from aqspark.sources import dims
from aqspark.storage import materialise

SITES = "station string, lat double, lon double, city string"


@pytest.fixture
def sites(spark):
    return spark.createDataFrame([("a", 28.6, 77.2, "Delhi"), ("b", 19.0, 72.8, "Mumbai")], SITES)


def test_filter_after_and_clip_before(spark):
    at = datetime(2024, 1, 1, 5)
    df = spark.createDataFrame(
        [("a", at, -5.0), ("a", at, 2000.0), ("b", at, 1501.0), ("c", at, 1500.0),
         ("d", at, -3.0), ("d", at, 1.0)], "station string, ts timestamp, pm25 double")

    def run(policy):
        return {r.station: r.pm25 for r in aggregate.hourly_mean(
            df, ts="ts", policy=policy).collect()}
    assert run("filter_after") == {"a": 997.5, "c": 1500.0}
    assert run("clip_before") == {"a": 750.0, "b": 1500.0, "c": 1500.0, "d": 0.5}


def wave(n, station="a"):
    return [(station, h, 50 + 30 * math.sin(h / 5.0) + h % 7) for h in range(n)]


def test_dataset_gates_repair_and_types(hours, sites, spark):
    readings = hours(wave(260) + wave(199, "b"))
    weather = hours([("a", h, 20.0 + h) for h in range(0, 260, 2)], "temperature_2m").select(
        "timestamp", "temperature_2m")
    out = features.build_dataset(readings, sites, weather)
    assert out.columns == ["timestamp", "station"] + fixed.FEATURES + fixed.TARGETS
    pdf = out.toPandas().sort_values("timestamp").reset_index(drop=True)
    assert set(pdf.station) == {"a"} and len(pdf) == 260 - 24 - 24
    assert not pdf.isna().any().any()
    assert {str(t) for t in pdf[fixed.FEATURES].dtypes} == {"float32"}
    # every second hour lies on the line between its neighbours
    np.testing.assert_allclose(pdf.temperature_2m[1:20], 20.0 + np.arange(25, 44))
    # heads that lag 72 does not reach repeat its first known value
    assert pdf.pm25_lag72[:48].nunique() == 1
    assert (pdf.dew_point_2m != 0).sum() == 0 or pdf.dew_point_2m.notna().all()
    assert (pdf.news_calamity == 0).all() and (pdf.fire_count == 0).all()


def test_column_unknown_everywhere_keeps_the_station(hours, sites):
    copollutants = hours([("a", 3, None)], "pm10")
    out = features.build_dataset(hours(wave(240)), sites, copollutants=copollutants)
    assert out.count() == 240 - 48 and out.agg(F.max("pm10")).first()[0] == 0.0


def test_stations_with_few_complete_rows_are_left_out(hours, sites):
    readings = hours(wave(260) + wave(259, "b"))
    out = features.build_dataset(readings, sites, min_rows=260 - 48)
    assert {tuple(r) for r in out.groupBy("station").count().collect()} == {("a", 260 - 48)}
    both = features.build_dataset(readings, sites, min_rows=259 - 48)
    assert both.count() == 260 + 259 - 96


def test_live_window_precedence_of_news(hours, sites, spark):
    readings = hours(wave(90) + wave(11, "b"))
    news = hours([("a", 89, 0.7)], "news_calamity")
    out = features.live_window(readings, sites, news=news).orderBy("timestamp").toPandas()
    assert set(out.station) == {"a"} and len(out) == 72
    assert out.news_calamity.tolist() == [0.0] * 71 + [0.7]
    assert not out.isna().any().any()
    calendar = features.live_window(readings, sites).toPandas()
    assert (calendar.news_industrial_event == 0.05).all()


def test_live_window_joins_only_the_rows_it_looks_at(hours, sites, spark, monkeypatch):
    """Rows older than the window and its longest lag meet no weather, fires or news, and change nothing."""
    stored = []

    def keep(df):
        stored.append(materialise(df))
        return stored[-1]
    monkeypatch.setattr(features, "materialise", keep)
    readings = hours(wave(400) + wave(160, "b"))
    fires = hours([("x", h, 5.0) for h in range(0, 400, 7)], "frp").select(
        "timestamp", "frp", F.lit(28.0).alias("latitude"), F.lit(77.0).alias("longitude"), F.lit(300.0).alias("bright_ti4"), F.lit(280.0).alias("bright_ti5"))
    live = features.live_window(readings, sites, fires=fires)
    assert {r["station"]: r["count"] for r in stored[0].groupBy("station").count().collect()} == {"a": 144, "b": 144}
    whole = features.build_features(readings, sites, fires=spatial.fire_hourly(sites, fires))
    cols = ["station", "timestamp", "pm25_lag72", "pm25_rmean24", "pm25_rstd24", "pm25_trend6h", "fire_count", "frp_sum"]
    newest = last_n(whole, 72).select(cols)
    assert live.count() == 144 and live.filter("fire_count > 0").count() > 0
    assert sorted(map(str, live.select(cols).collect())) == sorted(map(str, newest.collect()))


def test_live_window_repairs_only_columns_with_gaps(hours, sites, monkeypatch):
    asked = []

    def repair(df, cols, **options):
        asked.append(list(cols))
        return interpolate(df, cols, **options)
    monkeypatch.setattr(features, "interpolate", repair)
    whole = features.live_window(hours(wave(200)), sites)
    assert asked == [] and whole.count() == 72
    short = features.live_window(hours(wave(200) + wave(100, "b")), sites)
    assert asked == [["pm25_lag48", "pm25_lag72"]]
    assert short.schema == whole.schema and not short.toPandas().isna().any().any()
    assert sorted(map(str, short.filter("station = 'a'").collect())) == sorted(map(str, whole.collect()))


def test_stored_news_gated_by_city(hours, sites, spark):
    rows = hours([("a", 0, 1.0), ("a", 1, 1.0), ("b", 0, 1.0)]).join(sites, "station").select(
        "station", "city", "timestamp", "lat")
    stored = rows.filter("station = 'a' and hour(timestamp) = 0").select(
        "city", "timestamp", *[F.lit(0.9).alias(c) for c in fixed.NEWS_SIGNALS])
    got = {(r.station, r.timestamp.hour): r.news_industrial_event
           for r in news_for_station(rows, stored).collect()}
    assert got == {("a", 0): 0.9, ("a", 1): 0.0, ("b", 0): 0.05}
    assert join_news(rows, None).columns[-6:] == fixed.NEWS_SIGNALS


def test_registry_chain(spark):
    def sensors(*names):
        return [{"id": i, "parameter": {"name": n}} for i, n in names]
    schema = ("location_id bigint, name string, locality string, city string, lat double, "
              "lon double, owner string, sensors array<struct<id: bigint, "
              "parameter: struct<name: string>>>")
    rows = [(1, "A, site", "", "Delhi", 28.6, 77.2, "", sensors((5, "pm25"), (9, "PM2.5"))),
            (2, None, "Town", None, 20.0, 80.0, "", sensors((4, "pm25"))),
            (3, "no coordinates", None, None, None, 80.0, "", sensors((4, "pm25"))),
            (4, "no sensor", None, None, 20.0, 80.0, "", sensors((4, "o3"))),
            (5, "far", None, None, 50.0, 80.0, "", sensors((4, "pm25")))]
    found = registry.build_registry(spark.createDataFrame(rows, schema),
                                    dims.fallback_stations(spark))
    got = {r.station: r for r in found.collect()}
    assert got["a_site_1"].sensor_ids == [9, 5] and got["a_site_1"].sensor_id == 9
    assert got["loc_2_2"].city == "Town"
    assert "delhi_ito" not in got and got["mumbai_bandra"].owner == "fallback"
    assert len(got) == 2 + 29
    labelled = registry.label_cities(found, dims.cities(spark))
    assert {r.city for r in labelled.filter("station = 'a_site_1'").collect()} == {"Delhi"}
    at = datetime(2024, 5, 1)
    coverage = spark.createDataFrame([(5, at, at + timedelta(days=3), 4)],
                                     "sensor_id bigint, first_ts timestamp, last_ts timestamp, n int")
    screened = registry.screen_stations(found, coverage).collect()
    assert [(r.station, r.sensor_id, r.data_start) for r in screened] == [
        ("a_site_1", 5, "2024-05-01T00:00:00Z")]


def test_merge_history_priority(hours):
    current = hours([("a", 0, 1.0), ("a", 1, 2.0)]).withColumn("extra", F.lit(1))
    old = hours([("a", 1, 9.0), ("a", 2, 8.0)])

    def run(*args):
        out = history.merge_history(current, old, *args).orderBy("timestamp")
        return [r.pm25 for r in out.collect()]
    assert run() == [1.0, 9.0, 8.0]
    assert run(("current", "history")) == [1.0, 2.0, 8.0]


def test_metrics_by_hand(spark):
    pairs = spark.createDataFrame([(1, 1.0, 2.0), (1, 3.0, 3.0), (1, 5.0, 2.0), (2, 4.0, 4.0),
                                   (1, None, 3.0)], "horizon int, y_true double, y_pred double")
    got = {r.horizon: r for r in metrics.horizon_metrics(pairs).collect()}
    assert got[1].n == 3 and got[1].mae == pytest.approx(4 / 3)
    assert got[1].rmse == pytest.approx(math.sqrt(10 / 3))
    assert got[1].r2 == pytest.approx(1 - 10 / 8) and got[2].r2 == 1.0
    flat = [1.0] * 24
    loss = metrics.weighted_huber(pairs, 1.0, flat).first().loss
    assert loss == pytest.approx((0.5 + 0 + 2.5 + 0) / 4)


def test_scoring_skips_short_stations_and_loads_once(hours, spark):
    df = hours(wave(80) + wave(71, "b") + wave(75, "c"))
    ids = spark.createDataFrame([("a", 7)], "station string, station_id int")

    def load():
        def predict(x, station_ids):
            assert x.shape[1:] == (72, 1) and x.dtype == np.float32
            return np.repeat(x[:, -1, :] + station_ids[:, None] * 100.0, 24, axis=1)
        return predict
    docs = forecast.score(df.withColumns({c: F.lit(0.5) for c in fixed.SHOWN_SIGNALS}), load,
                          {"pm25": (10.0, 2.0)}, (10.0, 2.0), ids, ["pm25"])
    got = {r.station: r for r in docs.collect()}
    assert set(got) == {"a", "c"}
    last = wave(75, "c")[-1][2]
    step = got["c"].forecast["+24h"]
    assert step.pm25 == pytest.approx(round(last, 1)) and step.confidence == 0.61
    assert got["a"].forecast["+1h"].pm25 == pytest.approx(
        round(wave(80)[-1][2], 1) + 200 * 7, abs=0.11)
    assert got["c"].signals == dict.fromkeys(fixed.SHOWN_SIGNALS, 0.5)
    assert set(got["c"].forecast) == {f"+{h}h" for h in range(1, 25)}


def test_learning_set_and_models(hours):
    df = hours(wave(300) + wave(150, "b") + wave(90, "c"))
    names = ["pm25", "pm25_lag1"]
    from aqspark.operators.windows import add_lags, add_targets
    data = add_targets(add_lags(df, lags=[1])).dropna(subset=fixed.TARGETS)
    found = learning.prepare(data, names)
    assert found.rows.filter("pm25_lag1 is null").count() == 0
    assert found.scaler.count() == 3
    examples = learning.learning_sequences(found.rows, names, max_rows=20)
    # the cap is spread over the stations' splits that have examples
    assert 0 < examples.count() <= 20 and set(examples.columns) >= {"station", "split"}
    full = learning.learning_sequences(found.rows, names)
    parts = found.rows.groupBy("station", "split").count().collect()
    assert full.count() == sum(max(0, r["count"] - 95) for r in parts)
    models = linear.fit_linear(found.rows, [1], names, max_iter=30)
    pairs = linear.predict_linear(models, found.rows, names)
    assert metrics.horizon_metrics(pairs).first().r2 > 0.8


def test_nothing_is_filled_from_a_later_split(hours):
    """A feature known in the last rows only stays unknown, so zero, in the training rows."""
    df = hours(wave(200))
    last = df.agg(F.max("timestamp")).first()[0]
    rows = df.withColumn("no2", F.when(F.unix_timestamp("timestamp") > F.unix_timestamp(F.lit(last)) - 20 * 3600, 5.0))
    rows = rows.withColumns({t: F.col("pm25") for t in fixed.TARGETS}).withColumn("so2", F.lit(None).cast("double"))
    found = learning.prepare(rows, ["pm25", "no2", "so2"])
    got = {r.split: (r.lo, r.hi) for r in found.rows.groupBy("split").agg(
        F.min("no2").alias("lo"), F.max("no2").alias("hi")).collect()}
    assert got["train"] == (0.0, 0.0) and got["test"][1] == 5.0
    assert found.rows.filter("so2 <> 0 or so2 is null").count() == 0


def test_news_of_some_cities(hours, sites, spark):
    """Cities that the news do not know follow the calendar, in live windows and in datasets."""
    df = hours(wave(200) + wave(200, "b"))
    places = spark.createDataFrame([("a", 28.0, 77.0, "X"), ("b", 28.0, 77.0, "Y")],
                                   "station string, lat double, lon double, city string")
    news = df.filter("station = 'a'").select(F.lit("X").alias("city"), "timestamp", F.lit(0.7).alias("news_calamity"))
    for out in (features.live_window(df, places, news=news),
                features.build_dataset(df, places, news=news, min_readings=10, min_rows=10)):
        got = {r.station: r for r in out.groupBy("station").agg(
            F.max("news_calamity").alias("told"), F.max("news_industrial_event").alias("calendar")).collect()}
        assert got["a"].told == pytest.approx(0.7) and got["a"].calendar == 0
        assert got["b"].told == 0 and got["b"].calendar == pytest.approx(0.05)
