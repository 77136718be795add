"""Edges of the scalar expressions."""

import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from aqspark.functions import calendar, fixed, scalars, text
from aqspark.operators import clean


def test_fixed_lists():
    assert len(fixed.FEATURES) == len(set(fixed.FEATURES)) == 59
    assert len(fixed.TARGETS) == 24
    assert len(fixed.CITIES) == 53 and len(fixed.FALLBACK_STATIONS) == 30


def test_aqi_edges(column):
    values = [-1.0, 0.0, 29.999, 30.0, 60.0, 90.0, 120.0, 250.0, 9999.0, None]
    assert column(scalars.aqi_category("x"), values) == [0, 0, 0, 1, 2, 3, 4, 5, 0, 0]
    assert column(scalars.aqi_code("x"), values) == [5, 0, 0, 1, 2, 3, 4, 5, 5, 5]
    assert column(scalars.aqi_label("x"), values)[:4] == [
        "Severe", "Good", "Good", "Satisfactory"]


def test_half_degree_goes_to_even(column):
    assert column(scalars.half_degree("x"), [28.25, 28.75, -0.25, 28.3]) == [28.0, 29.0, 0.0, 28.5]


def test_clamp_keeps_null(column):
    assert column(scalars.clamp("x", 0.0, 1500.0), [None, -1.0, 3.0, 2000.0]) == [
        None, 0.0, 3.0, 1500.0]


def test_news_score(column):
    assert column(text.news_score("x"), [None, 0, 1, 3, 9], "int") == [
        0.0, 0.0, pytest.approx(1 / 3), 1.0, 1.0]


def test_confidence_ramp(column):
    got = column(scalars.nominal_confidence("x"), list(range(24)), "int")
    assert got == [round(0.90 - (h / 24) * 0.30, 2) for h in range(24)]


def test_acquired_at(spark):
    df = spark.createDataFrame([("2024-03-01", "5"), ("2024-03-01", "1430"),
                                ("2024-03-01", "2575")], "d string, t string")
    got = [r[0] for r in df.select(scalars.acquired_at("d", "t")).collect()]
    assert got == [datetime(2024, 3, 1, 0, 5), datetime(2024, 3, 1, 14, 30), None]


def at(spark, moments, columns, lat=28.0):
    df = spark.createDataFrame([(i, datetime.fromisoformat(m)) for i, m in enumerate(moments)],
                               "i int, timestamp timestamp").withColumn("lat", F.lit(lat))
    rows = df.select("i", *[c.alias(n) for n, c in columns.items()]).orderBy("i").collect()
    return [r.asDict() for r in rows]


def test_local_season_but_utc_month(spark):
    # 20:00 UTC on 31 October is 1 November on the local clock
    columns = {**calendar.seasons("timestamp", "lat"), **calendar.clock("timestamp")}
    row = at(spark, ["2024-10-31 20:00", "2024-10-01 00:00"], columns)
    assert row[0]["is_harvest_season"] == 1
    assert row[0]["month_sin"] == pytest.approx(row[1]["month_sin"])


def test_harvest_depends_on_latitude(spark):
    for lat, want in ((25.0, 1), (25.01, 0)):
        rows = at(spark, ["2024-02-10 06:00"], calendar.seasons("timestamp", "lat"), lat)
        assert rows[0]["is_harvest_season"] == want


def test_festival_window_edges(spark):
    # local midnight is 18:30 UTC of the day before
    moments = ["2024-10-28 18:29", "2024-10-28 18:30", "2024-11-02 18:30", "2024-11-02 18:31"]
    rows = at(spark, moments, calendar.seasons("timestamp", "lat"))
    assert [r["is_diwali_period"] for r in rows] == [0, 1, 1, 0]
    moments = ["2024-03-23 18:29", "2024-03-23 18:30", "2024-03-25 18:30", "2024-03-25 18:31"]
    rows = at(spark, moments, calendar.seasons("timestamp", "lat"))
    assert [r["is_holi_period"] for r in rows] == [0, 1, 1, 0]


def test_calendar_news_hours(spark):
    moments = ["2023-12-31 14:29", "2023-12-31 14:30", "2023-12-31 21:29", "2023-12-31 21:30",
               "2024-05-01 06:30", "2024-05-01 15:30", "2024-10-14 12:00", "2024-10-15 12:00"]
    rows = at(spark, moments, calendar.calendar_news("timestamp", "lat"))
    assert [r["news_fireworks"] for r in rows[:4]] == [0.0, 1.0, 1.0, 0.0]
    assert [r["news_dust_storm"] for r in rows[4:6]] == [0.3, 0.0]
    assert [r["news_crop_burning"] for r in rows[6:]] == [0.0, 0.8]
    south = at(spark, moments[-1:] + ["2024-01-05 00:00"],
               calendar.calendar_news("timestamp", "lat"), lat=25.0)
    assert south[0]["news_crop_burning"] == 0.0 and south[1]["news_smog_alert"] == 0.1


def test_terms_are_whole_words(column):
    texts = ["GRAP stage 4 in Delhi", "grape harvest", "A dust-storm!", "smog, alert", None, "UP"]
    terms = ["GRAP", "dust storm", "smog alert", "up"]
    words = text.word_list("x")
    got = column(text.mentions(words, text.opening_words(words, terms), terms), texts, "string")
    assert got == [True, False, True, True, None, True]
    apart = ["dust and storm", "storm dust", "stardust storm"]
    assert column(text.mentions(words, text.opening_words(words, terms), terms), apart,
                  "string") == [False, False, False]


def test_slug_and_label(spark):
    df = spark.createDataFrame(
        [("Site, North East", 7), (None, 8), ("", 9), ("x" * 60, 10)], "n string, i bigint")
    got = [r[0] for r in df.select(text.station_slug("n", "i")).collect()]
    assert got == ["site_north_east_7", "loc_8_8", "loc_9_9", "x" * 47 + "_10"]


def test_screening(spark):
    df = spark.createDataFrame(
        [(None, 20.0, 80.0), (5_077_640, 5.0, 80.0), (100, 20.0, 80.0), (2_000_000, 20.0, 80.0),
         (12_150_000, 20.0, 80.0), (16_800_000, 37.5, 97.5), (3_000_000, None, 80.0)],
        "sensor_id bigint, lat double, lon double")
    got = [r.reason for r in clean.reject_reason(df).collect()]
    assert got == ["no sensor", "outside area", "unproductive sensor", None,
                   "unproductive sensor", None, "outside area"]


def test_pm25_name_rules(column):
    names = ["PM25", "pm2.5 mass", "pm2x5", "no2", None]
    assert column(text.is_pm25("x"), names, "string") == [True, True, False, False, False]
    assert column(text.is_pm25_archive("x"), names, "string") == [True, True, True, False, None]


def test_ensure_columns_leaves_nulls(spark):
    df = spark.createDataFrame([(None,)], "a double")
    assert clean.ensure_columns(df, {"a": 1.0, "b": 2.0}).collect() == [(None, 2.0)]


def test_weights_sum_to_one():
    for kind, decay in (("exp", 0.04), ("power", 0.95)):
        weights = scalars.horizon_weights(kind, decay)
        assert sum(weights) == pytest.approx(1.0) and weights == sorted(weights, reverse=True)


def test_round_half_up_is_round(spark):
    """Ties, values next to ties, huge ones, nulls and NaN among many of all sizes."""
    rng = random.Random(4)
    values = [rng.uniform(-1, 1) * 10 ** rng.randint(-9, 16) for _ in range(20_000)]
    values += [round(rng.uniform(0, 300), 9) for _ in range(5_000)] + [(k + 0.5) / 10 ** 8 for k in range(5_000)]
    values += [None, float("nan"), float("inf"), -float("inf"), 0.0, -0.0, 299.999999995, 2.5, -2.5]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    for digits in (0, 4, 8):
        assert df.where(~scalars.round_half_up("x", digits).eqNullSafe(F.round("x", digits))).collect() == []
