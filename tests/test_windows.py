"""Row windows in segments against pandas over whole stations."""

import random
from datetime import datetime, timedelta
from pathlib import Path

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from aqspark.operators import blocks, windows
from aqspark.operators.segments import split_segments
from aqspark.storage import materialise, new_path

ROWS = 40      # segments far smaller than the frames reach


@pytest.fixture(scope="module")
def gappy(spark):
    """One station with most rows, some short ones, holes of days and of months."""
    rng = random.Random(7)
    rows = []
    for station, n in (("hot", 400), ("b", 130), ("c", 24), ("d", 2), ("e", 1)):
        at = datetime(2023, 1, 1)
        for _ in range(n):
            at += timedelta(hours=rng.choice([1, 1, 1, 2, 30, 24 * rng.randint(1, 50)]))
            known = rng.random() > 0.4 and station != "c"
            rows.append((station, at, round(rng.uniform(0, 400), 2),
                         round(rng.uniform(0, 9), 2) if known else None))
    schema = "station string, timestamp timestamp, pm25 double, x double"
    return spark.createDataFrame(rows, schema)


def ordered(df):
    return df.toPandas().sort_values(["station", "timestamp"]).reset_index(drop=True)


def same(a, b):
    np.testing.assert_allclose(a.astype(float), b.astype(float), rtol=1e-9, atol=1e-9)


def test_segments_are_small_and_owned_once(gappy):
    parts = split_segments(gappy, before=72, after=24, rows=ROWS).toPandas()
    own = parts[parts._own]
    assert len(own) == gappy.count()
    assert own.groupby(["station", "_seg"]).size().max() < 100
    assert own[own.station == "hot"]._seg.nunique() > 4


def test_lags_and_targets(gappy):
    got = ordered(windows.add_targets(windows.add_lags(gappy, rows=ROWS), rows=ROWS))
    by = got.groupby("station")["pm25"]
    for k in (1, 3, 6, 12, 24, 48, 72):
        same(got[f"pm25_lag{k}"], by.shift(k))
    for h in range(1, 25):
        same(got[f"target_{h}h"], by.shift(-h))


def test_rolling_and_trend(gappy):
    got = ordered(windows.add_trend(windows.add_rolling(gappy, rows=ROWS), rows=ROWS))
    for _, part in got.groupby("station"):
        earlier = part["pm25"].shift(1)
        day = earlier.rolling(24, min_periods=3)
        same(part["pm25_rmean24"], day.mean())
        same(part["pm25_rmax24"], day.max())
        same(part["pm25_rmin24"], day.min())
        same(part["pm25_rstd24"], day.std().fillna(0.0))
        trend = (earlier.rolling(6, min_periods=2).mean()
                 - earlier.rolling(12, min_periods=3).mean()).fillna(0.0)
        same(part["pm25_trend6h"], trend)
    known = got.dropna(subset=["pm25_rmean24"])
    assert (known.pm25_rmin24 <= known.pm25_rmean24 + 1e-9).all()
    assert (known.pm25_rmean24 <= known.pm25_rmax24 + 1e-9).all()


def test_interpolation_follows_row_numbers(gappy):
    got = ordered(windows.interpolate(gappy, ["x"], default=-5, rows=ROWS))
    source = ordered(gappy)
    for station, part in source.groupby("station"):
        want = part["x"].interpolate(method="linear", limit_direction="both").fillna(-5.0)
        same(got.loc[part.index, "x"], want)
    assert list(got.columns) == gappy.columns


def test_fill_forward_then_back(gappy):
    got = ordered(windows.fill_forward_back(gappy, ["x"], rows=ROWS))
    for _, part in ordered(gappy).groupby("station"):
        same(got.loc[part.index, "x"], part["x"].ffill().bfill().fillna(0))


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_rows_are_spread_by_segment_only(spark):
    """Rows meet the segments, a table that is smaller by far, without being shuffled for it."""
    rows = spark.range(20_000).selectExpr(
        "concat('s', id % 10) AS station", "timestamp_seconds(1700000000 + (id div 10) * 3600) AS timestamp",
        "IF(id % 3 = 0, CAST(id AS double), NULL) AS x", "rand(1) AS other")
    rows = materialise(rows)
    key = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(key)
    spark.conf.set(key, "60kb")
    try:
        for out in (windows.interpolate(rows, ["x"]), windows.fill_forward_back(rows, ["x"]), windows.add_lags(rows, "x")):
            assert "_month" not in "".join(line for line in plan_of(out).splitlines() if "hashpartitioning" in line)
            assert out.count() == 20_000
    finally:
        spark.conf.set(key, before)


def test_nulls_at_head_middle_tail(hours):
    values = [None, None, 2.0, None, 6.0, None, None]
    df = hours([("a", h, v) for h, v in enumerate(values)])
    got = ordered(windows.interpolate(df, ["pm25"]))["pm25"].tolist()
    assert got == [2.0, 2.0, 2.0, 4.0, 6.0, 6.0, 6.0]


@pytest.mark.parametrize("gap", [0, 1])
def test_sequences(hours, gap):
    sizes = {"a": 95, "b": 96, "c": 97, "d": 260}
    df = hours([(s, h, float(h)) for s, n in sizes.items() for h in range(n)])
    got = windows.sequences(df, ["pm25"], ["pm25"], gap=gap, rows=60).toPandas()
    assert got.groupby("station").size().to_dict() == {"b": 1, "c": 2, "d": 260 - 95}
    for r in got.itertuples():
        last = r.row - gap
        assert [v[0] for v in r.x] == list(range(last - 71, last + 1))
        assert list(r.y) == [r.row]


@pytest.mark.parametrize("gap", [0, 1])
def test_blocks_hold_the_same_examples(hours, gap):
    """Blocks end anywhere, at a station's last row too; every example is cut out of one block."""
    sizes = {"a": 95, "b": 96, "c": 180, "d": 200, "e": 270, "f": 431}
    df = hours([(s, h, float(h)) for s, n in sizes.items() for h in range(n)]).withColumn("other", -F.col("pm25"))
    found = blocks.sequence_blocks(df, ["pm25", "other"], ["pm25"], block_rows=90)
    got = blocks.block_examples(found, gap=gap)
    want = windows.sequences(df, ["pm25", "other"], ["pm25"], gap=gap)
    rows = [sorted(map(tuple, x.select("station", "timestamp", "row", "x", "y").collect())) for x in (got, want)]
    assert rows[0] == rows[1] and len(rows[0]) == sum(max(0, n - 95) for n in sizes.values())
    assert found.selectExpr("max(size(times))").first()[0] <= 90 + 72
    digest = lambda x, y: {"first": x[:, 0, 1], "total": x.sum(axis=(1, 2)).astype(float), "y0": y[:, 0]}
    cut = blocks.block_examples(found, gap=gap, each=(digest, "first float, total double, y0 float"))
    assert cut.columns == ["station", "timestamp", "row", "first", "total", "y0"]
    assert sorted(map(tuple, cut.collect())) == [(*r[:3], r[3][0][1], sum(v for row in r[3] for v in row), r[4][0]) for r in rows[1]]
    with pytest.raises(ValueError):
        blocks.sequence_blocks(df, ["pm25"], ["pm25"], block_rows=50)


def test_blocks_store_rows_once(spark, hours):
    """Stored bytes are those of the rows, not of the windows."""
    df = hours([(s, h, float((h * 7919) % 1000) + h / 7) for s in "ab" for h in range(6000)])
    names = [f"x{i}" for i in range(20)]
    df = df.withColumns({n: F.col("pm25") * (i + 1) for i, n in enumerate(names)}).withColumns({n: F.col(n).cast("float") for n in names})
    plain, packed = new_path(spark, "plain"), new_path(spark, "packed")
    df.select("station", "timestamp", *names, F.col("pm25").cast("float")).coalesce(1).write.parquet(plain)
    blocks.sequence_blocks(df, names, ["pm25"]).coalesce(1).write.parquet(packed)
    size = [sum(f.stat().st_size for f in Path(p).rglob("*.parquet")) for p in (plain, packed)]
    assert size[1] <= 1.2 * size[0]


def test_last_rows_and_current_value(hours):
    df = hours([("a", h, float(h)) for h in range(80)] + [("b", h, 1.0) for h in range(71)])
    newest = windows.last_n(df, 72)
    assert {r["station"]: r["n"] for r in newest.groupBy("station").agg(
        F.count("*").alias("n"), F.min("pm25").alias("lo")).collect()} == {"a": 72}
    assert windows.last_n(df, 72, require=False).count() == 143
    assert {r["station"]: r["pm25"] for r in windows.current_value(df).collect()} == {
        "a": 79.0, "b": 1.0}


def test_dedupe_prefers_either_source(spark):
    df = spark.createDataFrame(
        [("a", 1, "s", 5.0), ("a", 1, "v", 6.0), ("a", 2, "v", 7.0),
         ("b", 1, "s", 9.0), ("b", 1, "s", 8.0), ("b", 1, "s", 8.0)],
        "station string, timestamp int, src string, pm25 double")

    def run(priority):
        out = windows.dedupe_by_source(df, ["station", "timestamp"], "src", priority)
        return sorted((r.station, r.timestamp, r.pm25) for r in out.collect())
    assert run(["s", "v"]) == [("a", 1, 5.0), ("a", 2, 7.0), ("b", 1, 8.0)]
    assert run(["v", "s"]) == [("a", 1, 6.0), ("a", 2, 7.0), ("b", 1, 8.0)]


def test_densify(hours, spark):
    df = hours([("a", 1, 4.0), ("a", 3, 6.0)])
    keys = spark.createDataFrame([("a",), ("z",)], "station string")
    out = windows.densify_hours(df, keys, F.lit("2024-01-01 00:30:00").cast("timestamp"),
                                F.lit("2024-01-01 03:10:00").cast("timestamp"))
    got = ordered(out)
    assert got["pm25"].tolist() == [0.0, 4.0, 0.0, 6.0, 0.0, 0.0, 0.0, 0.0]
    assert pd.Timestamp("2024-01-01") == got["timestamp"][0]
