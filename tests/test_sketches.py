"""Sketches by day: exact scales from them, refreshing, stale and missing days."""

from datetime import date, timedelta
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from aqspark.jobs import refresh_scales
from aqspark.operators import scaling, sketches
from aqspark.sources.writers import write_dataset

COLS = ["a", "b"]


def stored(spark, path, days, cols=COLS):
    """Write days {number: [(a, b), ...]} as a dataset by day and read it."""
    rows = [(date(2024, 1, 1) + timedelta(days=d), float(a) if a is not None else None, float(b) if b is not None else None)
            for d, values in days.items() for a, b in values]
    df = spark.createDataFrame(rows, "day date, a double, b double")
    write_dataset(df.withColumn("timestamp", F.col("day").cast("timestamp")).drop("day"), path)
    return spark.read.parquet(path)


def wanted(values):
    known = np.array([v for v in values if v is not None and not np.isnan(v)])
    low, center, high = np.quantile(known, [0.25, 0.5, 0.75])
    return center, (high - low) or 1.0


def check(found, rows, cols=COLS):
    assert set(found) == set(cols)
    for i, c in enumerate(cols):
        np.testing.assert_allclose(found[c], wanted([r[i] for r in rows]), rtol=1e-12, err_msg=c)


def files(path):
    return {f: f.stat().st_mtime_ns for f in Path(path).rglob("*.parquet")}


@pytest.mark.parametrize("n", [1, 3, 30_000])
def test_exact_scales_from_sketches(spark, tmp_path, n):
    rng = np.random.default_rng(n)
    days = {d: [(v, None if d == 1 and i % 3 else w) for i, (v, w) in enumerate(zip(
        rng.lognormal(0, 3, n), np.where(rng.random(n) < 0.8, float("nan") if n > 7 and d else 2.5, rng.uniform(-9, 9, n)),
        strict=True))] for d in range(3)}
    df = stored(spark, str(tmp_path / "days"), days)
    path = str(tmp_path / "sketches")
    assert len(sketches.refresh(df, path, COLS)) == 3
    found = scaling.params_on_driver(sketches.stored_scales(df, sketches.read_sketches(spark, path), COLS))
    check(found, [r for values in days.values() for r in values])


def test_sketches_alone_are_near(spark, tmp_path):
    rng = np.random.default_rng(4)
    days = {d: list(zip(rng.normal(d, 4, 8000), rng.uniform(0, 1, 8000), strict=True)) for d in range(3)}
    df = stored(spark, str(tmp_path / "days"), days)
    sketches.refresh(df, str(tmp_path / "sketches"), COLS)
    kept = sketches.read_sketches(spark, str(tmp_path / "sketches"))
    found = scaling.params_on_driver(sketches.rough_scales(kept, COLS))
    rows = [r for values in days.values() for r in values]
    for i, c in enumerate(COLS):
        values = np.sort([r[i] for r in rows])
        assert abs(np.searchsorted(values, found[c][0]) / len(values) - 0.5) < sketches.MARGIN


def test_only_days_that_changed_are_read_and_written(spark, tmp_path):
    data, path = str(tmp_path / "days"), str(tmp_path / "sketches")
    first = {d: [(d + i, i) for i in range(50)] for d in range(4)}
    df = stored(spark, data, first)
    sketches.refresh(df, path, COLS)
    before = files(path)
    assert sketches.refresh(df, path, COLS) == [] and files(path) == before
    # a new day, more rows of day 2, and day 0 is gone
    second = {**first, 2: first[2] + [(1000, 5)], 4: [(7, None)] * 9}
    del second[0]
    df = stored(spark, str(tmp_path / "later"), second)
    days = sketches.refresh(df, path, COLS)
    assert days == [date(2024, 1, 1), date(2024, 1, 3), date(2024, 1, 5)]
    after = files(path)
    untouched = {f: t for f, t in before.items() if "2024-01-02" in str(f) or "2024-01-04" in str(f)}
    assert untouched and all(after[f] == t for f, t in untouched.items())
    assert not any(f in after for f in before if "2024-01-03" in str(f))
    kept = sketches.read_sketches(spark, path)
    check(scaling.params_on_driver(sketches.stored_scales(df, kept, COLS)), [r for v in second.values() for r in v])
    assert sketches.refresh(df, path, COLS) == []
    # another column makes every day due
    more = df.withColumn("c", F.lit(1.0))
    assert len(sketches.refresh(more, path, [*COLS, "c"])) == 5


def test_stale_sketches_change_no_exact_scale(spark, tmp_path):
    rng = np.random.default_rng(9)
    old = {0: [(v, 3 * v) for v in rng.uniform(0, 1, 5000)]}
    new = {0: [(v + 100, -v) for v in rng.uniform(0, 1, 5000)]}
    path = str(tmp_path / "sketches")
    sketches.refresh(stored(spark, str(tmp_path / "old"), old), path, COLS)
    df = stored(spark, str(tmp_path / "new"), new)
    # as many rows as before, so the day is not due
    assert sketches.refresh(df, path, COLS) == []
    kept = sketches.read_sketches(spark, path)
    check(scaling.params_on_driver(sketches.stored_scales(df, kept, COLS)), new[0])
    # fewer and more rows than the sketches stand for
    for part in (new[0][:1200], new[0] * 2):
        other = stored(spark, str(tmp_path / f"part{len(part)}"), {0: part})
        check(scaling.params_on_driver(sketches.stored_scales(other, kept, COLS)), part)


def test_unknown_columns_and_empty_tables(spark, tmp_path):
    df = stored(spark, str(tmp_path / "days"), {0: [(1, None), (3, float("nan"))]})
    path = str(tmp_path / "sketches")
    sketches.refresh(df, path, COLS)
    kept = sketches.read_sketches(spark, path)
    for found in (sketches.stored_scales(df, kept, COLS), sketches.rough_scales(kept, COLS)):
        assert [r["feature"] for r in found.collect()] == ["a"]
    none = df.filter("false")
    assert sketches.refresh(none, str(tmp_path / "none"), COLS) == []
    empty = sketches.read_sketches(spark, str(tmp_path / "none"))
    assert sketches.stored_scales(none, empty, COLS).count() == 0
    assert sketches.rough_scales(empty, COLS).count() == 0
    # without any sketch the scales are exact all the same
    check(scaling.params_on_driver(sketches.stored_scales(df, empty, ["a"])), [(1.0,), (3.0,)], ["a"])


def test_job(spark, tmp_path):
    hours = spark.range(24 * 10).select(
        F.lit("a").alias("station"), F.expr("timestampadd(HOUR, id, timestamp'2024-01-01')").alias("timestamp"),
        (F.col("id") * 7 % 31).cast("double").alias("pm25"))
    rows = hours.withColumns({f"target_{h}h": F.col("pm25") for h in range(1, 25)})
    data = str(tmp_path / "days")
    write_dataset(rows.filter("day(timestamp) < 8"), data)
    args = refresh_scales.arguments(["--dataset", data, "--sketches", str(tmp_path / "s"), "--out", str(tmp_path / "o")])
    assert len(refresh_scales.run(spark, args)) == 7
    write_dataset(rows.filter("day(timestamp) >= 8"), data, mode="append")
    assert [d.day for d in refresh_scales.run(spark, args)] == [8, 9, 10]
    found = scaling.params_on_driver(spark.read.parquet(str(tmp_path / "o")))
    values = [i * 7 % 31 for i in range(240)]
    np.testing.assert_allclose(found["pm25"], wanted(values))
