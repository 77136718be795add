import numpy as np
import pytest
from pyspark.sql import functions as F

from aqspark.operators import ranks, scaling


def test_split_cuts_inside_a_tied_hour(hours):
    # ten rows, cuts after 7 and 8, both inside the third hour
    df = hours([(f"s{i}", h, float(i)) for i, h in
                [(0, 0), (1, 0), (2, 0), (0, 1), (1, 1), (2, 1),
                 (0, 2), (1, 2), (2, 2), (3, 2)]])
    out = ranks.chrono_split(df)
    got = {(r.station, r.timestamp.hour): r.split for r in out.collect()}
    assert [got[("s0", 2)], got[("s1", 2)], got[("s2", 2)]] == ["train", "val", "test"]
    assert sorted(got.values()) == ["test"] * 2 + ["train"] * 7 + ["val"]


@pytest.mark.parametrize("n", [1, 3, 7, 100])
def test_split_sizes(hours, n):
    df = hours([(f"s{i % 4}", i // 4, 1.0) for i in range(n)])
    sizes = {r.split: r.n for r in ranks.chrono_split(df).groupBy("split").agg(
        F.count("*").alias("n")).collect()}
    assert sizes.get("train", 0) == int(n * 0.70)
    assert sizes.get("val", 0) == int(n * (0.70 + 0.15)) - int(n * 0.70)
    assert sum(sizes.values()) == n


def test_station_ids(spark):
    names = spark.createDataFrame([(f"st_{i % 50}",) for i in range(300)], "station string")
    for base in (0, 1):
        got = {r.station: r.station_id for r in ranks.station_ids(names, base).collect()}
        assert got == {s: i + base for i, s in enumerate(sorted(got))}
        assert len(got) == 50


def test_caps_and_samples_repeat(hours):
    df = hours([("hot", h, 1.0) for h in range(200)] + [("b", h, 1.0) for h in range(3)])
    first = ranks.cap_per_key(df, 20, seed=5)
    assert {r.station: r["count"] for r in first.groupBy("station").count().collect()} == {
        "hot": 20, "b": 3}
    rows = set(first.collect())
    assert rows == set(ranks.cap_per_key(df.repartition(7), 20, seed=5).collect())
    assert rows != set(ranks.cap_per_key(df, 20, seed=6).collect())
    one, two = (set(ranks.epoch_sample(df, 50, e).collect()) for e in (1, 2))
    assert len(one) == len(two) == 50 and one != two
    assert ranks.cap_for_total(df, 100) == 50 and ranks.cap_for_total(df, 1) == 1
    assert set(ranks.shuffle_rows(df).collect()) == set(df.collect())


@pytest.mark.parametrize("draw", ["uniform", "mostly_zero", "constant", "two", "lognormal", "ties"])
@pytest.mark.parametrize("n", [1, 2, 3, 5, 8, 997])
def test_exact_quantiles(spark, draw, n):
    rng = np.random.default_rng(n)
    values = {"uniform": rng.uniform(-5, 5, n), "mostly_zero": (rng.random(n) > 0.9) * 10.0,
              "constant": np.full(n, 3.5), "two": rng.integers(0, 2, n).astype(float),
              "lognormal": rng.lognormal(0, 3, n),
              "ties": rng.integers(0, 4, n) / 4.0}[draw]
    long = spark.createDataFrame([("f", float(v)) for v in values], "feature string, value double")
    probs = [0.0, 0.25, 0.5, 0.75, 0.9, 1.0]
    got = {r.p: r.quantile for r in scaling.exact_quantiles(long, probs).collect()}
    np.testing.assert_allclose([got[p] for p in probs], np.quantile(values, probs), rtol=1e-12)


def test_exact_quantiles_of_many_rows(spark):
    long = spark.range(300_000).select(
        F.lit("f").alias("feature"),
        F.when(F.col("id") % 3 == 0, 7.0).otherwise(F.rand(3) * 100).alias("value")).cache()
    got = {r.p: r.quantile for r in scaling.exact_quantiles(long, [0.25, 0.5, 0.75]).collect()}
    want = long.agg(F.percentile("value", F.array(*[F.lit(p) for p in (.25, .5, .75)]))).first()[0]
    np.testing.assert_allclose([got[p] for p in (.25, .5, .75)], want, rtol=1e-12)


def test_robust_params(spark):
    df = spark.createDataFrame([(float(v), 2.0, None if v else 1.0)
                                for v in (0, 0, 0, 0, 10)], "a double, b double, c double")
    params = scaling.params_on_driver(scaling.fit_robust(df, ["a", "b", "c"]))
    assert params == {"a": (0.0, 1.0), "b": (2.0, 1.0), "c": (1.0, 1.0)}
    back = scaling.robust_unscale(scaling.robust_scale(df, params), params)
    assert sorted(r.a for r in back.collect()) == [0.0, 0.0, 0.0, 0.0, 10.0]
    rough = scaling.params_on_driver(scaling.fit_robust(df, ["a"], approx=True))
    assert rough == {"a": (0.0, 1.0)}


def test_few_values_are_ranked_in_one_task(spark):
    """However many values a bracket holds, only those of a slot or two are ranked."""
    long = spark.range(2_000_000).select(F.lit("f").alias("feature"), (F.rand(5) * 1000).alias("value"))
    probs = [0.25, 0.5, 0.75]
    out = scaling.exact_quantiles(long, probs)
    got = {r.p: r.quantile for r in out.collect()}
    want = long.agg(F.percentile("value", F.array(*[F.lit(p) for p in probs]))).first()[0]
    np.testing.assert_allclose([got[p] for p in probs], want, rtol=1e-12)
    inside = long.join(spark.createDataFrame([(p, got[p]) for p in probs], "p double, q double")).filter(
        F.abs(F.col("value") - F.col("q")) < 1000 * scaling.MARGIN / scaling.SLOTS).groupBy("p").count()
    assert max(r["count"] for r in inside.collect()) < 100


def test_quantiles_of_columns(spark):
    """Only values inside the brackets become rows; unknown ones do not count, NaN is above all, columns of one feature are pooled."""
    n = 40_000
    df = spark.range(n, numPartitions=3).select(
        (F.rand(7) * 100).alias("a"), F.when(F.col("id") % 4 != 0, F.lit(2.5)).alias("b"),
        F.when(F.col("id") % 10 == 0, F.lit(float("nan"))).otherwise(-F.rand(8)).alias("c"), F.lit(None).cast("double").alias("d")).cache()
    probs = [0.0, 0.25, 0.5, 0.75, 1.0]
    for names in (["a", "b", "c", "d"], ["one", "one", "c", "d"]):
        long = scaling._long(df, names)
        want = {(r.feature, r.p): r.quantile for r in scaling.exact_quantiles(long, probs).collect()}
        got = {(r.feature, r.p): r.quantile for r in scaling.column_quantiles(df, names, probs).collect()}
        assert {k for k, _ in got} == set(names) - {"d"}
        np.testing.assert_equal(got, want)
    bounds = scaling._brackets(scaling._long(df, ["a", "b", "c", "d"]).filter("value is not null"), probs, "feature", "value")
    zones = scaling.column_zones(df, ["a", "b", "c", "d"], bounds)
    assert zones.agg(F.sum("_c")).first()[0] == 2 * n + n * 3 // 4
    assert zones.count() < n * 2 * len(probs) * 2 * scaling.MARGIN + 50


def test_samples_keep_whole_buckets_and_part_of_one(spark, hours):
    df = hours([(f"s{i}", h, float(i)) for i in range(20) for h in range(50)])
    for n in (1, 37, 999, 1000, 5000):
        drawn = ranks.sample_rows(df, n)
        assert drawn.count() == min(n, 1000) and drawn.distinct().count() == min(n, 1000)
    first = ranks.scaler_sample(df, 30, how="first")
    assert sorted((r.timestamp.hour, r.station) for r in first.collect()) == sorted(
        (h, f"s{i}") for h in range(2) for i in range(20))[:20] + sorted((1, f"s{i}") for i in range(20))[:10]
