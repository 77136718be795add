"""The linear fits against those of Spark's own library, and what becomes of kept models."""

import numpy as np
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import LinearRegression
from pyspark.sql import functions as F

from aqspark.functions import fixed
from aqspark.plans import linear
from aqspark.plans.linear import fit_linear, linear_predictor, plain_sums, predict_linear, read_linear, write_linear
from aqspark.storage import new_path

NAMES = ["a", "b", "c", "flat"]


@pytest.fixture(scope="module")
def rows(spark):
    """Two targets with a few gross errors; one feature is constant, one lies far from 0."""
    random = np.random.default_rng(7)
    x = random.normal(size=(1200, 3)) * [1, 5, 0.1] + [0, 0, 40]
    noise = random.normal(size=(1200, 2)) * 0.3
    noise[random.random(1200) < 0.08] += 25
    y = x @ np.array([[2, -1], [0.5, 0.1], [3, -4]]) + [1, 9] + noise
    data = [(f"s{i % 3}", i, *map(float, x[i]), 7.0, *map(float, y[i])) for i in range(1200)]
    data += [("s0", 2000, None, 1.0, 1.0, 7.0, 1.0, 1.0), ("s0", 2001, 1.0, 1.0, 1.0, 7.0, None, 1.0), ("s0", 2002, 1.0, float("nan"), 1.0, 7.0, 1.0, 1.0)]
    return spark.createDataFrame(data, "station string, i int, a double, b double, c double, flat double, target_1h double, target_2h double"
                                 ).withColumn("timestamp", F.timestamp_seconds(F.col("i") * 3600)).repartition(5)


@pytest.mark.parametrize("ridge", [0.0, 0.05])
def test_robust_fit_equals_that_of_the_library(rows, ridge):
    mine = fit_linear(rows, [1, 2], NAMES, ridge=ridge, max_iter=200, tolerance=1e-9)
    table = VectorAssembler(inputCols=NAMES, outputCol="x", handleInvalid="skip").transform(rows.dropna().filter("NOT isnan(b)"))
    for h in (1, 2):
        theirs = LinearRegression(featuresCol="x", labelCol=f"target_{h}h", loss="huber", maxIter=500, tol=1e-10, regParam=ridge).fit(table)
        assert mine[h].coefficients.tolist() == pytest.approx(theirs.coefficients.toArray().tolist(), abs=2e-3)
        assert mine[h].intercept == pytest.approx(theirs.intercept, abs=0.08)
        assert mine[h].scale == pytest.approx(theirs.scale, rel=1e-3)
        assert mine[h].coefficients[3] == 0.0


def test_least_squares(rows):
    mine = fit_linear(rows, [2], NAMES, loss="squaredError", ridge=0.0)[2]
    known = np.array(rows.dropna(subset=["a", "b", "c", "target_2h"]).filter("NOT isnan(b)").select("a", "b", "c", "target_2h").collect())
    want = np.linalg.lstsq(np.column_stack([np.ones(len(known)), known[:, :3]]), known[:, 3], rcond=None)[0]
    assert [mine.intercept, *mine.coefficients[:3]] == pytest.approx(want.tolist(), rel=1e-7)
    with pytest.raises(ValueError):
        fit_linear(rows, [1], NAMES, loss="absolute")
    with pytest.raises(ValueError):
        fit_linear(rows.limit(0), [1], NAMES)


def test_errors_do_not_bend_the_robust_fit(rows):
    robust, plain = (fit_linear(rows, [1], NAMES, loss=loss, ridge=0.0)[1] for loss in ("huber", "squaredError"))
    assert robust.coefficients[:2] == pytest.approx([2, 0.5], abs=0.03)
    assert abs(plain.intercept - 1) > abs(robust.intercept - 1)


def test_tasks_send_sums_only(spark):
    """However many rows a task has, it sends one array per horizon."""
    table = spark.range(40_000).select(F.col("id").cast("double").alias("c0"), (F.col("id") * 2.0).alias("c1"))
    sums = plain_sums(table, 1, 1)
    n = 40_000
    assert sums[-1].reshape(2, 2)[0].tolist() == [n, n * (n - 1) / 2]
    assert sums[0][0] == n * (n - 1)


def test_kept_models_score_alike(spark, rows):
    models = fit_linear(rows, [1, 2], NAMES)
    path = new_path(spark, "models")
    write_linear(spark, models, path, NAMES)
    again = read_linear(spark, path, ["c", "a", "b", "new"])
    assert again[2].intercept == models[2].intercept and again[1].scale == models[1].scale
    assert again[2].coefficients.tolist() == [*models[2].coefficients[[2, 0, 1]], 0.0]
    one = rows.filter("i = 5").first()
    window = np.zeros((1, 72, 4), dtype=np.float32)
    window[0, -1] = [one["c"], one["a"], one["b"], 3.0]
    got = linear_predictor(again)()(window, None)[0]
    pairs = {r["horizon"]: r["y_pred"] for r in predict_linear(models, rows.filter("i = 5"), NAMES).collect()}
    assert got[:2].tolist() == pytest.approx([pairs[1], pairs[2]], abs=1e-4)
    assert len(got) == fixed.HORIZONS and set(got[2:]) == {got[1]}


def test_stored_rows_are_not_written_again_and_columns_go_with_the_pairs(rows, monkeypatch):
    wanted = fit_linear(rows, [1, 2], NAMES)

    def written(df):
        raise AssertionError("written again")
    monkeypatch.setattr(linear, "materialise", written)
    models = fit_linear(rows, [1, 2], NAMES, stored=True)
    for h in (1, 2):
        assert models[h].coefficients.tolist() == pytest.approx(wanted[h].coefficients.tolist())
    known = rows.dropna()
    pairs = predict_linear(models, known, NAMES, keep=["b"])
    assert pairs.columns == ["station", "timestamp", "b", "horizon", "y_true", "y_pred"]
    plain = predict_linear(models, known, NAMES)
    assert sorted(map(str, pairs.drop("b").collect())) == sorted(map(str, plain.collect()))
    assert {(r["i"], r["b"]) for r in known.collect()} == {(int(r["timestamp"].timestamp()) // 3600, r["b"]) for r in pairs.collect()}
