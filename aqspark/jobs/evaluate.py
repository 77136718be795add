"""Learning rows → errors per horizon of the linear models, beside those of repeating the reading.

    spark-submit --py-files aqspark.zip aqspark/jobs/evaluate.py --learning DIR --out DIR [--horizons N] [--max-iter N]

``--learning`` is what the learning job wrote. Writes ``linear``, ``persistence`` and the fitted ``models``, which the scoring jobs take.
"""

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from aqspark.functions import fixed
from aqspark.operators.metrics import horizon_metrics, target_pairs
from aqspark.operators.scaling import params_on_driver, robust_unscale
from aqspark.plans.linear import fit_linear, predict_linear, write_linear
from aqspark.sources import writers
from aqspark.storage import configure, scratch


def run(spark, args):
    with scratch(spark):
        scaler, _, features = writers.read_params(spark, f"{args.learning}/params")
        params = params_on_driver(scaler)
        rows = spark.read.parquet(f"{args.learning}/rows")
        test = rows.filter("split = 'test'")
        models = fit_linear(rows.filter("split = 'train'"), range(1, args.horizons + 1), features, args.max_iter)
        write_linear(spark, models, f"{args.out}/models", features)
        back = dict.fromkeys(["y_true", "y_pred"], params["target"])
        linear = robust_unscale(predict_linear(models, test, features), back)
        writers.write_metrics(horizon_metrics(linear, round_digits=True), f"{args.out}/linear")
        center, scale = params["pm25"]
        now = F.col("pm25") * scale + center
        naive = robust_unscale(target_pairs(test, lambda h: now, horizons=args.horizons), {"y_true": params["target"]})
        writers.write_metrics(horizon_metrics(naive, round_digits=True), f"{args.out}/persistence")


def arguments(argv=None):
    p = argparse.ArgumentParser()
    for name in ("--learning", "--out"):
        p.add_argument(name, required=True)
    p.add_argument("--horizons", type=int, default=fixed.HORIZONS)
    p.add_argument("--max-iter", type=int, default=50)
    return p.parse_args(argv)


if __name__ == "__main__":
    run(configure(SparkSession.builder.appName("evaluate").getOrCreate()), arguments())
