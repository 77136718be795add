"""Feature table and parameters → forecast documents of all (or matching) stations.

    spark-submit --py-files aqspark.zip aqspark/jobs/score_dataset.py --dataset DIR --params DIR --out DIR
        [--models DIR | --predictor module:function] [--station TEXT] [--since DAY]

``--models`` are those that the evaluation job keeps. The function loads a predictor; without either the last reading is repeated.
"""

import argparse
from importlib import import_module

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from aqspark.operators.scaling import params_on_driver
from aqspark.plans.forecast import persistence, score
from aqspark.plans.linear import linear_predictor, read_linear
from aqspark.sources import readers, writers
from aqspark.storage import configure


def run(spark, args):
    scaler, ids, features = writers.read_params(spark, args.params)
    params = params_on_driver(scaler)
    if args.models:
        load = linear_predictor(read_linear(spark, args.models, features))
    elif args.predictor:
        module, name = args.predictor.split(":")
        load = getattr(import_module(module), name)
    else:
        load = persistence(features.index("pm25"))
    rows = readers.read_live(spark, args.dataset)
    if args.station:
        rows = rows.filter(F.lower("station").contains(args.station.lower()))
    # persistence works on scaled readings, whose scale is not that of the targets
    target = params["target"] if args.models or args.predictor else params["pm25"]
    documents = score(rows, load, params, target, ids, features, args.since)
    writers.write_forecast(documents, args.out)


def arguments(argv=None):
    p = argparse.ArgumentParser()
    for name in ("--dataset", "--params", "--out"):
        p.add_argument(name, required=True)
    for name in ("--models", "--predictor", "--station", "--since"):
        p.add_argument(name)
    return p.parse_args(argv)


if __name__ == "__main__":
    run(configure(SparkSession.builder.appName("score-dataset").getOrCreate()), arguments())
