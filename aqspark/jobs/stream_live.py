"""Landed readings → newest feature rows or forecast documents of every station, as a stream that goes on.

    spark-submit --py-files aqspark.zip aqspark/jobs/stream_live.py --landing DIR --registry FILE --out DIR --checkpoint DIR
        [--params DIR [--models DIR | --predictor module:function]] [--weather DIR] [--fires DIR] [--history DIR]
        [--every "1 minute"] [--forget-days N] [--compact]

Without --params the feature rows are kept, with it documents. Without --every what has arrived is processed, then the
job ends; --compact first merges what earlier runs wrote.
"""

import argparse
from importlib import import_module

from pyspark.sql import SparkSession

from aqspark.operators.scaling import params_on_driver
from aqspark.plans.forecast import persistence
from aqspark.plans.linear import linear_predictor, read_linear
from aqspark.sources import readers, writers
from aqspark.storage import configure
from aqspark.streaming import streams
from aqspark.streaming.changes import compact

DOCUMENTS = ("station string, current_pm25 double, current_aqi string, data_ts string, forecast map<string, struct<pm25: double, "
             "aqi: string, aqi_color: string, delta: double, confidence: double>>, signals map<string, double>, generated_at string")


def run(spark, args):
    """Returns the running query."""
    readings = readers.stream_readings(spark, args.landing)
    stations = readers.read_registry(spark, *args.registry)
    options = {
        "weather": readers.read_weather(spark, args.weather) if args.weather else None,
        "fires": readers.read_fires(spark, args.fires) if args.fires else None,
        "history": spark.read.parquet(args.history) if args.history else None,
        "silence_ms": args.forget_days * 86_400_000 if args.forget_days else None,
        "trigger": {"processingTime": args.every} if args.every else None}
    if not args.params:
        if args.compact:
            compact(spark, args.out)
        return streams.stream_features(readings, args.out, args.checkpoint, stations, **options)
    if args.compact:
        compact(spark, args.out, DOCUMENTS, "json")
    scaler, ids, features = writers.read_params(spark, args.params)
    params = params_on_driver(scaler)
    if args.models:
        load, target = linear_predictor(read_linear(spark, args.models, features)), params["target"]
    elif args.predictor:
        module, name = args.predictor.split(":")
        load, target = getattr(import_module(module), name), params["target"]
    else:
        load, target = persistence(features.index("pm25")), params["pm25"]
    return streams.stream_score(readings, args.out, args.checkpoint, stations, load, params, target, ids, features, **options)


def arguments(argv=None):
    p = argparse.ArgumentParser()
    for name in ("--landing", "--out", "--checkpoint"):
        p.add_argument(name, required=True)
    p.add_argument("--registry", nargs="+", required=True)
    for name in ("--params", "--models", "--predictor", "--weather", "--fires", "--history", "--every"):
        p.add_argument(name)
    p.add_argument("--forget-days", type=int)
    p.add_argument("--compact", action="store_true")
    return p.parse_args(argv)


if __name__ == "__main__":
    run(configure(SparkSession.builder.appName("stream-live").getOrCreate()), arguments()).awaitTermination()
