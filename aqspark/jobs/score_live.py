"""Latest readings → forecast documents, without a stored feature table.

    spark-submit --py-files aqspark.zip aqspark/jobs/score_live.py --measurements DIR --registry FILE --params DIR
        --out DIR [--weather DIR] [--fires DIR] [--articles DIR] [--models DIR | --predictor module:function]

The readings should reach back twice 72 hours: a window and its longest lag.
"""

import argparse
from importlib import import_module

from pyspark.sql import SparkSession

from aqspark.jobs.build_dataset import city_news, station_readings
from aqspark.operators.aggregate import hourly_mean
from aqspark.operators.scaling import params_on_driver
from aqspark.plans.features import live_window
from aqspark.plans.forecast import persistence, score
from aqspark.plans.linear import linear_predictor, read_linear
from aqspark.sources import readers, writers
from aqspark.storage import configure, materialise, scratch


def run(spark, args):
    with scratch(spark):
        scaler, ids, features = writers.read_params(spark, args.params)
        params = params_on_driver(scaler)
        stations = readers.read_registry(spark, *args.registry)
        hours = materialise(hourly_mean(station_readings(
            readers.read_hourly_measurements(spark, args.measurements), stations), ts="ts"))
        weather = readers.read_weather(spark, args.weather) if args.weather else None
        fires = readers.read_fires(spark, args.fires) if args.fires else None
        news = city_news(spark, args.articles, hours) if args.articles else None
        window = live_window(hours, stations, weather, fires, news)
        if args.models:
            load, target = linear_predictor(read_linear(spark, args.models, features)), params["target"]
        elif args.predictor:
            module, name = args.predictor.split(":")
            load, target = getattr(import_module(module), name), params["target"]
        else:
            # persistence works on scaled readings, whose scale is not that of the targets
            load, target = persistence(features.index("pm25")), params["pm25"]
        writers.write_forecast(score(window, load, params, target, ids, features), args.out)


def arguments(argv=None):
    p = argparse.ArgumentParser()
    for name in ("--measurements", "--params", "--out"):
        p.add_argument(name, required=True)
    p.add_argument("--registry", nargs="+", required=True)
    for name in ("--weather", "--fires", "--articles", "--models", "--predictor"):
        p.add_argument(name)
    return p.parse_args(argv)


if __name__ == "__main__":
    run(configure(SparkSession.builder.appName("score-live").getOrCreate()), arguments())
