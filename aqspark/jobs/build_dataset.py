"""Landed documents → feature table.

    spark-submit --py-files aqspark.zip aqspark/jobs/build_dataset.py --measurements DIR --registry FILE
        --weather DIR --fires DIR --out DIR [--archive DIR] [--pollutants DIR] [--articles DIR]
        [--start DAY --end DAY] [--cities NAME ...]
"""

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from aqspark.operators.aggregate import all_sensor_ids, copollutant_hours, hourly_mean
from aqspark.operators.clean import effective_start
from aqspark.plans.features import build_dataset
from aqspark.plans.history import build_history, merge_history
from aqspark.plans.news import news_hours
from aqspark.sources import dims, readers, writers
from aqspark.storage import configure, materialise, scratch


def station_readings(measurements, stations):
    """Readings of each station's sensors, as (station, ts, pm25)."""
    ids = all_sensor_ids(F.col("sensor_id"), F.col("sensor_ids"))
    sensors = stations.select("station", F.explode(ids).alias("sensor_id"))
    return measurements.join(sensors, "sensor_id").select(
        "station", "ts", F.col("value").alias("pm25"))


def pollutant_hours(spark, path, stations):
    """Hour means of the co-pollutants of every station."""
    places = stations.filter("location_id is not null").select("location_id", "station")
    rows = readers.read_parameter_measurements(spark, path).join(places, "location_id")
    return copollutant_hours(rows, ts="ts")


def city_news(spark, path, hours):
    """News signals of every hour that the readings cover."""
    first, last = hours.agg(F.min("timestamp"), F.max("timestamp")).first()
    if first is None:
        return None
    return news_hours(readers.read_articles(spark, path), dims.news_cities(spark), F.lit(first), F.lit(last))


def run(spark, args):
    with scratch(spark):
        stations = readers.read_registry(spark, *args.registry)
        readings = station_readings(
            readers.read_hourly_measurements(spark, args.measurements), stations)
        if args.start:
            readings = effective_start(readings, stations, args.start, ts="ts")
        if args.end:
            readings = readings.filter(F.to_date("ts") <= F.lit(args.end).cast("date"))
        hours = hourly_mean(readings, ts="ts")
        if args.archive:
            archive = readers.read_archive(spark, args.archive, stations, args.start, args.end)
            hours = merge_history(hours, build_history(archive, stations))
        # gates, windows and counts all start from the hour means
        hours = materialise(hours)
        weather = readers.read_weather(spark, args.weather) if args.weather else None
        fires = readers.read_fires(spark, args.fires) if args.fires else None
        gases = pollutant_hours(spark, args.pollutants, stations) if args.pollutants else None
        news = city_news(spark, args.articles, hours) if args.articles else None
        dataset = build_dataset(hours, stations, weather, fires, gases, news, cities=args.cities)
        writers.write_dataset(dataset, f"{args.out}/rows")
    writers.write_dataset_meta(spark.read.parquet(f"{args.out}/rows"), f"{args.out}/meta")


def arguments(argv=None):
    p = argparse.ArgumentParser()
    p.add_argument("--measurements", required=True)
    p.add_argument("--registry", nargs="+", required=True)
    p.add_argument("--out", required=True)
    for name in ("--weather", "--fires", "--archive", "--pollutants", "--articles", "--start",
                 "--end"):
        p.add_argument(name)
    p.add_argument("--cities", nargs="+")
    return p.parse_args(argv)


if __name__ == "__main__":
    run(configure(SparkSession.builder.appName("build-dataset").getOrCreate()), arguments())
