"""Discovered locations → registry of stations that deliver.

    spark-submit --py-files aqspark.zip aqspark/jobs/build_registry.py --locations DIR --measurements DIR --out DIR
        [--cities NAME ...]

Writes ``registry`` (labelled, screened, clean) and ``dropped`` (with the reason).
"""

import argparse

from pyspark.sql import SparkSession

from aqspark.operators.aggregate import sensor_coverage
from aqspark.plans.registry import build_registry, clean_stations, label_cities, screen_stations
from aqspark.sources import dims, readers, writers
from aqspark.storage import configure, materialise, scratch


def run(spark, args):
    with scratch(spark):
        found = build_registry(readers.read_locations(spark, args.locations))
        labelled = label_cities(found, dims.cities(spark))
        readings = readers.read_hourly_measurements(spark, args.measurements)
        stations = materialise(screen_stations(labelled, sensor_coverage(readings, ts="ts"), args.cities))
        kept, dropped = clean_stations(stations)
        writers.write_registry(kept, f"{args.out}/registry")
        writers.write_registry(dropped, f"{args.out}/dropped")


def arguments(argv=None):
    p = argparse.ArgumentParser()
    for name in ("--locations", "--measurements", "--out"):
        p.add_argument(name, required=True)
    p.add_argument("--cities", nargs="+")
    return p.parse_args(argv)


if __name__ == "__main__":
    run(configure(SparkSession.builder.appName("build-registry").getOrCreate()), arguments())
