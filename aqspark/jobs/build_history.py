"""Archive files → hour means, alone or merged with the hours at hand.

    spark-submit --py-files aqspark.zip aqspark/jobs/build_history.py --archive DIR --registry FILE --out DIR
        [--current DIR] [--start DAY --end DAY] [--cities NAME ...] [--append]

With ``--append`` the hours that the dataset at ``--out`` does not hold yet are added to it, so a run that broke off
is gone on with, and days at hand keep their files.
"""

import argparse

from pyspark.sql import SparkSession

from aqspark.plans.history import build_history, merge_history
from aqspark.sources import readers, writers
from aqspark.storage import configure, scratch


def run(spark, args):
    stations = readers.read_registry(spark, *args.registry)
    archive = readers.read_archive(spark, args.archive, stations, args.start, args.end)
    hours = build_history(archive, stations, args.cities)
    if args.current:
        hours = merge_history(spark.read.parquet(args.current), hours)
    if args.append:
        with scratch(spark):
            writers.append_hours(hours, args.out)
    else:
        writers.write_dataset(hours, args.out)


def arguments(argv=None):
    p = argparse.ArgumentParser()
    p.add_argument("--archive", required=True)
    p.add_argument("--registry", nargs="+", required=True)
    p.add_argument("--out", required=True)
    for name in ("--current", "--start", "--end"):
        p.add_argument(name)
    p.add_argument("--cities", nargs="+")
    p.add_argument("--append", action="store_true")
    return p.parse_args(argv)


if __name__ == "__main__":
    run(configure(SparkSession.builder.appName("build-history").getOrCreate()), arguments())
