"""Feature table by day → sketches of its new days → scales.

    spark-submit --py-files aqspark.zip aqspark/jobs/refresh_scales.py --dataset DIR --sketches DIR --out DIR [--rough]

``--rough`` reads no row of days whose sketches are stored; without it the scales are exact, with one pass over the rows.
"""

import argparse

from pyspark.sql import SparkSession

from aqspark.functions import fixed
from aqspark.operators import sketches
from aqspark.sources import readers
from aqspark.storage import configure, scratch


def run(spark, args):
    rows = readers.read_dataset(spark, args.dataset)
    cols = [c for c in fixed.FEATURES if c in rows.columns]
    with scratch(spark):
        days = sketches.refresh(rows, args.sketches, cols)
        stored = sketches.read_sketches(spark, args.sketches)
        scales = sketches.rough_scales(stored, cols) if args.rough else sketches.stored_scales(rows, stored, cols)
        scales.coalesce(1).write.mode("overwrite").parquet(args.out)
    return days


def arguments(argv=None):
    p = argparse.ArgumentParser()
    p.add_argument("--dataset", required=True)
    p.add_argument("--sketches", required=True)
    p.add_argument("--out", required=True)
    p.add_argument("--rough", action="store_true")
    return p.parse_args(argv)


if __name__ == "__main__":
    run(configure(SparkSession.builder.appName("refresh-scales").getOrCreate()), arguments())
