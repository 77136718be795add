"""Feature table → learning rows, scales, station ids and, if asked, example arrays.

    spark-submit --py-files aqspark.zip aqspark/jobs/prepare_learning.py --dataset DIR --out DIR
        [--blocks] [--sequences] [--max-rows N] [--gap 0|1]

``--blocks`` stores all examples, each row once (``operators.blocks``); ``--sequences`` writes the arrays of each, for samples.
"""

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from aqspark.functions import fixed
from aqspark.plans.learning import learning_blocks, learning_sequences, prepare
from aqspark.sources import readers, writers
from aqspark.storage import configure


def run(spark, args):
    found = prepare(readers.read_dataset(spark, args.dataset))
    writers.write_params(f"{args.out}/params", found.scaler, found.ids, fixed.FEATURES)
    found.rows.write.mode("overwrite").partitionBy("split").parquet(f"{args.out}/rows")
    if args.blocks:
        rows = spark.read.parquet(f"{args.out}/rows")
        learning_blocks(rows).write.mode("overwrite").partitionBy("split").parquet(f"{args.out}/blocks")
    if args.sequences:
        rows = spark.read.parquet(f"{args.out}/rows")
        for split in ("train", "val", "test"):
            part = rows.filter(F.col("split") == split)
            cap = args.max_rows if split == "train" else 0
            learning_sequences(part, max_rows=cap, gap=args.gap).write.mode(
                "overwrite").parquet(f"{args.out}/sequences/{split}")


def arguments(argv=None):
    p = argparse.ArgumentParser()
    p.add_argument("--dataset", required=True)
    p.add_argument("--out", required=True)
    p.add_argument("--blocks", action="store_true")
    p.add_argument("--sequences", action="store_true")
    p.add_argument("--max-rows", type=int, default=0)
    p.add_argument("--gap", type=int, choices=(0, 1), default=1)
    return p.parse_args(argv)


if __name__ == "__main__":
    run(configure(SparkSession.builder.appName("prepare-learning").getOrCreate()), arguments())
