"""Results of streams in update mode: every batch adds the rows that changed, readers take the newest of each key.

A batch writes one folder, named after it, in overwrite mode. So a batch that runs again after a failure replaces
itself, and no batch reads or rewrites what others wrote.
"""

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from aqspark.storage import materialise, remove, scratch

# batches have even numbers here; a compaction of all up to one has the odd number after it
_STEP = 2


def add_changes(rows: DataFrame, out: str, batch_id: int, fmt="parquet") -> None:
    rows.write.mode("overwrite").format(fmt).save(f"{out}/batch={batch_id * _STEP}")


def changes(spark: SparkSession, out: str, schema=None, fmt="parquet") -> DataFrame:
    """All rows with the number of their batch. With a ``schema``, none if nothing was written yet."""
    if schema is None:
        return spark.read.format(fmt).load(out).withColumn("batch", F.col("batch").cast("long"))
    known = schema if isinstance(schema, T.StructType) else T.StructType.fromDDL(schema)
    known = T.StructType([*known.fields, T.StructField("batch", T.LongType())])
    try:
        return spark.read.schema(known).format(fmt).load(out)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], known)


def latest_rows(spark: SparkSession, out: str, schema=None, fmt="parquet", keys=("station",)) -> DataFrame:
    """What was last written for each key: all rows of the newest batch that has the key."""
    rows = changes(spark, out, schema, fmt)
    newest = rows.groupBy(*keys).agg(F.max("batch").alias("batch"))
    return rows.join(newest, [*keys, "batch"], "left_semi").drop("batch")


def compact(spark: SparkSession, out: str, schema=None, fmt="parquet", keys=("station",)) -> None:
    """Keep only the latest rows: they are written as one folder, then the folders they come from are deleted.

    Between batches of the stream, not during one. Broken off at any point, it leaves the same latest rows.
    """
    numbers = sorted(r[0] for r in changes(spark, out, schema, fmt).select("batch").distinct().collect())
    if len(numbers) < 2:
        return
    merged = numbers[-1] // _STEP * _STEP + 1
    with scratch(spark):
        rows = materialise(latest_rows(spark, out, schema, fmt, keys))
        rows.write.mode("overwrite").format(fmt).save(f"{out}/batch={merged}")
    for number in numbers:
        if number != merged:
            remove(spark, f"{out}/batch={number}")
