"""Writers of tables and documents, and the tables that stand for model state."""

from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, StructField, StructType

from aqspark.functions import fixed
from aqspark.operators.joins import not_yet_done
from aqspark.sources import schemas
from aqspark.storage import materialise


def write_dataset(df: DataFrame, path, mode="overwrite", ts="timestamp") -> None:
    """Parquet by day, in station order inside each file.

    Rows are brought together by day; adaptive execution joins small days and splits full ones
    by size, so files follow the data and no day has to pass through a single task.
    """
    dated = df.withColumn("date", F.to_date(ts)).hint("rebalance", F.col("date"))
    if "station" in df.columns:
        dated = dated.sortWithinPartitions("date", "station", ts)
    dated.write.mode(mode).partitionBy("date").parquet(path)


def write_registry(df: DataFrame, path, mode="overwrite") -> None:
    df.write.mode(mode).json(path)


def dataset_meta(df: DataFrame) -> DataFrame:
    """Columns, stations and date range of a dataset, as one row."""
    facts = df.groupBy("station").agg(F.min("timestamp").alias("lo"),
                                      F.max("timestamp").alias("hi"))
    facts = facts.agg(F.count(F.lit(1)).alias("n_stations"),
                      F.array(F.min("lo").cast("string"), F.max("hi").cast("string"))
                      .alias("date_range"))

    def names(cols):
        return F.array(*[F.lit(c) for c in cols])

    return facts.select(
        F.lit("station").alias("station_col"), names(fixed.TARGETS).alias("target_cols"),
        names(fixed.FEATURES).alias("feature_cols"), names(df.columns).alias("all_columns"),
        "n_stations", "date_range", F.current_timestamp().cast("string").alias("built_at"))


def write_dataset_meta(df: DataFrame, path) -> None:
    dataset_meta(df).write.mode("overwrite").json(path)


def metrics_document(metrics: DataFrame) -> DataFrame:
    """Metric rows keyed as in the published document: ``t+1h``, ``t+2h``, …"""
    return metrics.select(F.format_string("t+%dh", F.col("horizon").cast("int")).alias("horizon"),
                          "mae", "rmse", "r2")


def write_metrics(metrics: DataFrame, path) -> None:
    metrics_document(metrics).write.mode("overwrite").json(path)


def write_forecast(documents: DataFrame, path, mode="overwrite") -> None:
    """One JSON document per line."""
    documents.select(F.to_json(F.struct("*")).alias("value")).write.mode(mode).text(path)


def write_params(path, scaler: DataFrame, ids: DataFrame, features) -> None:
    """Scaler, station ids and feature order as three tables."""
    spark = scaler.sparkSession
    scaler.write.mode("overwrite").parquet(f"{path}/scaler")
    ids.write.mode("overwrite").parquet(f"{path}/station_ids")
    order = spark.createDataFrame(list(enumerate(features)), "ord int, feature string")
    order.write.mode("overwrite").parquet(f"{path}/features")


def read_params(spark: SparkSession, path) -> tuple[DataFrame, DataFrame, list[str]]:
    """(scaler, station ids, ordered feature names)."""
    scaler = spark.read.schema(schemas.PARAMS).parquet(f"{path}/scaler")
    ids = spark.read.schema("station string, station_id int").parquet(f"{path}/station_ids")
    order = spark.read.parquet(f"{path}/features").orderBy("ord").collect()
    return scaler, ids, [r["feature"] for r in order]


def append_new(df: DataFrame, path, key="station") -> None:
    """Append the rows of stations that the table at ``path`` does not hold yet."""
    spark = df.sparkSession
    try:
        done = spark.read.parquet(path).select(key)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        done = None
    fresh = df if done is None else not_yet_done(df, done, key)
    fresh.write.mode("append").parquet(path)


def missing_hours(df: DataFrame, path, keys=("station", "timestamp"), ts="timestamp") -> DataFrame:
    """The rows whose keys the dataset by day at ``path`` does not hold.

    Of the stored dataset only the keys are read, and only in the folders of the days that occur in ``df``.
    Repeated rows of one key give the one with the least values; a null key is a key like any other.
    """
    spark = df.sparkSession
    others = [c for c in df.columns if c not in keys]
    rows = df.groupBy(*keys).agg(F.min(F.struct(*others)).alias("_row")) if others else df.distinct()
    rows = materialise(rows.select(*keys, "_row.*") if others else rows).select(*df.columns)
    # as many as the calendar has
    days = [r["day"] for r in rows.select(F.to_date(ts).alias("day")).distinct().collect()]
    schema = StructType([rows.schema[k] for k in keys] + [StructField("date", DateType())])
    try:
        stored = spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return rows
    wanted = F.col("date").isin([d for d in days if d is not None])
    stored = stored.where(wanted | F.col("date").isNull() if None in days else wanted)
    stored = stored.select(*[F.col(k).alias(f"_{k}") for k in keys])
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys])
    return rows.join(stored, same, "left_anti")


def append_hours(df: DataFrame, path, keys=("station", "timestamp"), ts="timestamp") -> None:
    """Add to a dataset by day the rows whose keys it does not hold yet.

    A station stored in part gets its other hours, and a run that broke off is completed by the next one, whatever
    part of its files came to be seen. No stored file is written again.
    """
    write_dataset(missing_hours(df, path, keys, ts), path, mode="append", ts=ts)
