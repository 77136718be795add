"""Grouped facts. Every aggregate here is partly computed before its shuffle."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aqspark.functions import fixed
from aqspark.functions.scalars import floor_hour
from aqspark.operators.clean import clip, valid_range


def hourly_mean(df: DataFrame, keys=("station",), ts="timestamp", value="pm25",
                policy="filter_after") -> DataFrame:
    """One row per key and hour.

    ``filter_after`` drops impossible hour means, ``clip_before`` clamps raw
    readings, ``None`` does neither.
    """
    rows = df.filter(F.col(value).isNotNull() & F.col(ts).isNotNull())
    if policy == "clip_before":
        rows = clip(rows, value)
    out = rows.groupBy(*keys, floor_hour(ts).alias("timestamp")).agg(F.avg(value).alias(value))
    return valid_range(out, value) if policy == "filter_after" else out


def copollutant_hours(df: DataFrame, keys=("station",), ts="timestamp",
                      names=fixed.COPOLLUTANTS) -> DataFrame:
    """Long readings (parameter, value) → one column per pollutant and hour.

    Two sensors of one pollutant share a mean; an hour any pollutant has stays.
    """
    known = df.withColumn("parameter", F.lower("parameter")).filter(
        F.col("parameter").isin(list(names)) & F.col("value").isNotNull())
    return (known.groupBy(*keys, floor_hour(ts).alias("timestamp"))
            .pivot("parameter", list(names)).agg(F.avg("value")))


def sensor_coverage(df: DataFrame, sensor="sensor_id", ts="timestamp") -> DataFrame:
    """First and last moment and number of readings per sensor."""
    return df.groupBy(sensor).agg(F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts"),
                                  F.count(F.lit(1)).alias("n"))


def iso_text(ts) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def first_working_sensor(stations: DataFrame, coverage: DataFrame) -> DataFrame:
    """Stations with data, each on its first candidate sensor that has any."""
    tried = stations.select("station", F.posexplode("sensor_ids").alias("_pos", "sensor_id"))
    hit = (tried.join(coverage.select("sensor_id", "first_ts", "last_ts"), "sensor_id")
           .groupBy("station")
           .agg(F.min(F.struct("_pos", "sensor_id", "first_ts", "last_ts")).alias("_hit")))
    rest = [c for c in stations.columns
            if c not in ("sensor_id", "sensor_ids", "data_start", "data_end")]
    return stations.join(hit, "station").select(
        *rest,
        F.col("_hit.sensor_id").alias("sensor_id"),
        F.array("_hit.sensor_id").alias("sensor_ids"),
        iso_text("_hit.first_ts").alias("data_start"),
        iso_text("_hit.last_ts").alias("data_end"))


def stations_per_city(df: DataFrame) -> DataFrame:
    city = F.coalesce("city", F.lit("Unknown")).alias("city")
    return (df.groupBy(city).agg(F.count(F.lit(1)).alias("n"))
            .orderBy(F.desc("n"), "city"))


def city_coverage(df: DataFrame, before="2025") -> DataFrame:
    """Stations, first and last day per city, and whether data predates a year."""
    city = F.coalesce("city", F.lit("Unknown")).alias("city")
    early = F.coalesce(F.substring("data_start", 1, 4) < before, F.lit(False))
    return (df.groupBy(city)
            .agg(F.count(F.lit(1)).alias("n"),
                 F.substring(F.min("data_start"), 1, 10).alias("earliest"),
                 F.substring(F.max("data_end"), 1, 10).alias("latest"),
                 F.max(early.cast("int")).alias("is_early"),
                 F.sum(early.cast("int")).alias("n_early"))
            .orderBy(F.desc("n"), "city"))


def dataset_summary(df: DataFrame, value="pm25") -> DataFrame:
    # distinct stations in two steps: the first has one group per station
    per_station = df.groupBy("station").agg(
        F.count(F.lit(1)).alias("n"), F.min("timestamp").alias("lo_ts"),
        F.max("timestamp").alias("hi_ts"), F.min(value).alias("lo"), F.max(value).alias("hi"))
    return per_station.agg(
        F.sum("n").alias("n_rows"), F.count(F.lit(1)).alias("n_stations"),
        F.min("lo_ts").alias("first_ts"), F.max("hi_ts").alias("last_ts"),
        F.min("lo").alias("min_value"), F.max("hi").alias("max_value"))


def null_audit(df: DataFrame) -> DataFrame:
    """Nulls per column, as rows (field, nulls), from one pass."""
    counts = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns])
    return counts.unpivot([], df.columns, "field", "nulls")


def first_null_row(df: DataFrame, order=("station", "timestamp")) -> DataFrame:
    bad = F.lit(False)
    for c in df.columns:
        bad = bad | F.col(c).isNull()
    return df.filter(bad).orderBy(*order).limit(1)


def signal_means(df: DataFrame, cols=fixed.NEWS_SIGNALS) -> DataFrame:
    return df.agg(*[F.avg(c).alias(c) for c in cols])


def sequence_counts(df: DataFrame, lookback=fixed.LOOKBACK, horizons=fixed.HORIZONS) -> DataFrame:
    """Learning examples per station."""
    n = F.count(F.lit(1)) - lookback - horizons + 1
    return df.groupBy("station").agg(F.greatest(n, F.lit(0)).alias("n_sequences"))


def distinct_stations(df: DataFrame) -> DataFrame:
    return df.select("station").filter(F.col("station").isNotNull()).distinct().orderBy("station")


def all_sensor_ids(primary, listed) -> Column:
    """Primary sensor first, then the others, each once, nulls left out."""
    return F.array_distinct(F.array_compact(
        F.concat(F.array(primary), F.coalesce(listed, F.array().cast("array<bigint>")))))


def distinct_sensors(df: DataFrame) -> DataFrame:
    ids = F.explode(all_sensor_ids(F.col("sensor_id"), F.col("sensor_ids")))
    return df.select(ids.alias("sensor_id")).distinct()
