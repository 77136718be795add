"""Order-based operators without a global sort in one task."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from aqspark.storage import materialise


def global_index(df: DataFrame, *order) -> DataFrame:
    """Add ``_index``, the zero-based position in ``order``.

    Rows are range-partitioned, then numbered inside each range from the number
    of rows in the ranges before it. The ranges are written once, because a
    re-read must not draw other boundaries.
    """
    ranged = materialise(df.repartitionByRange(*order)
                         .withColumn("_range", F.spark_partition_id()))
    # one row per range
    sizes = ranged.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.orderBy("_range")) - F.col("_n")
    starts = sizes.select("_range", before.alias("_before"))
    inside = F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    return (ranged.join(F.broadcast(starts), "_range")
            .withColumn("_index", F.col("_before") + inside - 1)
            .drop("_range", "_before"))


def station_ids(df: DataFrame, base: int = 1, key="station") -> DataFrame:
    """Dense id over the sorted station names; with base 1 id 0 means unknown."""
    names = df.select(key).filter(F.col(key).isNotNull()).distinct()
    return global_index(names, key).select(
        key, (F.col("_index") + base).cast("int").alias("station_id"))


def chrono_split(df: DataFrame, train=0.70, val=0.15, ts="timestamp",
                 tie="station") -> DataFrame:
    """Add ``split``: the first rows in time are train, the next val, the rest test.

    Cuts fall at exact row counts. Clock hours decide for all their rows from the
    hour counts, of which there are 8,784 a year at most. Only the two hours that a cut
    divides are ranked, by time and station: one row per station in an hourly table.
    """
    by_hour = df.withColumn("_hour", F.date_trunc("hour", ts))
    hours = by_hour.groupBy("_hour").agg(F.count(F.lit(1)).alias("_n"))
    upto = Window.orderBy("_hour")
    everything = Window.partitionBy()
    hours = (hours
             .withColumn("_end", F.sum("_n").over(upto))
             .withColumn("_rows", F.sum("_n").over(everything))
             .withColumn("_start", F.col("_end") - F.col("_n"))
             .withColumn("_cut1", F.floor(F.col("_rows") * F.lit(train)))
             .withColumn("_cut2", F.floor(F.col("_rows") * F.lit(train + val))))

    def label(place):
        return (F.when(place < F.col("_cut1"), "train")
                .when(place < F.col("_cut2"), "val").otherwise("test"))

    hours = hours.select("_hour", "_start", "_cut1", "_cut2",
                         label(F.col("_start")).alias("split"),
                         label(F.col("_end") - 1).alias("_last"))
    # bounded by the calendar, whatever the rows
    placed = by_hour.join(F.broadcast(hours), "_hour")
    whole = placed.filter(F.col("split") == F.col("_last"))
    divided = placed.filter(F.col("split") != F.col("_last"))
    rank = F.row_number().over(Window.partitionBy("_hour").orderBy(ts, tie)) - 1
    divided = divided.withColumn("split", label(F.col("_start") + rank))
    return whole.unionByName(divided).drop("_hour", "_start", "_cut1", "_cut2", "_last")


# --- sampling ------------------------------------------------------------------------

def _draw(keys, seed):
    """Repeatable random order, the same in any engine: a digest of the row's key and the seed."""
    texts = [F.date_format(k, "yyyy-MM-dd HH:mm:ss") if k in ("timestamp", "ts") else F.col(k).cast("string")
             for k in keys]
    return F.md5(F.concat_ws("|", *texts, F.lit(str(seed))).cast("binary"))


def cap_per_key(df: DataFrame, cap: int, seed: int = 42, key="station",
                ts="timestamp") -> DataFrame:
    """At most ``cap`` random rows per station; the cut also happens before the shuffle."""
    w = Window.partitionBy(key).orderBy(_draw([key, ts], seed), ts)
    return (df.withColumn("_rn", F.row_number().over(w))
            .filter(F.col("_rn") <= cap).drop("_rn"))


def cap_for_total(df: DataFrame, total: int, key="station") -> int:
    """Per-station cap that spreads ``total`` rows over the stations."""
    return max(1, total // max(1, df.select(key).distinct().count()))


def _leading(df: DataFrame, n: int, bucket, order) -> DataFrame:
    """The first ``n`` rows in ``order``, which must refine the order of ``bucket``.

    Bucket counts tell which buckets lie wholly before the ``n``-th row: their rows are kept as they
    are. Only the bucket that holds the ``n``-th row is ranked; all other rows go before any two
    tasks exchange rows. There have to be few buckets, and none may be too large to rank.
    """
    marked = df.withColumn("_bucket", bucket)
    counts = marked.groupBy("_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.orderBy("_bucket")) - F.col("_n")
    wanted = counts.withColumn("_rest", F.lit(n) - before).filter(F.col("_rest") > 0)
    kept = marked.join(F.broadcast(wanted), "_bucket")
    whole = kept.filter(F.col("_n") <= F.col("_rest"))
    rank = F.row_number().over(Window.partitionBy("_bucket").orderBy(*order))
    part = kept.filter(F.col("_n") > F.col("_rest")).withColumn("_rank", rank)
    part = part.filter(F.col("_rank") <= F.col("_rest")).drop("_rank")
    return whole.unionByName(part).drop("_bucket", "_n", "_rest")


def sample_rows(df: DataFrame, n: int, keys=("station", "timestamp"),
                seed: int = 42) -> DataFrame:
    """``n`` repeatable random rows: those with the smallest digests."""
    draw = _draw(keys, seed)
    # the first four of its digits: 65,536 buckets in the order of the digest
    return _leading(df, n, F.substring(draw, 1, 4), [draw, *keys])


def epoch_sample(df: DataFrame, n: int, epoch: int,
                 keys=("station", "timestamp")) -> DataFrame:
    """A fresh repeatable sample for every epoch."""
    return sample_rows(df, n, keys, seed=epoch * 1337 + 42)


def scaler_sample(df: DataFrame, n: int, how="random",
                  keys=("station", "timestamp")) -> DataFrame:
    """``n`` rows to fit scalers on: null-free random rows, or the first rows in time.

    The first rows know only the first season; scales from them are biased. ``prepare``
    in ``plans.learning`` uses all training rows instead.
    """
    if how == "first":
        return _leading(df, n, F.date_trunc("hour", "timestamp"), ["timestamp", "station"])
    return sample_rows(df.dropna("any"), n, keys)


def shuffle_rows(df: DataFrame, keys=("station", "timestamp"), seed: int = 42) -> DataFrame:
    """Repeatable random order over all partitions."""
    return df.orderBy(_draw(keys, seed), *keys)


# --- top-k -----------------------------------------------------------------------------

def top_counts(df: DataFrame, key: str, n: int, count="n") -> DataFrame:
    """The ``n`` most frequent values, names breaking ties."""
    counts = df.groupBy(key).agg(F.count(F.lit(1)).alias(count))
    return counts.orderBy(F.desc(count), key).limit(n)


def newest_sensors(stations: DataFrame, n: int = 60) -> DataFrame:
    """Highest sensor ids, each once, with the first station that names it."""
    listed = stations.select("station", "city", F.explode("sensor_ids").alias("sensor_id"))
    once = (listed.filter(F.col("sensor_id").isNotNull())
            .groupBy("sensor_id")
            .agg(F.min(F.struct("station", "city")).alias("_s")))
    return once.select("sensor_id", "_s.*").orderBy(F.desc("sensor_id")).limit(n)


def first_stations(df: DataFrame, n: int = 5) -> DataFrame:
    return df.orderBy("station").limit(n)


def sort_for_storage(df: DataFrame, key="station", ts="timestamp") -> DataFrame:
    """Station and time order inside each file; no global sort."""
    return df.sortWithinPartitions(key, ts)
