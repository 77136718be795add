"""Row windows that no single station can overload.

Lags and rolling frames count rows, so a window has to see a station's rows in
order. Instead of handing a whole station to one task, its rows are cut into time
segments of about ``SEGMENT_ROWS`` rows, made of whole months. A segment also gets
copies of the months before and after it that hold the rows its frames reach; the
copies are dropped after the window ran, so the result equals that of one window per
station, however long the gaps are and however many rows the station has.
"""

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from aqspark.storage import materialise

SEGMENT_ROWS = 20_000
HELPERS = ["_month", "_seg", "_own", "_first", "_total"]


def month_counts(df: DataFrame, key: str = "station", ts: str = "timestamp") -> DataFrame:
    """Rows per key and month: all that is needed to cut segments."""
    return df.groupBy(key, F.date_trunc("month", ts).alias("_month")).agg(F.count(F.lit(1)).alias("_n"))


def min_months(months: DataFrame, n: int, key: str = "station") -> DataFrame:
    """The month counts of the stations with at least ``n`` rows."""
    enough = months.groupBy(key).agg(F.sum("_n").alias("_rows")).filter(F.col("_rows") >= n)
    return months.join(enough.select(key), key, "left_semi")


def segment_table(months: DataFrame, key: str, before: int, after: int, rows: int) -> DataFrame:
    """One row per month and segment that needs it; as small as months × stations."""
    station = Window.partitionBy(key)
    in_order = station.orderBy("_month")
    segment = Window.partitionBy(key, "_seg")
    months = (
        months
        .withColumn("_end", F.sum("_n").over(in_order))
        .withColumn("_start", F.col("_end") - F.col("_n"))
        .withColumn("_total", F.sum("_n").over(station))
        .withColumn("_seg", F.floor(F.col("_start") / rows))
        .withColumn("_from", F.min("_start").over(segment))
        .withColumn("_to", F.max("_end").over(segment))
        .withColumn("_segs", F.collect_set(F.struct("_seg", "_from", "_to")).over(station))
    )
    reached = F.filter("_segs", lambda s: (F.col("_end") > s["_from"] - before)
                       & (F.col("_start") < s["_to"] + after))
    return (
        months.withColumn("_into", F.explode(reached))
        .select(key, "_month", "_start", "_total",
                (F.col("_into._seg") == F.col("_seg")).alias("_own"),
                F.col("_into._seg").alias("_seg"))
        .withColumn("_first", F.min("_start").over(segment))
        .drop("_start")
    )


def split_segments(df: DataFrame, before: int = 0, after: int = 0, key: str = "station",
                   ts: str = "timestamp", rows: int = SEGMENT_ROWS,
                   months: DataFrame | None = None) -> DataFrame:
    """Add ``_seg``, ``_own`` (not a copy), ``_first`` (position of the segment's first
    row in its station) and ``_total`` (rows of the station).

    The result is spread by station and segment, which the window needs anyway. Said
    here, Spark cannot take a spread by station alone as good enough. ``months`` are the
    ``month_counts`` of ``df``, where they are known already; rows of stations and months that they lack are left out.
    """
    table = segment_table(month_counts(df, key, ts) if months is None else months, key, before,
                          after, rows)
    # stored, its size is known: where it is small, the rows meet it without a shuffle of their own
    table = materialise(table)
    dated = df.withColumn("_month", F.date_trunc("month", ts))
    return dated.join(table, [key, "_month"]).repartition(key, "_seg")


def segment_window(key: str = "station", ts: str = "timestamp") -> WindowSpec:
    return Window.partitionBy(key, "_seg").orderBy(ts)


def position(w: WindowSpec) -> Column:
    """Zero-based row number inside the station."""
    return F.col("_first") + F.row_number().over(w) - 1


def over_segments(df: DataFrame, columns: Callable[[WindowSpec], Sequence[Column]],
                  before: int = 0, after: int = 0, key: str = "station",
                  ts: str = "timestamp", rows: int = SEGMENT_ROWS,
                  keep: Column | None = None,
                  months: DataFrame | None = None) -> DataFrame:
    """Append row-window columns whose frames reach ``before`` rows back and ``after``
    rows ahead. ``keep`` filters on the new columns and the segment helpers."""
    parts = split_segments(df, before, after, key, ts, rows, months)
    out = parts.select("*", *columns(segment_window(key, ts))).filter("_own")
    if keep is not None:
        out = out.filter(keep)
    return out.drop(*HELPERS)
