"""Row-based time-series operators, each over one row per station and hour."""

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from aqspark.functions import fixed
from aqspark.operators.segments import (
    SEGMENT_ROWS, over_segments, position, segment_window, split_segments)


# --- column builders, to be combined in one pass ------------------------------------

def lag_columns(w: WindowSpec, col="pm25", lags=fixed.LAGS) -> list[Column]:
    return [F.lag(col, k).over(w).alias(f"{col}_lag{k}") for k in lags]


def _earlier(fn, col, w, rows, at_least):
    frame = w.rowsBetween(-rows, -1)
    return F.when(F.count(col).over(frame) >= at_least, fn(col).over(frame))


def rolling_columns(w: WindowSpec, col="pm25", rows=24, at_least=3) -> list[Column]:
    """Mean, max, min and sample deviation of the rows before the current one."""
    stats = [("rmean", F.avg), ("rmax", F.max), ("rmin", F.min)]
    out = [_earlier(fn, col, w, rows, at_least).alias(f"{col}_{name}{rows}")
           for name, fn in stats]
    spread = F.coalesce(_earlier(F.stddev_samp, col, w, rows, at_least), F.lit(0.0))
    return out + [spread.alias(f"{col}_rstd{rows}")]


def trend_column(w: WindowSpec, col="pm25") -> Column:
    """Mean of the last 6 rows less mean of the last 12, zero while unknown."""
    short = _earlier(F.avg, col, w, 6, 2)
    long = _earlier(F.avg, col, w, 12, 3)
    return F.coalesce(short - long, F.lit(0.0)).alias(f"{col}_trend6h")


def target_columns(w: WindowSpec, col="pm25", horizons=fixed.HORIZONS) -> list[Column]:
    return [F.lead(col, h).over(w).alias(f"target_{h}h") for h in range(1, horizons + 1)]


# --- operators -----------------------------------------------------------------------

def add_lags(df: DataFrame, col="pm25", lags=fixed.LAGS, **where) -> DataFrame:
    return over_segments(df, lambda w: lag_columns(w, col, lags), before=max(lags), **where)


def add_rolling(df: DataFrame, col="pm25", rows_back=24, at_least=3, **where) -> DataFrame:
    return over_segments(df, lambda w: rolling_columns(w, col, rows_back, at_least),
                         before=rows_back, **where)


def add_trend(df: DataFrame, col="pm25", **where) -> DataFrame:
    return over_segments(df, lambda w: [trend_column(w, col)], before=12, **where)


def add_targets(df: DataFrame, col="pm25", horizons=fixed.HORIZONS, **where) -> DataFrame:
    return over_segments(df, lambda w: target_columns(w, col, horizons),
                         after=horizons, **where)


def _with_known_neighbours(df, cols, key, ts, rows, months=None):
    """Add ``_pos`` and, per column, the nearest known (position, value) on both sides.

    Inside a segment the forward and the reversed order both use the cheap
    running frame. What lies beyond a segment comes from one row of edge values
    per segment.
    """
    w = segment_window(key, ts)
    parts = (split_segments(df, key=key, ts=ts, rows=rows, months=months)
             .withColumn("_pos", position(w)))
    known = {c: F.when(F.col(c).isNotNull(), F.struct(F.col("_pos").alias("p"),
                                                      F.col(c).cast("double").alias("v")))
             for c in cols}
    edges = parts.groupBy(key, "_seg").agg(
        *[F.min(known[c]).alias(f"_head_{c}") for c in cols],
        *[F.max(known[c]).alias(f"_tail_{c}") for c in cols])
    # one row per segment, so a whole station's segments are a handful of rows
    ahead = Window.partitionBy(key).orderBy("_seg").rowsBetween(Window.unboundedPreceding, -1)
    behind = (Window.partitionBy(key).orderBy(F.desc("_seg"))
              .rowsBetween(Window.unboundedPreceding, -1))
    edges = edges.select(
        key, "_seg",
        *[F.last(f"_tail_{c}", True).over(ahead).alias(f"_in_{c}") for c in cols],
        *[F.last(f"_head_{c}", True).over(behind).alias(f"_out_{c}") for c in cols])
    running = w.rowsBetween(Window.unboundedPreceding, 0)
    reverse = (Window.partitionBy(key, "_seg").orderBy(F.desc(ts))
               .rowsBetween(Window.unboundedPreceding, 0))
    parts = parts.select(
        "*",
        *[F.last(known[c], True).over(running).alias(f"_before_{c}") for c in cols],
        *[F.last(known[c], True).over(reverse).alias(f"_after_{c}") for c in cols])
    return parts.join(edges, [key, "_seg"])


def _repair(df, cols, value, key, ts, rows, months=None):
    joined = _with_known_neighbours(df, cols, key, ts, rows, months)
    fixed_cols = {c: value(c, F.coalesce(f"_before_{c}", f"_in_{c}"),
                           F.coalesce(f"_after_{c}", f"_out_{c}")) for c in cols}
    return joined.select(*[fixed_cols[c].alias(c) if c in fixed_cols else F.col(c)
                           for c in df.columns])


def interpolate(df: DataFrame, cols, default=None, key="station", ts="timestamp",
                rows=SEGMENT_ROWS, months: DataFrame | None = None) -> DataFrame:
    """Straight line between known values by row number; the ends repeat the nearest
    known value. A column a station never knows becomes ``default``. ``months`` are those of ``split_segments``."""
    def value(c, before, after):
        share = (F.col("_pos") - before["p"]) / (after["p"] - before["p"])
        line = before["v"] + (after["v"] - before["v"]) * share
        return F.coalesce(F.col(c).cast("double"), line, before["v"], after["v"],
                          F.lit(default).cast("double"))
    return _repair(df, cols, value, key, ts, rows, months)


def fill_forward_back(df: DataFrame, cols, default=0.0, key="station", ts="timestamp",
                      rows=SEGMENT_ROWS) -> DataFrame:
    """Last known value, else next known value, else ``default``."""
    def value(c, before, after):
        return F.coalesce(before["v"], after["v"], F.lit(default).cast("double"))
    return _repair(df, cols, value, key, ts, rows)


def last_n(df: DataFrame, n: int, key="station", ts="timestamp", require=True) -> DataFrame:
    """Newest ``n`` rows per station; stations with fewer are left out if ``require``.

    Spark keeps the newest ``n`` of every station before the shuffle, so only
    ``n`` rows per station and task travel.
    """
    newest = Window.partitionBy(key).orderBy(F.desc(ts))
    out = df.withColumn("_rn", F.row_number().over(newest)).filter(F.col("_rn") <= n)
    if require:
        out = out.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(key)))
        out = out.filter(F.col("_n") >= n).drop("_n")
    return out.drop("_rn")


def current_value(df: DataFrame, cols=("pm25",), key="station", ts="timestamp") -> DataFrame:
    """Latest row per station, by partial aggregation."""
    return (df.groupBy(key)
            .agg(F.max(F.struct(ts, *cols)).alias("_last"))
            .select(key, "_last.*"))


def sequences(df: DataFrame, features, targets=fixed.TARGETS, lookback=fixed.LOOKBACK,
              horizons=fixed.HORIZONS, gap=1, key="station", ts="timestamp",
              rows=SEGMENT_ROWS, keep=None) -> DataFrame:
    """Learning examples: ``x`` the ``lookback`` feature rows, ``y`` the targets.

    With ``gap=1`` the target row follows the last feature row; with ``gap=0`` it is
    the last feature row. A station with n rows yields max(0, n - lookback - horizons
    + 1) examples. ``keep`` names a boolean column that picks examples before the wide
    arrays leave the task that built them.
    """
    packed = df.select(
        key, ts, *([keep] if keep else []),
        F.array(*[F.col(c).cast("float") for c in features]).alias("_f"),
        F.array(*[F.col(c).cast("float") for c in targets]).alias("y"))

    def columns(w):
        frame = w.rowsBetween(-lookback, -1) if gap else w.rowsBetween(1 - lookback, 0)
        return [position(w).alias("_pos"), F.collect_list("_f").over(frame).alias("x")]

    wanted = (F.col("_pos") >= lookback) & (F.col("_pos") <= F.col("_total") - horizons)
    if keep:
        wanted = wanted & F.col(keep)
    out = over_segments(packed, columns, before=lookback, key=key, ts=ts, rows=rows,
                        keep=wanted)
    return out.withColumnRenamed("_pos", "row").drop("_f", *([keep] if keep else []))


def dedupe_by_source(df: DataFrame, keys, source: str, priority) -> DataFrame:
    """One row per key, from the first source in ``priority`` that has it.

    An aggregate, not a window: copies collapse before the shuffle. Rows of the
    same source are told apart by their remaining columns, smallest first.
    """
    rank = F.array_position(F.array(*[F.lit(p) for p in priority]), F.col(source))
    rest = [c for c in df.columns if c not in keys]
    return (df.groupBy(*keys)
            .agg(F.min(F.struct(rank.alias("_rank"), *rest)).alias("_row"))
            .select(*keys, *[F.col(f"_row.{c}").alias(c) for c in rest]))


def hour_grid(keys: DataFrame, start, end) -> DataFrame:
    """Every key at every hour from ``start`` to ``end`` (columns or literals)."""
    steps = F.sequence(F.date_trunc("hour", start), F.date_trunc("hour", end),
                       F.expr("INTERVAL 1 HOUR"))
    return keys.withColumn("timestamp", F.explode(steps))


def densify_hours(df: DataFrame, keys: DataFrame, start, end, fill=0.0) -> DataFrame:
    """Full hourly grid for ``keys``; hours that ``df`` lacks hold ``fill``."""
    grid = hour_grid(keys, start, end)
    values = [c for c in df.columns if c not in grid.columns]
    on = [c for c in grid.columns if c in df.columns]
    return grid.join(df, on, "left").fillna(fill, subset=values)
