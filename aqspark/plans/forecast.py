"""Scoring with any predictor, and the forecast documents."""

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from aqspark.functions import fixed
from aqspark.functions.scalars import (
    aqi_color, aqi_label, clip_forecast, delta, nominal_confidence, round_to, trend_arrow,
    unscaled)
from aqspark.operators.clean import active_signals
from aqspark.operators.joins import join_station_ids
from aqspark.operators.scaling import robust_scale
from aqspark.operators.windows import last_n

# features (batch, rows, features), station ids (batch) → scaled forecasts (batch, horizons)
Predictor = Callable[[np.ndarray, np.ndarray], np.ndarray]


def persistence(reading_at: int) -> Callable[[], Predictor]:
    """Predictor that repeats the last (scaled) reading."""
    def load():
        return lambda x, ids: np.repeat(x[:, -1, reading_at:reading_at + 1],
                                        fixed.HORIZONS, axis=1)
    return load


def window_arrays(newest: DataFrame, features) -> DataFrame:
    """One row per station: its rows as ``x``, oldest first, beside the values of its newest row.

    ``newest`` has the few rows per station that a forecast looks at; their features are
    scaled already, in columns named after them with a leading underscore.
    """
    row = F.struct("timestamp", F.array(*[F.col(f"_{c}").cast("float") for c in features]).alias("f"))
    shown = [c for c in ["timestamp", "pm25", *fixed.SHOWN_SIGNALS] if c in newest.columns]
    return newest.groupBy("station").agg(
        F.sort_array(F.collect_list(row)).alias("_rows"), F.max(F.struct(*shown)).alias("_last")).select(
        "station", F.col("_rows.f").alias("x"), "_last.*")


def apply_predictor(windows: DataFrame, load: Callable[[], Predictor]) -> DataFrame:
    """Run a predictor over (station, station_id, x, …); it is loaded once per task. Other
    columns pass through, the forecasts are added as ``y``."""
    kept = [f for f in windows.schema.fields if f.name not in ("station_id", "x")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        predict = load()
        for batch in batches:
            if len(batch):
                x = np.stack([np.stack(rows) for rows in batch["x"]]).astype(np.float32)
                y = np.asarray(predict(x, batch["station_id"].to_numpy()), dtype=np.float64)
                yield batch[[f.name for f in kept]].assign(y=list(y))
    schema = T.StructType([*kept, T.StructField("y", T.ArrayType(T.DoubleType()))])
    return windows.mapInPandas(run, schema)


def newest_rows(df: DataFrame, features, lookback=fixed.LOOKBACK, since=None) -> DataFrame:
    """The ``lookback`` newest rows per station, of stations that have as many.

    Columns nobody asks for are not read. ``since`` (a day) bounds the history that is read;
    a table by day then opens no older folder. Spark cuts each station to its newest rows
    before the shuffle.
    """
    if since is not None:
        day = F.lit(since).cast("date")
        df = df.filter(F.col("date") >= day if "date" in df.columns else F.to_date("timestamp") >= day)
    wanted = [c for c in df.columns if c in {"station", "timestamp", "pm25", *features, *fixed.SHOWN_SIGNALS}]
    return last_n(df.select(*wanted), lookback)


def forecast_windows(df: DataFrame, load: Callable[[], Predictor], params: dict, target,
                     features=fixed.FEATURES, ids: DataFrame | None = None, since=None) -> DataFrame:
    """(station, forecast array in reading units, values of the newest row) from one read."""
    newest = newest_rows(df, features, since=since)
    scaled = robust_scale(newest.select("*", *[F.col(c).alias(f"_{c}") for c in features]),
                          {f"_{c}": p for c, p in params.items()})
    windows = window_arrays(scaled, features)
    if ids is None:
        windows = windows.withColumn("station_id", F.lit(0))
    else:
        windows = join_station_ids(windows, ids)
    center, scale = target
    return apply_predictor(windows, load).withColumn(
        "forecast", F.transform("y", lambda v: clip_forecast(
            unscaled(v, F.lit(center), F.lit(scale))))).drop("y")


def forecast_values(df: DataFrame, load: Callable[[], Predictor], params: dict, target,
                    features=fixed.FEATURES, ids: DataFrame | None = None, since=None) -> DataFrame:
    """(station, forecast array) in reading units, bounded; short stations are left out.

    ``params`` are the feature scales by name, ``target`` is the (center, scale) of the
    targets. All stations are scored by one job.
    """
    return forecast_windows(df, load, params, target, features, ids, since).select(
        "station", "forecast")


def _steps(forecast: Column, current: Column) -> Column:
    def entry(h):
        value = round_to(F.get(forecast, h - 1), 1)
        body = F.struct(
            value.alias("pm25"), aqi_label(value).alias("aqi"),
            aqi_color(value).alias("aqi_color"), delta(value, current).alias("delta"),
            nominal_confidence(h - 1).alias("confidence"))
        return F.struct(F.concat(F.lit("+"), h.cast("string"), F.lit("h")).alias("k"),
                        body.alias("v"))
    return F.map_from_entries(F.transform(
        F.sequence(F.lit(1), F.lit(fixed.HORIZONS)), entry))


def forecast_documents(forecasts: DataFrame) -> DataFrame:
    """One nested document per station from its forecast array and its newest row."""
    rows = forecasts.withColumn("pm25", F.col("pm25").cast("double"))
    return rows.select(
        "station",
        round_to("pm25", 1).alias("current_pm25"),
        aqi_label("pm25").alias("current_aqi"),
        F.date_format("timestamp", "yyyy-MM-dd HH:mm:ssxxx").alias("data_ts"),
        _steps(F.col("forecast"), F.col("pm25")).alias("forecast"),
        active_signals().alias("signals"),
        F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ssxxx").alias("generated_at"))


def score(df: DataFrame, load, params, target, ids=None, features=fixed.FEATURES,
          since=None) -> DataFrame:
    """Forecast documents for every station with enough rows."""
    return forecast_documents(forecast_windows(df, load, params, target, features, ids, since))


def forecast_rows(documents: DataFrame) -> DataFrame:
    """Documents → one printable row per station and hour ahead."""
    rows = documents.select("station", "current_pm25", F.explode("forecast").alias("step", "f"))
    return rows.select("station", "current_pm25", "step", "f.*",
                       trend_arrow("f.delta").alias("arrow"))
