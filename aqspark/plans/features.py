"""The hourly feature table, for learning and for live use."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aqspark.functions import calendar, fixed
from aqspark.functions.scalars import (
    aqi_category, dew_point, wind_speed, wind_u, wind_v)
from aqspark.operators.clean import (
    drop_incomplete, ensure_columns, filter_cities, min_records, project_features, to_float32,
    zero_fill)
from aqspark.operators.joins import (
    join_copollutants, join_fires, join_news, join_stations, join_weather)
from aqspark.operators.segments import min_months, month_counts, over_segments
from aqspark.operators.spatial import SiteFires, fire_hourly
from aqspark.operators.windows import (
    interpolate, lag_columns, last_n, rolling_columns, target_columns, trend_column)
from aqspark.plans.learning import null_columns
from aqspark.storage import materialise

# Features that can be unknown for an hour and are repaired along the timeline.
REPAIRABLE = ["pm25_lag48", "pm25_lag72"] + fixed.COPOLLUTANTS + [
    "temperature_2m", "relative_humidity_2m", "dew_point_2m", "surface_pressure",
    "precipitation", "cloud_cover", "shortwave_radiation", "boundary_layer_height"]
# rows before its own that a feature row looks at: the lags reach further than the rolling frames
REACH = max(fixed.LAGS)


def add_weather_features(df: DataFrame) -> DataFrame:
    """Wind components, and the dew point if no source delivered it."""
    given = ensure_columns(df, {"wind_speed_10m": 0.0, "wind_direction_10m": 0.0})
    out = given.withColumns({
        "wind_speed": wind_speed("wind_speed_10m"),
        "wind_u": wind_u("wind_speed_10m", "wind_direction_10m"),
        "wind_v": wind_v("wind_speed_10m", "wind_direction_10m"),
    }).drop("wind_speed_10m", "wind_direction_10m")
    if "dew_point_2m" not in df.columns:
        t = F.col("temperature_2m") if "temperature_2m" in df.columns else F.lit(25.0)
        rh = (F.col("relative_humidity_2m") if "relative_humidity_2m" in df.columns
              else F.lit(60.0))
        out = out.withColumn("dew_point_2m", dew_point(t, rh))
    return out


def add_calendar_features(df: DataFrame) -> DataFrame:
    return df.withColumns({**calendar.traffic("timestamp"), **calendar.clock("timestamp"),
                           **calendar.seasons("timestamp", "lat")})


def build_features(readings: DataFrame, stations: DataFrame, weather: DataFrame | None = None,
                   fires: DataFrame | SiteFires | None = None, months: DataFrame | None = None) -> DataFrame:
    """All features and targets for hourly ``readings`` (station, timestamp, pm25, and
    co-pollutants if known). ``weather`` has one row per cell and hour, ``fires`` one per
    station and hour, or one per site and hour (``fire_hourly`` with ``shared``).

    The joins come first, while rows are narrow; the windows then add their many columns
    where the rows already lie, and nothing wide is shuffled again. ``months`` are the month
    counts of the readings, where they are known already.
    """
    if months is None:
        months = month_counts(readings.join(stations.select("station"), "station", "left_semi"))
    cols = ["lat", "lon"]
    if isinstance(fires, SiteFires):
        # readings get their site with their position
        stations, cols = stations.join(fires.members, "station", "left"), [*cols, "_site"]
    df = join_stations(readings, stations, cols)
    if weather is not None:
        df = join_weather(df, weather)
    if fires is not None:
        df = join_fires(df, fires)
    df = over_segments(
        df,
        lambda w: lag_columns(w) + rolling_columns(w) + [trend_column(w)] + target_columns(w),
        before=REACH, after=fixed.HORIZONS, months=months)
    df = ensure_columns(add_weather_features(df), dict.fromkeys(fixed.FIRE_MEASURES, 0.0))
    df = add_calendar_features(df).withColumn("aqi_category", aqi_category("pm25"))
    df = ensure_columns(df, dict.fromkeys(fixed.FEATURES, 0.0))
    return project_features(df)


def with_news(features: DataFrame, stations: DataFrame, news: DataFrame | None) -> DataFrame:
    """News signals by station, or by the city of the station."""
    if news is not None and "city" in news.columns and "city" not in features.columns:
        features = join_stations(features, stations, cols=["city"])
    return join_news(features, news)


def build_dataset(readings: DataFrame, stations: DataFrame, weather: DataFrame | None = None,
                  fires: DataFrame | None = None, copollutants: DataFrame | None = None,
                  news: DataFrame | None = None, cities=None,
                  min_readings=fixed.MIN_READINGS, min_rows=fixed.MIN_FEATURE_ROWS) -> DataFrame:
    """Learning table: gates, features, gap repair, narrow types.

    ``fires`` are single detections here. News signals stay 0 unless ``news`` is given, by
    station or city; a place that it does not know gets those of the calendar.
    A measurement a station never has becomes 0 instead of removing the station.
    """
    if cities:
        stations = filter_cities(stations, cities)
    known = readings.join(stations.select("station"), "station", "left_semi")
    # one narrow table tells which stations have enough, and where their segments are cut
    months = min_months(materialise(month_counts(known)), min_readings)
    enough = known.join(months.select("station"), "station", "left_semi")
    if copollutants is not None:
        enough = join_copollutants(enough, copollutants)
    hours = None if fires is None else fire_hourly(stations, fires, shared=True)
    features = build_features(enough, stations, weather, hours, months)
    if news is not None:
        features = project_features(with_news(features, stations, news))
    # a station without a position has no use; all else is computed, filled or repaired
    complete = drop_incomplete(features).dropna(subset=["lat", "lon"])
    # the row gate and the repair both read this twice
    complete = materialise(complete)
    # the gate falls on the month counts, so that the wide rows are spread once, by segment
    months = min_months(materialise(month_counts(complete)), min_rows)
    repaired = interpolate(complete, REPAIRABLE, default=0.0, months=months)
    return to_float32(project_features(repaired))


def live_window(readings: DataFrame, stations: DataFrame, weather: DataFrame | None = None,
                fires: DataFrame | None = None, news: DataFrame | None = None,
                rows=fixed.LOOKBACK, min_readings=fixed.MIN_LIVE_READINGS) -> DataFrame:
    """Newest ``rows`` feature rows per station, repaired and without nulls.

    ``readings`` should reach back ``rows`` plus the longest lag; ``fires`` are single
    detections; ``news`` has city or station, timestamp and signals. Stations with
    fewer rows keep what they have; scoring skips them.
    """
    enough = min_records(readings, min_readings)
    # the newest rows look no further back, so older ones go before anything is joined; what is left is read several times
    enough = materialise(last_n(enough, rows + REACH, require=False))
    hours = None if fires is None else fire_hourly(stations, fires, shared=True, hours=enough)
    features = build_features(enough, stations, weather, hours)
    features = with_news(features, stations, news)
    newest = last_n(project_features(features, cols=fixed.FEATURES), rows, require=False)
    # at most `rows` rows per station from here on; the repair reads them twice
    newest = materialise(newest.withColumns({c: F.col(c).cast("double") for c in REPAIRABLE}))
    # a column that every row knows needs no repair
    unknown = null_columns(newest, REPAIRABLE)
    repaired = interpolate(newest, unknown, default=0.0) if unknown else newest
    return zero_fill(repaired, fixed.FEATURES)
