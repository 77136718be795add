"""Joins onto the hourly timeline, and set operations.

None forces a broadcast: sizes are left to the optimizer and adaptive execution.
"""

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aqspark.functions import fixed
from aqspark.functions.calendar import calendar_news
from aqspark.operators.clean import ensure_columns
from aqspark.operators.spatial import SiteFires, assign_cell


def join_weather(readings: DataFrame, weather: DataFrame) -> DataFrame:
    """Left join on time and half-degree cell, or on time alone for one shared series."""
    if "cell_lat" not in weather.columns:
        return readings.join(weather, "timestamp", "left")
    celled = readings if "cell_lat" in readings.columns else assign_cell(readings)
    return celled.join(weather, ["cell_lat", "cell_lon", "timestamp"], "left").drop(
        "cell_lat", "cell_lon")


def join_fires(readings: DataFrame, fire_hours: DataFrame | SiteFires) -> DataFrame:
    """Left join per station and hour, or per site and hour; hours without fires hold zeros."""
    if isinstance(fire_hours, SiteFires):
        # one row per station; where the readings know their site already, they need no such join
        placed = readings if "_site" in readings.columns else readings.join(fire_hours.members, "station", "left")
        out = placed.join(fire_hours.sums, ["_site", "timestamp"], "left").select(*readings.columns, *fixed.FIRE_MEASURES).drop("_site")
        return out.fillna(0, subset=fixed.FIRE_MEASURES)
    out = ensure_columns(readings.join(fire_hours, ["station", "timestamp"], "left"),
                         dict.fromkeys(fixed.FIRE_MEASURES, 0.0))
    return out.fillna(0, subset=fixed.FIRE_MEASURES)


def join_copollutants(readings: DataFrame, hours: DataFrame) -> DataFrame:
    return readings.join(hours, ["station", "timestamp"], "left")


def join_stations(rows: DataFrame, stations: DataFrame, cols=("lat", "lon"),
                  how="inner") -> DataFrame:
    return rows.join(stations.select("station", *cols), "station", how)


def join_station_ids(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """Model id of each station; unknown stations get 0."""
    return (rows.join(ids, "station", "left")
            .withColumn("station_id", F.coalesce("station_id", F.lit(0))))


def add_fallback_cities(stations: DataFrame, fallback: DataFrame) -> DataFrame:
    """Append the fallback stations of cities that no station names, whatever the case."""
    known = stations.select(F.lower("city").alias("_city")).distinct()
    missing = fallback.join(known, F.lower(fallback["city"]) == F.col("_city"), "left_anti")
    return stations.unionByName(missing, allowMissingColumns=True)


def watched_city_counts(stations: DataFrame, watched: DataFrame) -> DataFrame:
    """Stations per watched city, with a note where there is none."""
    counts = stations.groupBy("city").agg(F.count(F.lit(1)).alias("n"))
    out = watched.select("city").join(counts, "city", "left")
    out = out.withColumn("n", F.coalesce("n", F.lit(0)))
    return out.withColumn("note", F.when(F.col("n") > 0, "OK").otherwise("MISSING"))


# --- news ----------------------------------------------------------------------------------

def join_news(rows: DataFrame, news: DataFrame | None,
              cols=fixed.NEWS_SIGNALS) -> DataFrame:
    """Live news signal, else the one the row has, else 0. Rows of a city or station that
    ``news`` does not know get the signals of the calendar (``lat`` needed), and so do all
    rows where there is no live news at all."""
    if news is None:
        return rows.withColumns(calendar_news("timestamp", "lat"))
    rows = ensure_columns(rows, dict.fromkeys(cols, 0.0))
    keys = [k for k in ("city", "station", "timestamp") if k in news.columns]
    live = news.select(*keys, *[(F.col(c) if c in news.columns else F.lit(0.0)).alias(f"_live_{c}")
                                for c in cols])
    out = rows.join(live, keys, "left")
    places = [k for k in keys if k != "timestamp"]
    if places:
        known = news.select(*places).distinct().withColumn("_known", F.lit(True))
        out = out.join(known, places, "left")
    else:
        out = out.withColumn("_known", F.lit(True))
    by_date = calendar_news("timestamp", "lat") if "lat" in rows.columns else {}
    return out.withColumns({
        c: F.when(F.col("_known"), F.coalesce(f"_live_{c}", c, F.lit(0.0))).otherwise(
            by_date.get(c, F.coalesce(c, F.lit(0.0)))) for c in cols}).drop(
        "_known", *[f"_live_{c}" for c in cols])


def news_for_station(rows: DataFrame, stored: DataFrame, cols=fixed.NEWS_SIGNALS) -> DataFrame:
    """Stored signals for cities that have any, calendar signals for the others.

    ``rows``: station, city, timestamp, lat.
    """
    covered = stored.select("city").distinct().withColumn("_covered", F.lit(True))
    kept = stored.select("city", "timestamp", *[F.col(c).alias(f"_stored_{c}") for c in cols])
    out = rows.join(covered, "city", "left").join(kept, ["city", "timestamp"], "left")
    by_date = calendar_news("timestamp", "lat")
    return out.withColumns({
        c: F.when(F.col("_covered"), F.coalesce(f"_stored_{c}", F.lit(0.0))).otherwise(by_date[c])
        for c in cols}).drop("_covered", *[f"_stored_{c}" for c in cols])


# --- sets ----------------------------------------------------------------------------------

def union_all(*frames: DataFrame) -> DataFrame:
    """Rows of all frames by column name, null where a frame lacks a column."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def union_common(tagged: dict[str, DataFrame], tag="source") -> DataFrame:
    """Rows of all frames on the columns they share, tagged with where they come from."""
    frames = list(tagged.values())
    common = [c for c in frames[0].columns if all(c in f.columns for f in frames[1:])]
    return reduce(DataFrame.unionByName,
                  [f.select(*common, F.lit(name).alias(tag)) for name, f in tagged.items()])


def not_yet_done(df: DataFrame, done: DataFrame, key="station") -> DataFrame:
    return df.join(done.select(key).distinct(), key, "left_anti")
