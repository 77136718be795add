"""Archive history and its union with the current dataset."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aqspark.functions.text import is_pm25_archive
from aqspark.operators.aggregate import hourly_mean
from aqspark.operators.clean import coerce, filter_cities, has_location
from aqspark.operators.joins import union_common
from aqspark.operators.windows import dedupe_by_source


def build_history(archive: DataFrame, stations: DataFrame, cities=None) -> DataFrame:
    """Archive texts → hour means per station, with its city and position.

    Raw readings are clamped before they are averaged.
    """
    chosen = has_location(filter_cities(stations, cities) if cities else stations)
    pm25 = archive
    if "parameter" in archive.columns:
        named = (F.col("has_parameter") if "has_parameter" in archive.columns
                 else F.lit(True))
        pm25 = archive.filter(~named | F.coalesce(is_pm25_archive("parameter"), F.lit(False)))
    rows = coerce(pm25.select("location_id", "timestamp", "pm25"))
    hours = hourly_mean(rows, keys=("location_id",), ts="timestamp", policy="clip_before")
    places = chosen.select("location_id", "station",
                           F.coalesce("city", F.lit("Unknown")).alias("city"), "lat", "lon")
    return hours.join(places, "location_id").select(
        "timestamp", "pm25", "station", "city", "lat", "lon", "location_id")


def merge_history(current: DataFrame, history: DataFrame,
                  priority=("history", "current")) -> DataFrame:
    """Rows of both on their common columns, one per station and hour.

    Where both have an hour the archive row wins; turn ``priority`` round for the
    other rule.
    """
    both = union_common({"current": current, "history": history}, tag="_source")
    return dedupe_by_source(both, ["station", "timestamp"], "_source", priority).drop("_source")
