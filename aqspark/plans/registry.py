"""Station registry: discover, label, screen, clean."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aqspark.functions import fixed
from aqspark.functions.text import city_label, first_text, station_slug
from aqspark.operators.aggregate import first_working_sensor
from aqspark.operators.clean import (
    filter_cities, in_bbox, reject_reason, sensor_candidates, split_kept)
from aqspark.operators.joins import add_fallback_cities
from aqspark.operators.spatial import nearest_join


def build_registry(locations: DataFrame, fallback: DataFrame | None = None) -> DataFrame:
    """Locations inside the search box that have a PM2.5 sensor, as stations."""
    found = in_bbox(locations).withColumn("sensor_ids", sensor_candidates("sensors"))
    found = found.filter(F.size("sensor_ids") > 0)
    stations = found.select(
        station_slug("name", "location_id").alias("station"),
        "location_id",
        F.get("sensor_ids", F.lit(0)).alias("sensor_id"),
        "sensor_ids", "lat", "lon",
        city_label("locality", "city").alias("city"),
        F.coalesce(first_text("name"),
                   F.concat(F.lit("loc_"), F.col("location_id").cast("string"))).alias("name"),
        "owner")
    return stations if fallback is None else add_fallback_cities(stations, fallback)


def label_cities(stations: DataFrame, refs: DataFrame,
                 max_km=fixed.CITY_RADIUS_KM) -> DataFrame:
    return nearest_join(stations, refs, max_km=max_km)


def screen_stations(stations: DataFrame, coverage: DataFrame, cities=None) -> DataFrame:
    """Stations with data, on their first sensor that has any."""
    chosen = filter_cities(stations, cities) if cities else stations
    return first_working_sensor(chosen, coverage)


def clean_stations(stations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(kept, dropped with the reason)."""
    return split_kept(reject_reason(stations))
