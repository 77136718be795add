"""The fixed values as small tables."""

from pyspark.sql import DataFrame, SparkSession

from aqspark.functions import fixed


def cities(spark: SparkSession) -> DataFrame:
    """Reference cities; ``ord`` is their order of preference."""
    return spark.createDataFrame(
        [(i, *c) for i, c in enumerate(fixed.CITIES)],
        "ord int, city string, state string, lat double, lon double")


def fallback_stations(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        [(s, lat, lon, city, s, "fallback") for s, _, lat, lon, city in fixed.FALLBACK_STATIONS],
        "station string, lat double, lon double, city string, name string, owner string")


def watched_cities(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(c,) for c in fixed.WATCHED_CITIES], "city string")


def news_cities(spark: SparkSession) -> DataFrame:
    """Cities with news terms, and the latitude their calendar signals use."""
    return spark.createDataFrame(
        [(c, fixed.NORTHERN_LAT if c in fixed.NORTHERN_CITIES else fixed.SOUTHERN_LAT)
         for c in fixed.CITY_TERMS], "city string, lat double")


def holidays(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(d,) for d in fixed.HOLIDAYS], "day string").selectExpr(
        "cast(day as date) as day")


def aqi_bands(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(fixed.AQI_BANDS,
                                 "lo double, hi double, label string, code int, color string")
