"""Registration of queries, and the station data that the given tables stand for.

``events`` are readings: eight users share a station and every user is a sensor.
``supplier`` and ``nation`` are the station registry and its reference cities.
``FIXTURE`` holds the same views as SQL.
"""

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from aqspark.operators.aggregate import hourly_mean
from aqspark.storage import configure


@dataclass
class Query:
    name: str
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None


CATALOG: dict[str, Query] = {}

# type letter → (Spark expression, SQL expression); doubles are rounded because sums
# depend on the order of their terms
DIGITS = 8


def spark_out(name, kind):
    c = F.col(name)
    if kind[0] == "f":
        return (F.round(c.cast("double"), int(kind[1:] or DIGITS)) + F.lit(0.0)).alias(name)
    if kind == "i":
        return c.cast("bigint").alias(name)
    if kind == "t":
        return F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(name)
    return c.cast("string").alias(name)


def _sql_out(name, kind):
    if kind[0] == "f":
        return f"round(CAST({name} AS DOUBLE), {kind[1:] or DIGITS}) + 0.0 AS {name}"
    if kind == "i":
        return f"CAST({name} AS BIGINT) AS {name}"
    if kind == "t":
        return f"strftime(CAST({name} AS TIMESTAMP), '%Y-%m-%d %H:%M:%S') AS {name}"
    return f"CAST({name} AS VARCHAR) AS {name}"


def query(name: str, out: str, sql: str | None = None, views: str = "", ready=False):
    """Register a query.

    ``out`` lists the result columns as ``name:kind`` with kind f(loat; ``f4`` keeps
    four digits), i(nteger), t(ime) or s(tring), and shapes both sides alike. ``sql`` is a SELECT; ``views`` names
    the fixture views it needs. With ``ready`` the function returns the columns in that shape itself.
    """
    columns = [tuple(c.split(":")) for c in out.split()]

    def register(fn):
        def run(spark, sf_dir):
            configure(spark)
            return fn(Tables(spark, sf_dir)).select(*[n if ready else spark_out(n, k) for n, k in columns])
        text = None
        if sql is not None:
            ctes = [FIXTURE[v] for v in _needed(views.split())]
            ctes.append(f"result AS ({sql})")
            shaped = ", ".join(_sql_out(n, k) for n, k in columns)
            text = "WITH RECURSIVE " if "RECURSIVE" in sql else "WITH "
            text += ",\n".join(ctes) + f"\nSELECT {shaped} FROM result"
        if name in CATALOG:
            raise ValueError(f"query {name} is registered twice")
        CATALOG[name] = Query(name, run, text)
        return fn
    return register


def _needed(views):
    """The views and what they build on, in order of definition."""
    wanted = set(views)
    for name in reversed(list(FIXTURE)):
        if name in wanted:
            wanted |= set(NEEDS.get(name, []))
    return [n for n in FIXTURE if n in wanted]


class Tables:
    """Given tables and the station data derived from them."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir
        self._opened: dict[str, DataFrame] = {}

    def table(self, name: str) -> DataFrame:
        if name not in self._opened:
            self._opened[name] = self._open(name)
        return self._opened[name]

    def _open(self, name):
        df = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        naive = [f.name for f in df.schema.fields if isinstance(f.dataType, T.TimestampNTZType)]
        return df.withColumns({c: F.col(c).cast("timestamp") for c in naive}) if naive else df

    def raw(self) -> DataFrame:
        """Readings as delivered."""
        return self.table("events").select(
            F.concat(F.lit("st_"), F.expr("user_id div 8").cast("string")).alias("station"),
            F.col("user_id").alias("sensor_id"), "event_id", "ts",
            F.col("event_type").alias("kind"), F.col("value").alias("pm25"))

    def hourly(self) -> DataFrame:
        return hourly_mean(self.raw(), ts="ts")

    def places(self) -> DataFrame:
        """Suppliers as stations of the registry."""
        s = self.table("supplier").join(
            self.table("nation"), F.col("s_nationkey") == F.col("n_nationkey"))
        key = F.col("s_suppkey")
        return s.select(
            F.concat(F.lit("st_"), key.cast("string")).alias("station"),
            key.alias("location_id"),
            (key * 150_000).alias("sensor_id"),
            (8 + key * 37 % 2800 / F.lit(100.0)).alias("lat"),
            (68 + key * 53 % 2800 / F.lit(100.0)).alias("lon"),
            F.col("n_name").alias("city"), F.col("s_name").alias("name"),
            F.col("s_acctbal").alias("acctbal"))

    def refs(self) -> DataFrame:
        """Nations as reference cities."""
        key = F.col("n_nationkey")
        return self.table("nation").select(
            key.alias("ord"), F.col("n_name").alias("city"),
            F.concat(F.lit("state_"), F.col("n_regionkey").cast("string")).alias("state"),
            (8 + key * F.lit(1.1)).alias("lat"),
            (68 + key * 7 % 25 * F.lit(1.1)).alias("lon"))

    def fires(self) -> DataFrame:
        e = self.table("events").filter("event_type = 'error'")
        key = F.col("event_id")
        return e.select(
            F.col("ts").alias("timestamp"),
            (8 + key * 31 % 2800 / F.lit(100.0)).alias("latitude"),
            (68 + key * 17 % 2800 / F.lit(100.0)).alias("longitude"),
            F.col("value").alias("frp"),
            (300 + F.col("value") / 10).alias("bright_ti4"),
            F.when(key % 5 != 0, 280 + F.col("value") / 20).alias("bright_ti5"))

    def weather(self) -> DataFrame:
        """Views as weather: one series for every station's cell and hour."""
        e = self.table("events").filter("event_type = 'view'")
        return (e.groupBy(F.concat(F.lit("st_"), F.expr("user_id div 8").cast("string"))
                          .alias("station"), F.date_trunc("hour", "ts").alias("timestamp"))
                .agg((F.max("value") / 10).alias("temperature_2m"),
                     (F.min("value") / 5).alias("relative_humidity_2m"),
                     (F.max("event_id") % 360).cast("double").alias("wind_direction_10m"),
                     (F.max("event_id") % 17).cast("double").alias("wind_speed_10m")))

    def stations(self) -> DataFrame:
        """The stations that have readings, with a position each."""
        number = F.expr("user_id div 8")
        return self.table("events").select(number.alias("_k")).distinct().select(
            F.concat(F.lit("st_"), F.col("_k").cast("string")).alias("station"),
            (8 + F.col("_k") * 37 % 2800 / F.lit(100.0)).alias("lat"),
            (68 + F.col("_k") * 53 % 2800 / F.lit(100.0)).alias("lon"),
            F.concat(F.lit("NATION_"), (F.col("_k") % 25).cast("string")).alias("city"))

    def articles(self) -> DataFrame:
        """Documents as articles, published when the event of the same number happened."""
        when = self.table("events").select(F.col("event_id").alias("doc_id"),
                                           F.col("ts").alias("timestamp"))
        return self.table("documents").join(when, "doc_id").select(
            "doc_id", "timestamp", "text", "lang")

    def moments(self) -> DataFrame:
        """Event times moved over five years, so that all seasons and feasts occur."""
        shift = F.make_interval(days=(F.col("event_id") % 1700).cast("int"))
        key = F.col("event_id")
        return self.table("events").select(
            "event_id", (F.col("ts") - F.expr("INTERVAL 700 DAYS") + shift).alias("timestamp"),
            (8 + key * 31 % 2800 / F.lit(100.0)).alias("lat"))


STATION = "'st_' || CAST(user_id // 8 AS VARCHAR)"

NEEDS = {"hourly": ["raw"]}

FIXTURE = {
    "raw": f"""raw AS (SELECT {STATION} AS station, user_id AS sensor_id, event_id, ts,
  event_type AS kind, value AS pm25 FROM events)""",
    "hourly": """hourly AS (SELECT station, date_trunc('hour', ts) AS timestamp,
  avg(pm25) AS pm25 FROM raw GROUP BY ALL HAVING avg(pm25) BETWEEN 0 AND 1500)""",
    "places": """places AS (SELECT 'st_' || CAST(s_suppkey AS VARCHAR) AS station,
  s_suppkey AS location_id, s_suppkey * 150000 AS sensor_id,
  8 + (s_suppkey * 37 % 2800) / 100.0::DOUBLE AS lat,
  68 + (s_suppkey * 53 % 2800) / 100.0::DOUBLE AS lon,
  n_name AS city, s_name AS name, s_acctbal AS acctbal
  FROM supplier JOIN nation ON s_nationkey = n_nationkey)""",
    "refs": """refs AS (SELECT n_nationkey AS ord, n_name AS city,
  'state_' || CAST(n_regionkey AS VARCHAR) AS state,
  8 + n_nationkey * 1.1::DOUBLE AS lat, 68 + (n_nationkey * 7 % 25) * 1.1::DOUBLE AS lon
  FROM nation)""",
    "fires": """fires AS (SELECT ts AS timestamp,
  8 + (event_id * 31 % 2800) / 100.0::DOUBLE AS latitude,
  68 + (event_id * 17 % 2800) / 100.0::DOUBLE AS longitude, value AS frp,
  300 + value / 10 AS bright_ti4,
  CASE WHEN event_id % 5 <> 0 THEN 280 + value / 20 END AS bright_ti5
  FROM events WHERE event_type = 'error')""",
    "weather": f"""weather AS (SELECT {STATION} AS station, date_trunc('hour', ts) AS timestamp,
  max(value) / 10 AS temperature_2m, min(value) / 5 AS relative_humidity_2m,
  CAST(max(event_id) % 360 AS DOUBLE) AS wind_direction_10m,
  CAST(max(event_id) % 17 AS DOUBLE) AS wind_speed_10m
  FROM events WHERE event_type = 'view' GROUP BY 1, 2)""",
    "stations": """stations AS (SELECT 'st_' || CAST(k AS VARCHAR) AS station,
  8 + (k * 37 % 2800) / 100.0::DOUBLE AS lat, 68 + (k * 53 % 2800) / 100.0::DOUBLE AS lon,
  'NATION_' || CAST(k % 25 AS VARCHAR) AS city
  FROM (SELECT DISTINCT user_id // 8 AS k FROM events))""",
    "articles": """articles AS (SELECT doc_id, ts AS timestamp, text, lang
  FROM documents JOIN events ON event_id = doc_id)""",
    "moments": """moments AS (SELECT event_id,
  ts - INTERVAL 700 DAY + to_days(CAST(event_id % 1700 AS INTEGER)) AS timestamp,
  8 + (event_id * 31 % 2800) / 100.0::DOUBLE AS lat FROM events)""",
}


def haversine_sql(lat1, lon1, lat2, lon2) -> str:
    lat1, lon1, lat2, lon2 = (f"({x})" for x in (lat1, lon1, lat2, lon2))
    return (f"12742.0 * asin(sqrt(least(greatest("
            f"pow(sin(radians({lat2} - {lat1}) / 2), 2) + cos(radians({lat1})) * "
            f"cos(radians({lat2})) * pow(sin(radians({lon2} - {lon1}) / 2), 2), 0.0), 1.0)))")


def values_sql(rows) -> str:
    """Rows of plain values as a SQL VALUES list."""
    def lit(v):
        if v is None:
            return "NULL"
        return "'" + v.replace("'", "''") + "'" if isinstance(v, str) else repr(v)
    return "(VALUES " + ", ".join("(" + ", ".join(lit(v) for v in r) + ")" for r in rows) + ")"
