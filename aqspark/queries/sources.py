"""Readers and writers S1–S16: documents landed from the given tables, then read."""

from pyspark.sql import functions as F

from aqspark.functions import fixed
from aqspark.operators.aggregate import iso_text
from aqspark.operators.metrics import horizon_metrics
from aqspark.operators.ranks import station_ids
from aqspark.operators.scaling import fit_robust
from aqspark.plans import history, registry
from aqspark.plans.learning import naive
from aqspark.queries.base import query
from aqspark.queries.joining import REGISTRY, found_locations
from aqspark.sources import readers, writers
from aqspark.storage import new_path


def land(t, df, name, fmt="json", **options):
    path = new_path(t.spark, name)
    df.write.options(**options).format(fmt).save(path)
    return path


# --- documents -----------------------------------------------------------------------------

@query("s01_read_locations", "location_id:i name:s lat:f lon:f owner:s sensors:i", sql="""
SELECT c_custkey AS location_id, CASE WHEN c_custkey % 6 <> 0 THEN c_name END AS name,
  4 + (c_custkey * 37 % 3900) / 100.0::DOUBLE AS lat,
  CASE WHEN c_custkey % 11 <> 0 THEN 64 + (c_custkey * 53 % 3700) / 100.0::DOUBLE END AS lon,
  CASE WHEN c_custkey % 2 = 0 THEN 'net' ELSE '' END AS owner, 2 AS sensors FROM customer""")
def locations(t):
    even = F.col("location_id") % 2 == 0
    page = found_locations(t).select(F.array(F.struct(
        F.col("location_id").alias("id"), "name", "locality", "city",
        F.struct(F.col("lat").alias("latitude"), F.col("lon").alias("longitude"))
        .alias("coordinates"),
        F.when(even, F.array(F.struct(F.col("owner").alias("name"))))
        .otherwise(F.array().cast("array<struct<name: string>>")).alias("providers"),
        "sensors")).alias("results"))
    found = readers.read_locations(t.spark, land(t, page, "locations"))
    return found.withColumn("sensors", F.size("sensors"))


def measurement_pages(t):
    """One page per event; a third of them use the other name of the period's start."""
    text = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    key = F.col("event_id")
    moment = F.struct(text.alias("utc"))
    period = F.struct(F.when(key % 3 != 0, moment).alias("datetimeFrom"),
                      F.when((key % 3 == 0) & (key % 9 != 0), moment).alias("dateFrom"))
    result = F.struct(F.when(key % 10 != 0, F.col("value")).alias("value"),
                      period.alias("period"))
    return t.table("events").select(
        F.col("user_id").alias("sensor_id"), F.expr("user_id div 8").alias("location_id"),
        F.struct(F.upper("event_type").alias("name")).alias("parameter"),
        F.array(result).alias("results"))


@query("s02_read_measurements", "sensor_id:i ts:t value:f", sql="""
SELECT user_id AS sensor_id, ts, value FROM events
WHERE event_id % 10 <> 0 AND event_id % 9 <> 0""")
def measurements(t):
    return readers.read_hourly_measurements(
        t.spark, land(t, measurement_pages(t), "measurements"))


@query("s03_read_pollutants", "location_id:i parameter:s ts:t value:f", sql="""
SELECT user_id // 8 AS location_id, event_type AS parameter, ts, value FROM events
WHERE event_id % 10 <> 0 AND event_id % 9 <> 0 AND event_type IN ('click', 'view')""")
def pollutants(t):
    return readers.read_parameter_measurements(
        t.spark, land(t, measurement_pages(t), "pollutants"), ["click", "view"])


DELIVERED = [c for c in fixed.WEATHER if c not in ("cloud_cover", "boundary_layer_height")]


@query("s04_read_weather", "cell_lat:f timestamp:t " + " ".join(f"{c}:f" for c in fixed.WEATHER),
       views="weather", sql="""
SELECT CAST(replace(station, 'st_', '') AS DOUBLE) AS cell_lat, timestamp, """ + ", ".join(
    f"temperature_2m + {i} AS {c}" for i, c in enumerate(DELIVERED)) + """,
  NULL AS cloud_cover, 0 AS boundary_layer_height FROM weather
WHERE temperature_2m > 3""")
def weather(t):
    """Documents lack two of the ten variables."""
    warm = F.when(F.col("temperature_2m") > 3, F.col("temperature_2m"))
    rows = t.weather().withColumn("_cell", F.substring_index("station", "_", -1).cast("double"))
    values = [F.coalesce(warm + i, F.lit(float("nan"))).alias(c) for i, c in enumerate(DELIVERED)]
    # one document per cell and day: at most 24 entries
    days = rows.groupBy("_cell", F.to_date("timestamp").alias("_day")).agg(F.sort_array(
        F.collect_list(F.struct(
            F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm").alias("time"), *values))).alias("_h"))
    nulled = [F.transform(f"_h.{c}", lambda x: F.when(~F.isnan(x), x)).alias(c) for c in DELIVERED]
    docs = days.select(F.col("_cell").alias("cell_lat"), F.col("_cell").alias("cell_lon"),
                       F.struct(F.col("_h.time").alias("time"), *nulled).alias("hourly"))
    path = land(t, docs, "weather", ignoreNullFields="false")
    return readers.read_weather(t.spark, path)


@query("s05_read_fires", "timestamp:t latitude:f longitude:f frp:f bright_ti4:f", views="fires",
       sql="""SELECT date_trunc('hour', timestamp) AS timestamp, latitude, longitude, frp,
  bright_ti4 FROM fires WHERE frp > 5""")
def fires(t):
    table = t.fires().select(
        "latitude", "longitude", "bright_ti4", "bright_ti5",
        F.when(F.col("frp") > 5, F.col("frp")).alias("frp"),
        F.date_format("timestamp", "yyyy-MM-dd").alias("acq_date"),
        # leading zeros are lost, as in the delivered files
        F.date_format("timestamp", "HHmm").cast("int").cast("string").alias("acq_time"))
    return readers.read_fires(t.spark, land(t, table, "fires", "csv", header=True))


@query("s06_read_archive", "location_id:i timestamp:t pm25:f", sql="""
SELECT k AS location_id, date_trunc('hour', ts) AS timestamp,
  avg(least(greatest(o_totalprice / 200 - 100, 0), 1500)) AS pm25
FROM (SELECT *, o_custkey % 4 AS k,
    o_orderdate + INTERVAL 1 MINUTE * CAST(o_orderkey % 1440 AS INT) AS ts FROM orders)
WHERE o_orderdate >= '1996-03-01' AND o_orderdate < '1998-02-11' AND k <> 2 AND
  (o_orderkey % 5 <> 0 OR year(ts) = 1997)
GROUP BY 1, 2""")
def archive(t):
    """Archive files whose columns differ by year; 1997 has no parameter column, and later files have 20
    columns, the value among the last."""
    key = F.col("o_orderkey")
    when = F.col("o_orderdate") + F.make_dt_interval(mins=(key % 1440).cast("int"))
    rows = t.table("orders").select(
        (F.col("o_custkey") % 4).alias("locationid"), F.year("o_orderdate").alias("year"),
        F.month("o_orderdate").alias("month"), iso_text(when).alias("time"),
        (F.col("o_totalprice") / 200 - 100).cast("string").alias("v"),
        F.when(key % 5 == 0, "no2").otherwise("PM25").alias("p"))
    root = new_path(t.spark, "archive")
    layouts = [("year = 1997", ["time as date_utc", "v as average"]),
               ("year < 1997", ["p as parameter", "time as datetime", "v as value"]),
               ("year > 1997", ["time as utc", *[f"'a, \"b\"' as note{i}" for i in range(17)],
                                "v as Value", "p as Parameter"])]
    for years, columns in layouts:
        (rows.filter(years).selectExpr(*columns, "locationid", "year", "month")
         .repartition("locationid", "year", "month")
         .write.mode("append").partitionBy("locationid", "year", "month")
         .option("header", True).option("compression", "gzip").csv(root))
    ids = t.table("orders").select((F.col("o_custkey") % 4).alias("location_id")).distinct()
    stations = ids.filter("location_id <> 2").select(
        "location_id", F.col("location_id").cast("string").alias("station"),
        F.lit("x").alias("city"), F.lit(1.0).alias("lat"), F.lit(2.0).alias("lon"))
    texts = readers.read_archive(t.spark, root, stations, "1996-03-01", "1998-02-10")
    return history.build_history(texts, stations)


@query("s07_read_articles", "timestamp:t text:s", views="articles", sql="""
SELECT timestamp, concat_ws(' ', 'T' || CAST(doc_id AS VARCHAR), text) AS text FROM articles
WHERE doc_id % 8 <> 0""")
def articles(t):
    published = F.when(F.col("doc_id") % 8 == 0, "yesterday").otherwise(iso_text("timestamp"))
    page = t.articles().select(F.array(F.struct(
        F.concat(F.lit("T"), F.col("doc_id").cast("string")).alias("title"),
        F.col("text").alias("description"), published.alias("publishedAt"))).alias("articles"))
    return readers.read_articles(t.spark, land(t, page, "articles"))


REGISTRY_OUT = "station:s location_id:i sensor_id:i lat:f lon:f city:s"


@query("s08_read_registry", REGISTRY_OUT, sql=f"SELECT * FROM {REGISTRY}")
def read_registry(t):
    """The cleaned file does not exist, so the next one is read."""
    path = new_path(t.spark, "registry")
    writers.write_registry(registry.build_registry(found_locations(t)), path)
    return readers.read_registry(t.spark, path + "-clean", path)


@query("s08_read_registry_list", REGISTRY_OUT, sql=f"SELECT * FROM {REGISTRY}")
def read_registry_list(t):
    """The registry as one indented list of documents."""
    stations = registry.build_registry(found_locations(t))
    text = stations.select(F.to_json(F.struct("*"), {"pretty": "true"}).alias("d")).agg(
        F.concat(F.lit("[\n"), F.array_join(F.collect_list("d"), ",\n"), F.lit("\n]")).alias("value"))
    path = new_path(t.spark, "registry")
    text.write.text(path)
    return readers.read_registry(t.spark, path)


# --- tables --------------------------------------------------------------------------------

@query("s09_read_live", "station:s pm25:f no2:f", views="raw",
       sql="SELECT station, pm25, 0 AS no2 FROM raw WHERE event_id % 4 <> 0")
def read_live(t):
    """A table without targets, as it is scored."""
    known = F.when(F.col("event_id") % 4 != 0, F.col("pm25"))
    path = new_path(t.spark, "live")
    t.raw().withColumn("pm25", known).write.parquet(path)
    return readers.read_live(t.spark, path)


@query("s09_read_dataset", "station:s pm25:f no2:f target_24h:f", views="raw", sql="""
SELECT station, pm25, 0 AS no2, pm25 AS target_24h FROM raw WHERE event_id % 4 <> 0""")
def read_dataset(t):
    known = F.when(F.col("event_id") % 4 != 0, F.col("pm25"))
    path = new_path(t.spark, "dataset")
    t.raw().withColumns({h: known for h in fixed.TARGETS}).write.parquet(path)
    return readers.read_dataset(t.spark, path)


@query("s10_write_dataset", "station:s timestamp:t pm25:f date:s", views="hourly", sql="""
SELECT *, CAST(timestamp AS DATE) AS date FROM hourly""")
def write_dataset(t):
    path = new_path(t.spark, "dataset")
    writers.write_dataset(t.hourly(), path)
    return t.spark.read.parquet(path)


@query("s11_write_registry", REGISTRY_OUT, views="places",
       sql="SELECT station, location_id, sensor_id, lat, lon, city FROM places")
def write_registry(t):
    path = new_path(t.spark, "registry")
    writers.write_registry(t.places().drop("name", "acctbal"), path)
    return readers.read_registry(t.spark, path)


@query("s12_dataset_meta", "n_stations:i first:s last:s columns:i", views="hourly", sql="""
SELECT count(DISTINCT station) AS n_stations, strftime(min(timestamp), '%Y-%m-%d %H:%M:%S')
  AS first, strftime(max(timestamp), '%Y-%m-%d %H:%M:%S') AS last, 3 AS columns FROM hourly""")
def meta(t):
    path = new_path(t.spark, "meta")
    writers.write_dataset_meta(t.hourly(), path)
    schema = "n_stations bigint, date_range array<string>, all_columns array<string>"
    return t.spark.read.schema(schema).json(path).select(
        "n_stations", F.col("date_range")[0].alias("first"),
        F.col("date_range")[1].alias("last"), F.size("all_columns").alias("columns"))


@query("s13_write_metrics", "horizon:s mae:f6", views="hourly", sql="""
SELECT 't+' || CAST(h AS VARCHAR) || 'h' AS horizon, avg(abs(y - pm25)) AS mae FROM (""" +
       " UNION ALL ".join(f"SELECT {h} AS h, pm25, lead(pm25, {h}) OVER (PARTITION BY station "
                          f"ORDER BY timestamp) AS y FROM hourly" for h in range(1, 25))
       + ") GROUP BY h")
def metrics(t):
    path = new_path(t.spark, "metrics")
    writers.write_metrics(horizon_metrics(naive(t.hourly())), path)
    return t.spark.read.schema("horizon string, mae double").json(path)


@query("s15_write_read_params", "name:s center:f scale:f id:i", views="hourly", sql="""
SELECT 'pm25' AS name, quantile_cont(pm25, 0.5) AS center,
  quantile_cont(pm25, 0.75) - quantile_cont(pm25, 0.25) AS scale, NULL AS id FROM hourly
UNION ALL SELECT station, NULL, NULL, row_number() OVER (ORDER BY station) FROM (
  SELECT DISTINCT station FROM hourly)""")
def params(t):
    path = new_path(t.spark, "params")
    hourly = t.hourly()
    writers.write_params(path, fit_robust(hourly, ["pm25"]), station_ids(hourly), ["pm25"])
    scaler, ids, order = writers.read_params(t.spark, path)
    return scaler.filter(F.col("feature").isin(order)).select(
        F.col("feature").alias("name"), "center", "scale",
        F.lit(None).cast("int").alias("id")).unionByName(
        ids.select(F.col("station").alias("name"), F.lit(None).cast("double").alias("center"),
                   F.lit(None).cast("double").alias("scale"), F.col("station_id").alias("id")))


@query("s16_append_new", "station:s timestamp:t pm25:f", views="hourly",
       sql="SELECT * FROM hourly")
def append_new(t):
    """Two runs: the first stores some stations, the second only the others."""
    path = new_path(t.spark, "progress")
    hourly = t.hourly()
    writers.append_new(hourly.filter("station < 'st_3'"), path)
    writers.append_new(hourly, path)
    return t.spark.read.parquet(path)


@query("s16_append_hours", "station:s timestamp:t pm25:f", views="hourly",
       sql="SELECT station, timestamp, pm25 FROM hourly")
def append_hours(t):
    """The first run stores some hours of each station, the second the others."""
    path = new_path(t.spark, "hours")
    hourly = t.hourly().select("station", "timestamp", "pm25")
    writers.append_hours(hourly.filter("hour(timestamp) % 3 = 0 OR station < 'st_3'"), path)
    writers.append_hours(hourly, path)
    return t.spark.read.parquet(path).drop("date")
