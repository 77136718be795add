"""Filters, cleaning and projections P1–P24."""

from pyspark.sql import functions as F

from aqspark.functions import fixed
from aqspark.functions.text import city_label, is_pm25, is_pm25_archive, station_slug
from aqspark.operators import clean
from aqspark.operators.windows import add_lags, add_targets
from aqspark.queries.base import query


def scattered(t):
    """Events thrown over a region, some without a position."""
    key = F.col("event_id")
    return t.table("events").select(
        "event_id", F.when(key % 17 != 0, F.col("value") / 10).alias("lat"),
        F.when(key % 19 != 0, (60 + key % 50).cast("double")).alias("lon"))


SCATTERED = """(SELECT event_id, CASE WHEN event_id % 17 <> 0 THEN value / 10 END AS lat,
  CASE WHEN event_id % 19 <> 0 THEN CAST(60 + event_id % 50 AS DOUBLE) END AS lon FROM events)"""


def box_sql(box):
    return (f"coalesce(lat BETWEEN {box[0]} AND {box[1]} AND lon BETWEEN {box[2]} AND {box[3]}, "
            "false)")


@query("p01_in_wide_box", "event_id:i lat:f lon:f",
       sql=f"SELECT * FROM {SCATTERED} WHERE {box_sql(fixed.WIDE_BOX)}")
def in_wide_box(t):
    return clean.in_bbox(scattered(t))


@query("p02_in_inner_box", "event_id:i lat:f lon:f",
       sql=f"SELECT * FROM {SCATTERED} WHERE {box_sql(fixed.INNER_BOX)}")
def in_inner_box(t):
    return clean.in_bbox(scattered(t), fixed.INNER_BOX)


PRODUCTIVE = ("coalesce(" + " OR ".join(
    f"id BETWEEN {lo} AND {hi}" for lo, hi in fixed.SENSOR_RANGES)
    + f" OR id IN ({', '.join(map(str, fixed.SENSOR_EXCEPTIONS))}), false)")
SENSORS = """(SELECT o_orderkey, CASE WHEN o_orderkey % 10 <> 0 THEN o_orderkey * 12007 % 18000000 END
  AS id FROM orders)"""


def order_sensors(t):
    key = F.col("o_orderkey")
    return t.table("orders").select(
        "o_orderkey", F.when(key % 10 != 0, key * 12007 % 18_000_000).alias("id"))


@query("p03_productive_sensor", "o_orderkey:i id:i",
       sql=f"SELECT * FROM {SENSORS} WHERE {PRODUCTIVE}")
def productive(t):
    return clean.productive_sensors(order_sensors(t), "id")


@query("p04_reject_reason", "event_id:i reason:s", sql=f"""
SELECT event_id, CASE WHEN id IS NULL THEN 'no sensor'
  WHEN NOT {box_sql(fixed.INNER_BOX)} THEN 'outside area'
  WHEN NOT {PRODUCTIVE} THEN 'unproductive sensor' END AS reason
FROM (SELECT *, CASE WHEN event_id % 10 <> 0 THEN event_id * 1801 % 18000000 END AS id
      FROM {SCATTERED})""")
def reject(t):
    key = F.col("event_id")
    df = scattered(t).withColumn("id", F.when(key % 10 != 0, key * 1801 % 18_000_000))
    return clean.reject_reason(df, sensor="id")


PARAMETERS = ["pm25", "PM2.5 ug/m3", "pm2x5", "no2", None]


def named_parts(t):
    names = F.array(*[F.lit(p) for p in PARAMETERS])
    return t.table("part").select(
        "p_partkey", F.element_at(names, (F.col("p_partkey") % 5 + 1).cast("int"))
        .alias("parameter"))


@query("p05_select_parameter", "p_partkey:i parameter:s strict:i loose:i", sql="""
SELECT p_partkey, parameter, CAST(contains(lower(coalesce(parameter, '')), 'pm25') OR
    contains(lower(coalesce(parameter, '')), 'pm2.5') AS INT) AS strict,
  CAST(regexp_matches(lower(parameter), 'pm25|pm2.5') AS INT) AS loose
FROM (SELECT p_partkey, ['pm25', 'PM2.5 ug/m3', 'pm2x5', 'no2', NULL][p_partkey % 5 + 1]
        AS parameter FROM part)""")
def parameter_rules(t):
    return named_parts(t).select(
        "p_partkey", "parameter", is_pm25("parameter").cast("int").alias("strict"),
        is_pm25_archive("parameter").cast("int").alias("loose"))


@query("p06_filter_cities", "station:s city:s", views="places",
       sql="SELECT station, city FROM places WHERE lower(city) IN ('nation_3', 'nation_7')")
def cities(t):
    return clean.filter_cities(t.places(), ["Nation_3", "NATION_7"])


@query("p07_valid_range", "l_orderkey:i l_linenumber:i l_suppkey:i l_partkey:i pm25:f", sql="""
SELECT l_orderkey, l_linenumber, l_suppkey, l_partkey, l_extendedprice / 25 - 100 AS pm25
FROM lineitem WHERE l_extendedprice / 25 - 100 BETWEEN 0 AND 1500""")
def valid(t):
    return clean.valid_range(prices(t))


def prices(t):
    return t.table("lineitem").select(
        "l_orderkey", "l_linenumber", "l_suppkey", "l_partkey",
        (F.col("l_extendedprice") / 25 - 100).alias("pm25"))


@query("p08_clip", "l_orderkey:i l_linenumber:i l_suppkey:i l_partkey:i pm25:f", sql="""
SELECT l_orderkey, l_linenumber, l_suppkey, l_partkey,
  least(greatest(l_extendedprice / 25 - 100, 0), 1500) AS pm25 FROM lineitem""")
def clipped(t):
    return clean.clip(prices(t))


@query("p09_coerce", "o_orderkey:i timestamp:t pm25:f", sql="""
SELECT o_orderkey, o_orderdate AS timestamp, o_totalprice AS pm25 FROM orders
WHERE o_orderkey % 7 <> 0 AND o_orderkey % 11 <> 0 AND o_orderkey % 13 <> 0""")
def coerced(t):
    key = F.col("o_orderkey")
    texts = t.table("orders").select(
        "o_orderkey",
        F.when(key % 7 == 0, "2024-13-45").otherwise(
            F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'")).alias("timestamp"),
        F.when(key % 11 == 0, "n/a").when(key % 13 == 0, "NaN")
        .otherwise(F.col("o_totalprice").cast("string")).alias("pm25"))
    return clean.coerce(texts)


@query("p10_resolve_columns", "timestamp:t pm25:f parameter:s",
       sql="SELECT ts AS timestamp, value AS pm25, event_type AS parameter FROM events")
def resolved(t):
    odd = t.table("events").select(F.col("ts").alias("datetime"), F.col("ts").alias("utc"),
                                   F.col("value").alias("average"),
                                   F.col("event_type").alias("Parameter"))
    return clean.resolve_columns(odd, {"timestamp": fixed.TIME_ALIASES,
                                       "pm25": fixed.VALUE_ALIASES,
                                       "parameter": fixed.PARAMETER_ALIASES})


@query("p11_min_records", "station:s timestamp:t pm25:f", views="hourly", sql="""
SELECT * FROM hourly WHERE station IN (SELECT station FROM hourly GROUP BY station
  HAVING count(*) >= 360)""")
def enough(t):
    return clean.min_records(t.hourly(), 360)


LEADS = ", ".join(f"lead(pm25, {h}) OVER w AS target_{h}h" for h in range(1, 25))


@query("p12_drop_incomplete", "station:s timestamp:t pm25_lag24:f target_24h:f", views="hourly",
       sql=f"""SELECT * FROM (SELECT *, lag(pm25, 24) OVER w AS pm25_lag24, {LEADS} FROM hourly
  WINDOW w AS (PARTITION BY station ORDER BY timestamp))
WHERE pm25_lag24 IS NOT NULL AND target_24h IS NOT NULL""")
def complete(t):
    return clean.drop_incomplete(add_targets(add_lags(t.hourly())))


@query("p13_drop_any_null", "event_id:i lat:f lon:f",
       sql=f"SELECT * FROM {SCATTERED} WHERE lat IS NOT NULL AND lon IS NOT NULL")
def no_nulls(t):
    return clean.drop_any_null(scattered(t))


@query("p14_ensure_columns", "event_id:i lat:f lon:f pm10:f news:f",
       sql=f"SELECT *, 0.0 AS pm10, 0.5 AS news FROM {SCATTERED}")
def ensured(t):
    return clean.ensure_columns(scattered(t), {"lat": 1.0, "pm10": 0.0, "news": 0.5})


@query("p15_zero_fill", "event_id:i lat:f lon:f",
       sql=f"SELECT event_id, coalesce(lat, 0.0) AS lat, lon FROM {SCATTERED}")
def zeros(t):
    return clean.zero_fill(scattered(t), ["lat"])


@query("p16_project_features", "timestamp:t station:s lat:f pm25:f", views="raw",
       sql="SELECT ts AS timestamp, station, 1.5 AS lat, pm25 FROM raw")
def projected(t):
    df = t.raw().withColumnRenamed("ts", "timestamp").withColumn("lat", F.lit(1.5))
    return clean.project_features(df, cols=["lat", "pm25"])


@query("p17_to_float32", "event_id:i value:f event_type:s", sql="""
SELECT CAST(event_id AS FLOAT) AS event_id, CAST(value AS FLOAT) AS value, event_type
FROM events""")
def narrow(t):
    return clean.to_float32(t.table("events").select("event_id", "value", "event_type"))


@query("p18_station_slug", "p_partkey:i slug:s", sql="""
SELECT p_partkey, lower(substr(replace(replace(coalesce(nullif(name, ''),
    'loc_' || CAST(p_partkey AS VARCHAR)), ' ', '_'), ',', ''), 1,
    49 - length(CAST(p_partkey AS VARCHAR))) || '_' || CAST(p_partkey AS VARCHAR)) AS slug
FROM (SELECT p_partkey, CASE WHEN p_partkey % 9 = 0 THEN NULL WHEN p_partkey % 8 = 0 THEN ''
        ELSE p_name || ', ' || p_brand || ' ' || p_type || ' measuring site, North' END
        AS name FROM part)""")
def slug(t):
    key = F.col("p_partkey")
    long_name = F.concat("p_name", F.lit(", "), "p_brand", F.lit(" "), "p_type",
                         F.lit(" measuring site, North"))
    name = F.when(key % 9 == 0, F.lit(None)).when(key % 8 == 0, "").otherwise(long_name)
    return t.table("part").select("p_partkey", station_slug(name, key).alias("slug"))


@query("p19_city_label", "c_custkey:i city:s", sql="""
SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 AND c_custkey % 5 = 0 THEN 'Unknown'
  WHEN c_custkey % 3 = 0 THEN c_mktsegment ELSE c_name END AS city FROM customer""")
def label(t):
    key = F.col("c_custkey")
    locality = F.when(key % 6 == 0, "").when(key % 3 != 0, F.col("c_name"))
    town = F.when(key % 5 != 0, F.col("c_mktsegment"))
    return t.table("customer").select("c_custkey", city_label(locality, town).alias("city"))


@query("p20_find_stations", "station:s city:s", views="places", sql="""
SELECT station, city FROM places WHERE contains(lower(station), 'n_1') OR
  contains(lower(city), 'n_1')""")
def find(t):
    return clean.find_stations(t.places(), "N_1")


SHOWN = ["news_dust_storm", "news_calamity", "is_monsoon"]


@query("p21_active_signals", "event_id:i signal:s strength:f", sql=" UNION ALL ".join(
    f"SELECT event_id, '{s}' AS signal, round_even(CAST(value AS DECIMAL(18,2)) % {n}, 2) "
    f"AS strength FROM events WHERE CAST(value AS DECIMAL(18,2)) % {n} > 0.1"
    for n, s in enumerate(SHOWN, 1)))
def signals(t):
    value = F.col("value").cast("decimal(18,2)")
    df = t.table("events").withColumns({s: value % n for n, s in enumerate(SHOWN, 1)})
    return df.select("event_id", F.explode(clean.active_signals(SHOWN)).alias("signal", "strength"))


@query("p22_sensor_candidates", "s_suppkey:i ids:s first:i", sql="""
SELECT s_suppkey, concat_ws(',', s_suppkey + 1000, s_suppkey) AS ids, s_suppkey + 1000 AS first
FROM supplier WHERE s_suppkey % 4 <> 0""")
def candidates(t):
    def sensor(key, name):
        return F.struct(key.alias("id"), F.struct(name.alias("name")).alias("parameter"))
    key = F.col("s_suppkey")
    name = F.when(key % 4 != 0, F.lit("PM25"))
    sensors = F.array(sensor(key, name), sensor(key + 500, F.lit("no2")),
                      sensor(key + 1000, F.concat(name, F.lit(" raw"))))
    df = t.table("supplier").withColumn("ids", clean.sensor_candidates(sensors))
    return df.filter(F.size("ids") > 0).select(
        "s_suppkey", F.array_join("ids", ",").alias("ids"),
        F.get("ids", F.lit(0)).alias("first"))


@query("p23_effective_start", "event_id:i station:s ts:t", views="raw", sql="""
SELECT event_id, station, ts FROM raw JOIN (SELECT station, min(ts) AS a, max(ts) AS b,
  CAST(replace(station, 'st_', '') AS INT) AS k FROM raw GROUP BY station) USING (station)
WHERE ts >= CASE WHEN k % 2 = 0 THEN least(DATE '2024-01-10', CAST(a AS DATE) + 3)
  ELSE DATE '2024-01-10' END""")
def effective(t):
    raw = t.raw()
    k = F.substring_index("station", "_", -1).cast("int")
    # even stations know an own start, three days after their first reading
    known = F.date_format(F.min("ts") + F.expr("INTERVAL 3 DAYS"), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    stations = raw.groupBy("station").agg(
        known.alias("data_start"), F.date_format(F.max("ts"), "yyyy-MM-dd").alias("e"))
    stations = stations.withColumn("data_end", F.when(k % 2 == 0, F.col("e"))
                                   .otherwise(F.col("data_start")))
    return clean.effective_start(raw, stations, "2024-01-10", ts="ts")


@query("p24_has_location", "c_custkey:i location_id:i", sql="""
SELECT c_custkey, c_nationkey AS location_id FROM customer WHERE c_nationkey % 3 <> 0""")
def located(t):
    nation = F.col("c_nationkey")
    df = t.table("customer").select(
        "c_custkey", F.when(nation % 3 != 0, nation).alias("location_id"))
    return clean.has_location(df)
