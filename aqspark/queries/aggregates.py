"""Aggregations A1–A16 and the naive forecasts M7."""

from pyspark.sql import functions as F

from aqspark.operators import aggregate, metrics, scaling, sketches
from aqspark.operators.spatial import fire_hourly
from aqspark.operators.windows import add_targets
from aqspark.plans.learning import naive
from aqspark.plans.news import article_counts, matched_articles
from aqspark.queries.base import haversine_sql, query
from aqspark.queries.scalars import PLACES, TERMS, mention_sql
from aqspark.sources.writers import write_dataset
from aqspark.storage import new_path


@query("a01_hourly_mean", "station:s timestamp:t pm25:f", views="hourly",
       sql="SELECT * FROM hourly")
def hourly(t):
    return t.hourly()


@query("a01_hourly_mean_clipped", "station:s timestamp:t pm25:f", views="raw", sql="""
SELECT station, date_trunc('hour', ts) AS timestamp,
  avg(least(greatest(pm25 * 8 - 500, 0), 1500)) AS pm25 FROM raw GROUP BY ALL""")
def hourly_clipped(t):
    wide = t.raw().withColumn("pm25", F.col("pm25") * 8 - 500)
    return aggregate.hourly_mean(wide, ts="ts", policy="clip_before")


FIRE_HOURS = f"""SELECT station, date_trunc('hour', timestamp) AS timestamp,
  count(frp) AS fire_count, sum(frp) AS frp_sum, avg(frp) AS frp_mean, max(frp) AS frp_max,
  avg(bright_ti4) AS bright_ti4_mean, avg(bright_ti5) AS bright_ti5_mean
FROM fires JOIN {{places}} ON {haversine_sql('lat', 'lon', 'latitude', 'longitude')} <= 300
GROUP BY ALL"""
FIRE_OUT = ("fire_count:i frp_sum:f frp_mean:f frp_max:f bright_ti4_mean:f bright_ti5_mean:f")


@query("a02_fire_hours", f"station:s timestamp:t {FIRE_OUT}", views="fires places",
       sql=FIRE_HOURS.format(places="places"))
def fire_hours(t):
    return fire_hourly(t.places(), t.fires())


@query("a03_article_counts", "timestamp:t " + " ".join(f"{s}:i" for s in TERMS),
       views="articles", sql="SELECT date_trunc('hour', timestamp) AS timestamp, " + ", ".join(
           f"nullif(sum(CAST({mention_sql(terms)} AS INT) * n), 0) AS {s}"
           for s, terms in TERMS.items()) + " FROM (SELECT *, " + " + ".join(
           f"CAST({mention_sql(terms)} AS INT)" for terms in PLACES.values())
       + """ AS n FROM articles) GROUP BY 1
HAVING """ + " OR ".join(f"{s} IS NOT NULL" for s in TERMS))
def counts(t):
    return article_counts(matched_articles(t.articles(), TERMS, PLACES), keys=(), signals=TERMS)


@query("a04_sensor_coverage", "sensor_id:i first_ts:t last_ts:t n:i", views="raw", sql="""
SELECT sensor_id, min(ts) AS first_ts, max(ts) AS last_ts, count(*) AS n FROM raw GROUP BY 1""")
def coverage(t):
    return aggregate.sensor_coverage(t.raw(), ts="ts")


# a station lists three sensors; the first may have no data
SITES = """(SELECT 'site_' || CAST(k AS VARCHAR) AS station,
  [CASE WHEN k % 2 = 0 THEN -1 ELSE k END, k + 1, k + 2] AS ids
  FROM (SELECT DISTINCT user_id AS k FROM events))"""


def sites(t):
    k = F.col("user_id")
    first = F.when(k % 2 == 0, F.lit(-1)).otherwise(k).cast("bigint")
    return t.table("events").select("user_id").distinct().select(
        F.concat(F.lit("site_"), k.cast("string")).alias("station"),
        first.alias("sensor_id"), F.array(first, k + 1, k + 2).alias("sensor_ids"),
        F.lit("somewhere").alias("city"))


@query("a05_first_working_sensor", "station:s sensor_id:i data_start:s data_end:s", views="raw",
       sql=f"""
SELECT station, arg_min(sensor_id, i) AS sensor_id,
  strftime(arg_min(a, i), '%Y-%m-%dT%H:%M:%SZ') AS data_start,
  strftime(arg_min(b, i), '%Y-%m-%dT%H:%M:%SZ') AS data_end
FROM (SELECT station, unnest(ids) AS sensor_id, unnest([1, 2, 3]) AS i FROM {SITES})
JOIN (SELECT sensor_id, min(ts) AS a, max(ts) AS b FROM raw GROUP BY 1) USING (sensor_id)
GROUP BY station""")
def working(t):
    return aggregate.first_working_sensor(sites(t), aggregate.sensor_coverage(t.raw(), ts="ts"))


@query("a06_stations_per_city", "city:s n:i", views="places",
       sql="SELECT city, count(*) AS n FROM places GROUP BY 1")
def per_city(t):
    return aggregate.stations_per_city(t.places())


CUSTOMER_SPANS = """(SELECT c_custkey, n_name AS city,
  strftime(min(o_orderdate), '%Y-%m-%dT%H:%M:%SZ') AS data_start,
  strftime(max(o_orderdate), '%Y-%m-%dT%H:%M:%SZ') AS data_end
  FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN orders ON o_custkey = c_custkey
  GROUP BY 1, 2)"""


@query("a07_city_coverage", "city:s n:i earliest:s latest:s is_early:i n_early:i", sql=f"""
SELECT city, count(*) AS n, substr(min(data_start), 1, 10) AS earliest,
  substr(max(data_end), 1, 10) AS latest, max(CAST(substr(data_start, 1, 4) < '1996' AS INT))
  AS is_early, sum(CAST(substr(data_start, 1, 4) < '1996' AS INT)) AS n_early
FROM {CUSTOMER_SPANS} GROUP BY 1""")
def city_spans(t):
    spans = t.table("orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(
        aggregate.iso_text(F.min("o_orderdate")).alias("data_start"),
        aggregate.iso_text(F.max("o_orderdate")).alias("data_end"))
    customers = t.table("customer").join(
        t.table("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    named = customers.select("c_custkey", F.col("n_name").alias("city"))
    return aggregate.city_coverage(named.join(spans, "c_custkey"), before="1996")


@query("a08_dataset_summary",
       "n_rows:i n_stations:i first_ts:t last_ts:t min_value:f max_value:f", views="hourly",
       sql="""SELECT count(*) AS n_rows, count(DISTINCT station) AS n_stations,
  min(timestamp) AS first_ts, max(timestamp) AS last_ts, min(pm25) AS min_value,
  max(pm25) AS max_value FROM hourly""")
def summary(t):
    return aggregate.dataset_summary(t.hourly())


SCALED = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def params_sql(name, col, source):
    q = f"quantile_cont({col}, {{}})"
    spread = f"({q.format(0.75)} - {q.format(0.25)})"
    return (f"SELECT '{name}' AS feature, {q.format(0.5)} AS center, "
            f"CASE WHEN {spread} = 0 THEN 1 ELSE {spread} END AS scale FROM {source}")


@query("a09_robust_params", "feature:s center:f scale:f",
       sql=" UNION ALL ".join([params_sql(c, c, "lineitem") for c in SCALED]
                              + [params_sql("flat", "CAST(l_orderkey % 10 = 0 AS DOUBLE)",
                                            "lineitem")]))
def robust(t):
    flat = (F.col("l_orderkey") % 10 == 0).cast("double")
    return scaling.fit_robust(t.table("lineitem").withColumn("flat", flat), SCALED + ["flat"])


# hours that arrive in a second delivery: the end of each month, and one station's hours of a day stored before
LATE = "(day(timestamp) > 20 OR (day(timestamp) = 5 AND station = 'st_0'))"


@query("a09_stored_scales", "feature:s center:f scale:f days_read:i", views="hourly",
       sql="SELECT s.*, d.days_read FROM (" + " UNION ALL ".join(
           params_sql(name, value, "hourly") for name, value in
           (("pm25", "pm25"), ("hour", "CAST(hour(timestamp) AS DOUBLE)")))
       + f""") s, (SELECT count(DISTINCT CAST(timestamp AS DATE)) AS days_read FROM hourly
  WHERE {LATE}) d""")
def stored_scales(t):
    """Sketches of a first delivery are stored; after the second, only the days it touches are read for new ones."""
    path, stored, cols = new_path(t.spark, "days"), new_path(t.spark, "sketches"), ["pm25", "hour"]
    hourly = t.hourly().withColumn("hour", F.hour("timestamp").cast("double"))
    write_dataset(hourly.filter(f"NOT {LATE}"), path)
    sketches.refresh(t.spark.read.parquet(path), stored, cols)
    write_dataset(hourly.filter(LATE), path, mode="append")
    rows = t.spark.read.parquet(path)
    days = sketches.refresh(rows, stored, cols)
    found = sketches.stored_scales(rows, sketches.read_sketches(t.spark, stored), cols)
    return found.withColumn("days_read", F.lit(len(days)))


@query("a10_pooled_params", "feature:s center:f scale:f", views="hourly",
       sql=params_sql("target", "v", "(SELECT unnest([" + ", ".join(
           f"lead(pm25, {h}) OVER (PARTITION BY station ORDER BY timestamp)"
           for h in range(1, 25)) + "]) AS v FROM hourly)"))
def pooled(t):
    return scaling.fit_robust_pooled(add_targets(t.hourly()))


W = "(PARTITION BY station ORDER BY timestamp)"
PAIRS = {
    "persistence": "(" + " UNION ALL ".join(
        f"SELECT station, timestamp, {h} AS horizon, lead(pm25, {h}) OVER {W} AS y_true, "
        f"pm25 AS y_pred FROM hourly" for h in range(1, 25)) + ")",
    "yesterday": "(" + " UNION ALL ".join(
        f"SELECT station, timestamp, {h} AS horizon, lead(pm25, {h}) OVER {W} AS y_true, "
        f"lag(pm25, {24 - h}) OVER {W} AS y_pred FROM hourly" for h in range(1, 25)) + ")",
}


@query("a11_horizon_metrics", "horizon:i n:i mae:f rmse:f r2:f", views="hourly", sql=f"""
SELECT horizon, count(*) AS n, avg(abs(y_true - y_pred)) AS mae,
  sqrt(avg(pow(y_true - y_pred, 2))) AS rmse,
  1 - avg(pow(y_true - y_pred, 2)) / var_pop(y_true) AS r2
FROM {PAIRS['persistence']} WHERE y_true IS NOT NULL AND y_pred IS NOT NULL GROUP BY 1""")
def errors(t):
    return metrics.horizon_metrics(naive(t.hourly()))


def huber_sql(delta, weight):
    steps = "(SELECT CAST(unnest(range(24)) AS DOUBLE) AS k)"
    size = "abs(y_true - y_pred)"
    return f"""SELECT avg({weight} / total * CASE WHEN {size} < {delta} THEN pow({size}, 2) / 2
  ELSE {delta} * ({size} - {delta} / 2) END) AS loss
FROM (SELECT *, CAST(horizon - 1 AS DOUBLE) AS k FROM {PAIRS['persistence']}),
  (SELECT sum({weight}) AS total FROM {steps})"""


@query("a12_weighted_huber", "near:f far:f", views="hourly", sql=f"""
SELECT a.loss AS near, b.loss AS far FROM ({huber_sql(15.0, 'exp(-0.04 * k)')}) a,
  ({huber_sql(1.0, 'pow(0.95, k)')}) b""")
def huber(t):
    pairs = naive(t.hourly())
    other = metrics.horizon_weights("power", 0.95)
    rows = metrics.weighted_huber(pairs).select(F.lit("near").alias("k"), "loss").unionAll(
        metrics.weighted_huber(pairs, 1.0, other).select(F.lit("far"), "loss"))
    return rows.groupBy().pivot("k", ["near", "far"]).agg(F.first("loss"))


HOLED = """(SELECT event_id, CASE WHEN event_id % 17 <> 0 THEN value END AS value,
  CASE WHEN event_id % 5 <> 0 THEN event_type END AS kind FROM events)"""


def holed(t):
    key = F.col("event_id")
    return t.table("events").select(
        "event_id", F.when(key % 17 != 0, F.col("value")).alias("value"),
        F.when(key % 5 != 0, F.col("event_type")).alias("kind"))


@query("a13_null_audit", "field:s nulls:i", sql=" UNION ALL ".join(
    f"SELECT '{c}' AS field, sum(CAST({c} IS NULL AS INT)) AS nulls FROM {HOLED}"
    for c in ("event_id", "value", "kind")))
def audit(t):
    return aggregate.null_audit(holed(t))


@query("a13_first_null_row", "event_id:i value:f kind:s", sql=f"""
SELECT * FROM {HOLED} WHERE value IS NULL OR kind IS NULL ORDER BY event_id DESC LIMIT 1""")
def first_bad(t):
    return aggregate.first_null_row(holed(t), order=[F.desc("event_id")])


@query("a14_signal_means", "v:f k:f",
       sql="SELECT avg(value) AS v, avg(event_id % 7) AS k FROM events")
def means(t):
    df = t.table("events").select(F.col("value").alias("v"), (F.col("event_id") % 7).alias("k"))
    return aggregate.signal_means(df, ["v", "k"])


@query("a15_sequence_counts", "station:s n_sequences:i", views="hourly", sql="""
SELECT station, greatest(count(*) - 72 - 24 + 1, 0) AS n_sequences FROM hourly GROUP BY 1""")
def sequence_counts(t):
    return aggregate.sequence_counts(t.hourly())


@query("a16_distinct_stations", "station:s", views="raw", sql="SELECT DISTINCT station FROM raw")
def distinct_stations(t):
    return aggregate.distinct_stations(t.raw())


@query("a16_distinct_sensors", "sensor_id:i", sql=f"""
SELECT DISTINCT unnest(ids) AS sensor_id FROM {SITES}""")
def distinct_sensors(t):
    return aggregate.distinct_sensors(sites(t))


@query("m07_naive_persistence", "station:s timestamp:t horizon:i y_true:f y_pred:f",
       views="hourly", sql=f"SELECT * FROM {PAIRS['persistence']}")
def persistence(t):
    return naive(t.hourly())


@query("m07_naive_yesterday", "station:s timestamp:t horizon:i y_true:f y_pred:f",
       views="hourly", sql=f"SELECT * FROM {PAIRS['yesterday']}")
def yesterday(t):
    return naive(t.hourly(), "yesterday")
