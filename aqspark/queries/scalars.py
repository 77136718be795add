"""Scalar expressions F1–F29."""

from pyspark.sql import functions as F

from aqspark.functions import calendar, fixed, scalars, text
from aqspark.queries.base import haversine_sql, query

# Words of the corpus stand for the terms of three signals and two cities.
TERMS = {
    "news_dust_storm": ["that", "tion"],
    "news_smog_alert": ["hesh", "there", "is the"],
    "news_calamity": ["une", "der"],
}
PLACES = {"North": ["the", "le"], "South": ["est", "von"]}


def bands_sql(value, pick, outside):
    arms = []
    for band in fixed.AQI_BANDS:
        result = repr(band[pick])
        arms.append(f"WHEN {value} >= {band[0]} AND {value} < {band[1]} THEN {result}")
    return f"CASE {' '.join(arms)} ELSE {outside!r} END"


def local_sql(ts="timestamp"):
    return f"({ts} + INTERVAL 330 MINUTE)"


def wide_values(t):
    return t.table("events").select("event_id", (F.col("value") * 25 - 200).alias("v"))


WIDE = "(SELECT event_id, value * 25 - 200 AS v FROM events)"


@query("f01_aqi_label", "event_id:i label:s code:i color:s",
       sql=f"SELECT event_id, {bands_sql('v', 2, 'Severe')} AS label, "
           f"{bands_sql('v', 3, 5)} AS code, {bands_sql('v', 4, '[MAROON]')} AS color FROM {WIDE}")
def aqi_label(t):
    return wide_values(t).select("event_id", scalars.aqi_label("v").alias("label"),
                                 scalars.aqi_code("v").alias("code"),
                                 scalars.aqi_color("v").alias("color"))


@query("f02_aqi_category", "event_id:i code:i",
       sql=f"SELECT event_id, {bands_sql('v', 3, 0)} AS code FROM {WIDE}")
def aqi_category(t):
    return wide_values(t).select("event_id", scalars.aqi_category("v").alias("code"))


@query("f03_wind_components", "event_id:i speed:f u:f v:f", sql="""
SELECT event_id, coalesce(s, 0.0) AS speed, coalesce(s, 0.0) * cos(radians(coalesce(d, 0.0))) AS u,
  coalesce(s, 0.0) * sin(radians(coalesce(d, 0.0))) AS v
FROM (SELECT event_id, CASE WHEN event_id % 7 <> 0 THEN value END AS s,
        CASE WHEN event_id % 11 <> 0 THEN CAST(event_id % 360 AS DOUBLE) END AS d FROM events)""")
def wind(t):
    e = t.table("events")
    s = F.when(F.col("event_id") % 7 != 0, F.col("value"))
    d = F.when(F.col("event_id") % 11 != 0, (F.col("event_id") % 360).cast("double"))
    return e.select("event_id", scalars.wind_speed(s).alias("speed"),
                    scalars.wind_u(s, d).alias("u"), scalars.wind_v(s, d).alias("v"))


@query("f04_dew_point", "event_id:i dew:f", sql="""
SELECT event_id, 237.3 * a / (17.27 - a) AS dew FROM (
  SELECT event_id, 17.27 * t / (237.3 + t) + ln(rh / 100.0 + 1e-9) AS a
  FROM (SELECT event_id, value / 10 AS t, value / 5 AS rh FROM events))""")
def dew_point(t):
    return t.table("events").select(
        "event_id", scalars.dew_point(F.col("value") / 10, F.col("value") / 5).alias("dew"))


@query("f05_haversine_km", "station:s km:f", views="places refs",
       sql=f"""SELECT station, {haversine_sql('p.lat', 'p.lon', 'r.lat', 'r.lon')} AS km
FROM places p JOIN refs r ON p.city = r.city""")
def haversine(t):
    refs = t.refs().select("city", F.col("lat").alias("lat2"), F.col("lon").alias("lon2"))
    return t.places().join(refs, "city").select(
        "station", scalars.haversine_km("lat", "lon", "lat2", "lon2").alias("km"))


RUSH = f"CAST(hour({local_sql()}) IN ({', '.join(map(str, fixed.RUSH_HOURS))}) AS INT)"
WEEKDAY = f"CAST(isodow({local_sql()}) < 6 AS INT)"
HOLIDAY = (f"CAST(strftime({local_sql()}, '%Y-%m-%d') IN ("
           + ", ".join(f"'{d}'" for d in fixed.HOLIDAYS) + ") AS INT)")


@query("f06_rush_hour", "event_id:i rush:i", views="moments",
       sql=f"SELECT event_id, {RUSH} AS rush FROM moments")
def rush_hour(t):
    return t.moments().select(
        "event_id", calendar.rush_hour(scalars.to_local("timestamp")).alias("rush"))


@query("f07_is_weekday", "event_id:i weekday:i", views="moments",
       sql=f"SELECT event_id, {WEEKDAY} AS weekday FROM moments")
def is_weekday(t):
    return t.moments().select(
        "event_id", calendar.is_weekday(scalars.to_local("timestamp")).alias("weekday"))


@query("f08_is_holiday", "event_id:i holiday:i", views="moments",
       sql=f"SELECT event_id, {HOLIDAY} AS holiday FROM moments")
def is_holiday(t):
    return t.moments().select(
        "event_id", calendar.is_holiday(scalars.to_local("timestamp")).alias("holiday"))


@query("f09_traffic_index", "event_id:i traffic_index:f", views="moments",
       sql=f"SELECT event_id, {RUSH} * {WEEKDAY} * (1 - {HOLIDAY}) AS traffic_index FROM moments")
def traffic_index(t):
    return t.moments().select(
        "event_id", calendar.traffic("timestamp")["traffic_index"].alias("traffic_index"))


@query("f10_cyclic_time",
       "event_id:i hour_sin:f hour_cos:f month_sin:f month_cos:f "
       "day_of_week_sin:f day_of_week_cos:f",
       views="moments", sql=f"""
SELECT event_id, sin(2 * pi() * h / 24) AS hour_sin, cos(2 * pi() * h / 24) AS hour_cos,
  sin(2 * pi() * m / 12) AS month_sin, cos(2 * pi() * m / 12) AS month_cos,
  sin(2 * pi() * w / 7) AS day_of_week_sin, cos(2 * pi() * w / 7) AS day_of_week_cos
FROM (SELECT event_id, hour({local_sql()}) AS h, month(timestamp) AS m,
        isodow({local_sql()}) - 1 AS w FROM moments)""")
def cyclic(t):
    cols = {**calendar.clock("timestamp"), **calendar.traffic("timestamp")}
    return t.moments().withColumns(
        {k: v for k, v in cols.items() if k.endswith("_sin") or k.endswith("_cos")})


def around_sql(days, before, after):
    """Local wall clock within a feast's days."""
    return "(" + " OR ".join(
        f"{local_sql()} BETWEEN TIMESTAMP '{d}' - INTERVAL {before} DAY "
        f"AND TIMESTAMP '{d}' + INTERVAL {after} DAY" for d in days) + ")"


DIWALI, HOLI = around_sql(fixed.DIWALI, 3, 2), around_sql(fixed.HOLI, 1, 1)


@query("f11_season_flags", "event_id:i is_monsoon:i is_winter:i is_harvest_season:i",
       views="moments", sql=f"""
SELECT event_id, CAST(m BETWEEN 6 AND 9 AS INT) AS is_monsoon,
  CAST(m IN (12, 1, 2) AS INT) AS is_winter,
  CAST(CASE WHEN lat > 25 THEN m IN (10, 11) ELSE m IN (1, 2, 10, 11) END AS INT)
    AS is_harvest_season
FROM (SELECT event_id, lat, month({local_sql()}) AS m FROM moments)""")
def season_flags(t):
    return t.moments().withColumns(calendar.seasons("timestamp", "lat"))


@query("f12_festival_flags", "event_id:i is_diwali_period:i is_holi_period:i", views="moments",
       sql=f"SELECT event_id, CAST({DIWALI} AS INT) AS is_diwali_period, "
           f"CAST({HOLI} AS INT) AS is_holi_period FROM moments")
def festival_flags(t):
    return t.moments().withColumns(calendar.seasons("timestamp", "lat"))


def calendar_news_sql(keys, source):
    """Calendar signals of the rows (keys, timestamp, lat) in ``source``."""
    return f"""
SELECT {keys}, CASE WHEN m IN (4, 5, 6) AND h BETWEEN 12 AND 20 THEN 0.3 ELSE 0 END
    AS news_dust_storm,
  0.05 AS news_industrial_event,
  CASE WHEN lat > 25 AND ((m = 10 AND d >= 15) OR m = 11) THEN 0.8 ELSE 0 END
    AS news_crop_burning,
  CASE WHEN m BETWEEN 6 AND 9 THEN 0.1 ELSE 0 END AS news_calamity,
  CASE WHEN feast OR (m = 12 AND d = 31 AND h >= 20) OR (m = 1 AND d = 1 AND h < 3)
    THEN 1 ELSE 0 END AS news_fireworks,
  CASE WHEN m IN (11, 12, 1, 2) THEN CASE WHEN lat > 25 THEN 0.4 ELSE 0.1 END ELSE 0 END
    AS news_smog_alert
FROM (SELECT *, month({local_sql()}) AS m, day({local_sql()}) AS d, hour({local_sql()}) AS h,
        {DIWALI} AS feast FROM {source})"""


NEWS_OUT = " ".join(f"{c}:f" for c in fixed.NEWS_SIGNALS)


@query("f13_calendar_news", f"event_id:i {NEWS_OUT}", views="moments",
       sql=calendar_news_sql("event_id", "moments"))
def calendar_news(t):
    return t.moments().withColumns(calendar.calendar_news("timestamp", "lat"))


@query("f14_news_score", "user_id:i event_type:s score:f", sql="""
SELECT user_id, event_type, least(count(*) / 3.0, 1.0) AS score FROM events GROUP BY ALL""")
def news_score(t):
    return t.table("events").groupBy("user_id", "event_type").agg(
        text.news_score(F.count(F.lit(1))).alias("score"))


def mention_sql(terms, body="text"):
    words = f"(' ' || regexp_replace(lower({body}), '[^a-z0-9]+', ' ', 'g') || ' ')"
    return "(" + " OR ".join(f"contains({words}, ' {t} ')" for t in terms) + ")"


@query("f15_match_signal", "doc_id:i signal:s city:s",
       sql=" UNION ALL ".join(
           f"SELECT doc_id, '{s}' AS signal, '{c}' AS city FROM documents "
           f"WHERE {mention_sql(st)} AND {mention_sql(ct)}"
           for s, st in TERMS.items() for c, ct in PLACES.items()))
def match_signal(t):
    words = text.with_words(t.table("documents").select("doc_id", "text"), "text", TERMS, PLACES)
    docs = words.select(
        "doc_id", text.names_mentioned("_words", "_opening", TERMS).alias("s"),
        text.names_mentioned("_words", "_opening", PLACES).alias("c"))
    pairs = docs.withColumn("signal", F.explode_outer("s")).withColumn(
        "city", F.explode_outer("c"))
    return pairs.filter("signal is not null and city is not null")


@query("f16_floor_hour", "event_id:i hour:t",
       sql="SELECT event_id, date_trunc('hour', ts) AS hour FROM events")
def floor_hour(t):
    return t.table("events").select("event_id", scalars.floor_hour("ts").alias("hour"))


@query("f17_to_local", "event_id:i local:t", views="moments",
       sql=f"SELECT event_id, {local_sql()} AS local FROM moments")
def to_local(t):
    return t.moments().select("event_id", scalars.to_local("timestamp").alias("local"))


@query("f18_acquired_at", "o_orderkey:i ts:t", sql="""
SELECT o_orderkey, try_strptime(strftime(o_orderdate, '%Y-%m-%d') || ' ' ||
  lpad(CAST(o_orderkey % 2500 AS VARCHAR), 4, '0'), '%Y-%m-%d %H%M') AS ts FROM orders""")
def acquired_at(t):
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    return t.table("orders").select(
        "o_orderkey", scalars.acquired_at(day, F.col("o_orderkey") % 2500).alias("ts"))


@query("f19_half_degree", "station:s lat2:f lon2:f", views="places", sql="""
SELECT station, round_even(lat * 2, 0) / 2 AS lat2, round_even(lon * 2, 0) / 2 AS lon2
FROM places""")
def half_degree(t):
    return t.places().select("station", scalars.half_degree("lat").alias("lat2"),
                             scalars.half_degree("lon").alias("lon2"))


@query("f20_robust_scale", "event_id:i scaled:f back:f", sql="""
SELECT event_id, (value - 240.5) / 180.25 AS scaled,
  (value - 240.5) / 180.25 * 180.25 + 240.5 AS back FROM events""")
def robust_scale(t):
    center, scale = F.lit(240.5), F.lit(180.25)
    out = scalars.scaled("value", center, scale)
    return t.table("events").select("event_id", out.alias("scaled"),
                                    scalars.unscaled(out, center, scale).alias("back"))


@query("f21_clip_forecast", "event_id:i v:f",
       sql=f"SELECT event_id, least(greatest(v, 0.0), 1500.0) AS v FROM {WIDE}")
def clip_forecast(t):
    return wide_values(t).select("event_id", scalars.clip_forecast("v").alias("v"))


# the binary value of 0.825 lies just above the tie, which DuckDB's rounding loses
@query("f22_nominal_confidence", "event_id:i confidence:f", sql="""
SELECT event_id, CASE WHEN event_id % 24 = 6 THEN 0.83
  ELSE round_even(0.90::DOUBLE - (event_id % 24) / 24.0::DOUBLE * 0.30::DOUBLE, 2) END
  AS confidence FROM events""")
def confidence(t):
    return t.table("events").select(
        "event_id", scalars.nominal_confidence(F.col("event_id") % 24).alias("confidence"))


@query("f23_forecast_delta", "event_id:i change:f", sql="""
SELECT event_id, round_even(CAST(value AS DECIMAL(18,2)) - 100.25, 1) AS change FROM events""")
def forecast_delta(t):
    exact = F.col("value").cast("decimal(18,2)")
    return t.table("events").select(
        "event_id", scalars.delta(exact, F.lit(100.25).cast("decimal(18,2)")).alias("change"))


def weights_sql(raw):
    steps = "(SELECT CAST(unnest(range(24)) AS DOUBLE) AS k)"
    return f"(SELECT k + 1 AS h, {raw} / (SELECT sum({raw}) FROM {steps}) AS w FROM {steps})"


@query("f24_horizon_weights", "event_id:i near:f far:f", sql=f"""
SELECT event_id, a.w AS near, b.w AS far FROM events
JOIN {weights_sql('exp(-0.04 * k)')} a ON a.h = event_id % 24 + 1
JOIN {weights_sql('pow(0.95, k)')} b ON b.h = event_id % 24 + 1""")
def weights(t):
    def weight(values):
        return F.element_at(F.array(*[F.lit(w) for w in values]),
                            (F.col("event_id") % 24 + 1).cast("int"))
    return t.table("events").select(
        "event_id", weight(scalars.horizon_weights("exp", 0.04)).alias("near"),
        weight(scalars.horizon_weights("power", 0.95)).alias("far"))


@query("f26_trend_arrow", "event_id:i arrow:s", sql="""
SELECT event_id, CASE WHEN c > 0 THEN '↑' WHEN c < 0 THEN '↓' ELSE '→' END AS arrow
FROM (SELECT event_id, CAST(floor(value) AS BIGINT) % 50 - 25 AS c FROM events)""")
def arrow(t):
    change = F.floor("value") % 50 - 25
    return t.table("events").select("event_id", scalars.trend_arrow(change).alias("arrow"))


@query("f27_nested_access", "event_id:i k:i missing:i first:i", sql="""
SELECT event_id, k, 0 AS missing, k * 2 AS first FROM (
  SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events)""")
def nested(t):
    parsed = F.from_json("props", "k int, gone struct<x: int>")
    e = t.table("events").withColumn("p", parsed)
    doubled = F.filter(F.array(F.lit(None), F.col("p.k") * 2), lambda x: x.isNotNull())
    return e.select("event_id", F.col("p.k").alias("k"),
                    F.coalesce("p.gone.x", F.lit(0)).alias("missing"),
                    F.get(doubled, F.lit(0)).alias("first"))


@query("f28_iso_dates", "o_orderkey:i day:s year:i is_early:i", sql="""
SELECT o_orderkey, try_cast(try_strptime(substr(x, 1, 10), '%Y-%m-%d') AS DATE) AS day,
  year(try_strptime(substr(x, 1, 10), '%Y-%m-%d')) AS year,
  CAST(substr(x, 1, 4) < '1998' AS INT) AS is_early
FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 13 = 0 THEN 'unknown'
        ELSE strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ') END AS x FROM orders)""")
def iso_dates(t):
    x = F.when(F.col("o_orderkey") % 13 == 0, "unknown").otherwise(
        F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'"))
    return t.table("orders").select(
        "o_orderkey", scalars.iso_day(x).alias("day"), scalars.iso_year(x).alias("year"),
        (F.substring(x, 1, 4) < "1998").cast("int").alias("is_early"))


@query("f29_round_to", "o_orderkey:i r1:f r0:f", sql="""
SELECT o_orderkey, round_even(CAST(o_totalprice AS DECIMAL(18,2)), 1) AS r1,
  round_even(CAST(o_totalprice AS DECIMAL(18,2)), 0) AS r0 FROM orders""")
def round_to(t):
    price = F.col("o_totalprice").cast("decimal(18,2)")
    return t.table("orders").select("o_orderkey", scalars.round_to(price, 1).alias("r1"),
                                    scalars.round_to(price, 0).alias("r0"))
