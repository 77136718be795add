"""Joins J1–J17, set operations U1–U4, and the products M3–M5 and M8–M12."""

from pyspark.sql import functions as F

from aqspark.functions import fixed
from aqspark.functions.calendar import in_event
from aqspark.functions.scalars import round_half_up, to_local
from aqspark.operators import aggregate, joins, spatial
from aqspark.operators.ranks import station_ids
from aqspark.operators.windows import hour_grid
from aqspark.plans import features, history, news, registry
from aqspark.queries.aggregates import FIRE_HOURS, FIRE_OUT, SITES, sites
from aqspark.queries.base import DIGITS, haversine_sql, query, spark_out, values_sql
from aqspark.queries.scalars import (
    DIWALI, HOLI, HOLIDAY, NEWS_OUT, PLACES, RUSH, TERMS, WEEKDAY, around_sql, bands_sql,
    calendar_news_sql, local_sql, mention_sql)
from aqspark.queries.windows import LAG_SQL, ROLL_SQL, TREND_SQL, W
from aqspark.sources import dims

WEATHER_OUT = ("temperature_2m:f relative_humidity_2m:f wind_speed_10m:f wind_direction_10m:f")
WEATHER_NAMES = ["temperature_2m", "relative_humidity_2m", "wind_speed_10m", "wind_direction_10m"]


# --- onto the timeline -----------------------------------------------------------------

def cell_weather(t):
    """The fixture weather, averaged per half-degree cell."""
    placed = spatial.assign_cell(t.weather().join(t.stations(), "station"))
    return placed.groupBy("cell_lat", "cell_lon", "timestamp").agg(
        *[F.max(c).alias(c) for c in WEATHER_NAMES])


CELLS = ("round_even(lat * 2, 0) / 2 AS cell_lat, round_even(lon * 2, 0) / 2 AS cell_lon")
CELL_WEATHER = f"""(SELECT cell_lat, cell_lon, timestamp, """ + ", ".join(
    f"max({c}) AS {c}" for c in WEATHER_NAMES) + f"""
  FROM (SELECT *, {CELLS} FROM weather JOIN stations USING (station)) GROUP BY 1, 2, 3)"""
PLACED = f"(SELECT *, {CELLS} FROM hourly JOIN stations USING (station))"


@query("j01_weather", f"station:s timestamp:t pm25:f {WEATHER_OUT}",
       views="hourly weather stations", sql=f"""
SELECT h.station, h.timestamp, h.pm25, w.* EXCLUDE (cell_lat, cell_lon, timestamp)
FROM {PLACED} h LEFT JOIN {CELL_WEATHER} w USING (cell_lat, cell_lon, timestamp)""")
def weather(t):
    placed = joins.join_stations(t.hourly(), t.stations())
    return joins.join_weather(placed, cell_weather(t))


FIRES_ZEROED = ", ".join(f"coalesce({c}, 0) AS {c}" for c in fixed.FIRE_MEASURES)


@query("j02_fires", f"station:s timestamp:t pm25:f {FIRE_OUT}", views="hourly fires stations",
       sql=f"""SELECT h.station, h.timestamp, pm25, {FIRES_ZEROED} FROM hourly h
LEFT JOIN ({FIRE_HOURS.format(places='stations')}) f
  ON h.station = f.station AND h.timestamp = f.timestamp""")
def fires(t):
    return joins.join_fires(t.hourly(), spatial.fire_hourly(t.stations(), t.fires(), shared=True))


KINDS = ["click", "error", "purchase", "signup", "view"]
PIVOT = ("(SELECT station, date_trunc('hour', ts) AS timestamp, " + ", ".join(
    f"avg(pm25) FILTER (kind = '{k}') AS {k}" for k in KINDS) + " FROM raw GROUP BY 1, 2)")


def kind_hours(t):
    long = t.raw().select("station", "ts", F.upper("kind").alias("parameter"),
                          F.col("pm25").alias("value"))
    return aggregate.copollutant_hours(long, ts="ts", names=KINDS)


KIND_OUT = " ".join(f"{k}:f" for k in KINDS)


@query("j03_copollutants", f"station:s timestamp:t pm25:f {KIND_OUT}", views="hourly", sql=f"""
SELECT h.pm25, p.* FROM hourly h JOIN {PIVOT} p USING (station, timestamp)""")
def copollutants(t):
    return joins.join_copollutants(t.hourly(), kind_hours(t))


@query("j04_pollutant_series", f"station:s timestamp:t {KIND_OUT}", views="raw",
       sql=f"SELECT * FROM {PIVOT}")
def pollutant_series(t):
    return kind_hours(t)


# --- by distance -------------------------------------------------------------------------

@query("j05_radius_join", "station:s timestamp:t latitude:f longitude:f km:f",
       views="fires places", sql=f"""
SELECT * FROM (SELECT station, timestamp, latitude, longitude,
  {haversine_sql('lat', 'lon', 'latitude', 'longitude')} AS km FROM fires, places)
WHERE km <= 300""", ready=True)
def radius(t):
    """Texts and digits of a fire are made once, not once per pair."""
    shown = {"timestamp": "t", "latitude": "f", "longitude": "f"}
    fires = t.fires().select("latitude", "longitude", *[spark_out(n, k).alias(f"{n}_out") for n, k in shown.items()])
    pairs = spatial.radius_join(t.places(), fires, 300)
    return pairs.select("station", *[F.col(f"{n}_out").alias(n) for n in shown],
                        (round_half_up("distance_km", DIGITS) + F.lit(0.0)).alias("km"))


@query("j06_nearest_city", "station:s city:s state:s", views="places refs", sql=f"""
SELECT station, coalesce(n.city, 'Unknown') AS city, coalesce(n.state, 'Unknown') AS state
FROM places LEFT JOIN (SELECT * FROM (
  SELECT p.station, r.city, r.state, row_number() OVER (PARTITION BY p.station ORDER BY
    {haversine_sql('p.lat', 'p.lon', 'r.lat', 'r.lon')}, ord) AS rn
  FROM places p JOIN refs r ON {haversine_sql('p.lat', 'p.lon', 'r.lat', 'r.lon')} < 181)
  WHERE rn = 1) n USING (station)""")
def nearest_city(t):
    return spatial.nearest_join(t.places(), t.refs(), max_km=180)


CITY_ROWS = values_sql([(i, *c) for i, c in enumerate(fixed.CITIES)])


@query("j06_nearest_known_city", "event_id:i city:s state:s", sql=f"""
SELECT event_id, coalesce(n.city, 'Unknown') AS city, coalesce(n.state, 'Unknown') AS state
FROM events LEFT JOIN (SELECT * FROM (
  SELECT event_id, r.city, r.state, row_number() OVER (PARTITION BY event_id ORDER BY
    {haversine_sql('8 + (event_id * 31 % 2800) / 100.0::DOUBLE',
                   '68 + (event_id * 17 % 2800) / 100.0::DOUBLE', 'r.lat', 'r.lon')}, ord) AS rn
  FROM events JOIN {CITY_ROWS} r(ord, city, state, lat, lon)
  ON {haversine_sql('8 + (event_id * 31 % 2800) / 100.0::DOUBLE',
                    '68 + (event_id * 17 % 2800) / 100.0::DOUBLE', 'r.lat', 'r.lon')} < 81)
  WHERE rn = 1) n USING (event_id)""")
def nearest_known_city(t):
    key = F.col("event_id")
    points = t.table("events").select(
        "event_id", (8 + key * 31 % 2800 / F.lit(100.0)).alias("lat"),
        (68 + key * 17 % 2800 / F.lit(100.0)).alias("lon"))
    return spatial.nearest_join(points, dims.cities(t.spark), key="event_id")


@query("j07_nearest_sensor", "station:s sensor_id:i", views="places", sql=f"""
SELECT a.station, coalesce(a.sensor_id, n.id) AS sensor_id FROM (
  SELECT station, lat, lon, CASE WHEN location_id % 2 = 0 THEN sensor_id END AS sensor_id
  FROM places) a
LEFT JOIN (SELECT * FROM (SELECT p.station, l.id, row_number() OVER (PARTITION BY p.station
    ORDER BY {haversine_sql('p.lat', 'p.lon', 'l.lat', 'l.lon')}, l.id) AS rn
  FROM places p JOIN (SELECT location_id + 7 AS id, lat + (location_id % 9) / 50.0::DOUBLE AS lat,
    lon AS lon FROM places) l
  ON {haversine_sql('p.lat', 'p.lon', 'l.lat', 'l.lon')} <= 5) WHERE rn = 1) n USING (station)""")
def nearest_sensor(t):
    places = t.places()
    has = F.col("location_id") % 2 == 0
    stations = places.withColumns({
        "sensor_id": F.when(has, F.col("sensor_id")),
        "sensor_ids": F.when(has, F.array("sensor_id"))})
    shifted = places.select((F.col("location_id") + 7).alias("sensor_id"),
                            (F.col("lat") + F.col("location_id") % 9 / F.lit(50.0)).alias("lat"),
                            "lon")
    return spatial.nearest_sensor(stations, shifted)


@query("j08_weather_cells", "station:s cell_lat:f cell_lon:f", views="places",
       sql=f"SELECT station, {CELLS} FROM places")
def cells(t):
    return spatial.assign_cell(t.places())


# --- by attribute ------------------------------------------------------------------------

FALLBACK_ROWS = values_sql([("N_" + s, "Nation_%d" % (i * 2), lat, lon) for i, (s, _, lat, lon, _)
                            in enumerate(fixed.FALLBACK_STATIONS)])


@query("j09_fallback_cities", "station:s city:s lat:f lon:f name:s", views="places", sql=f"""
SELECT station, city, lat, lon, name FROM places UNION ALL
SELECT station, city, lat, lon, NULL FROM {FALLBACK_ROWS} f(station, city, lat, lon)
WHERE lower(city) NOT IN (SELECT lower(city) FROM places)""")
def fallback(t):
    rows = [("N_" + s, f"Nation_{i * 2}", lat, lon)
            for i, (s, _, lat, lon, _) in enumerate(fixed.FALLBACK_STATIONS)]
    extra = t.spark.createDataFrame(rows, "station string, city string, lat double, lon double")
    stations = t.places().select("station", "city", "lat", "lon", "name")
    return joins.add_fallback_cities(stations, extra)


def live_news(t):
    """Signals for the hours in which a station viewed something."""
    return t.weather().select("station", "timestamp",
                              (F.col("temperature_2m") / 50).alias("news_calamity"))


@query("j10_news_precedence", "station:s timestamp:t news_calamity:f news_fireworks:f",
       views="hourly weather", sql="""
SELECT h.station, h.timestamp, coalesce(temperature_2m / 50,
  CASE WHEN pm25 > 100 THEN pm25 / 500 END, 0) AS news_calamity,
  coalesce(CASE WHEN w.station IS NOT NULL THEN 0.0 END, 0) AS news_fireworks
FROM hourly h LEFT JOIN weather w ON h.station = w.station AND h.timestamp = w.timestamp""")
def news_precedence(t):
    rows = t.hourly().withColumn("news_calamity",
                                 F.when(F.col("pm25") > 100, F.col("pm25") / 500))
    return joins.join_news(rows, live_news(t))


FROM, TO = "2024-02-27", "2024-03-02"


@query("j11_city_hours", "station:s timestamp:t", views="places", sql=f"""
SELECT station, unnest(generate_series(TIMESTAMP '{FROM}', TIMESTAMP '{TO}', INTERVAL 1 HOUR))
  AS timestamp FROM places""")
def city_hours(t):
    bounds = (F.lit(x).cast("timestamp") for x in (FROM, TO))
    return hour_grid(t.places().select("station"), *bounds)


@query("j12_station_attributes", "station:s timestamp:t pm25:f city:s lat:f lon:f",
       views="hourly stations",
       sql="SELECT * FROM hourly JOIN stations USING (station)")
def attributes(t):
    return joins.join_stations(t.hourly(), t.stations(), ["city", "lat", "lon"])


DAYS = ["2022-05-01", "2023-12-31", "2025-02-28"]


@query("j13_event_flag", "event_id:i near:i", views="moments",
       sql=f"SELECT event_id, CAST({around_sql(DAYS, 20, 10)} AS INT) AS near FROM moments")
def event_flag(t):
    near = in_event(to_local("timestamp"), DAYS, 20, 10)
    return t.moments().select("event_id", near.cast("int").alias("near"))


@query("j14_holiday_rows", "event_id:i timestamp:t", views="moments",
       sql=f"SELECT event_id, timestamp FROM moments WHERE {HOLIDAY} = 1")
def holiday_rows(t):
    dated = t.moments().withColumn("day", F.to_date(to_local("timestamp")))
    return dated.join(dims.holidays(t.spark), "day", "left_semi")


@query("j15_station_id_lookup", "station:s timestamp:t station_id:i", views="hourly", sql="""
SELECT station, timestamp, coalesce(i, 0) AS station_id FROM hourly LEFT JOIN (
  SELECT station, row_number() OVER (ORDER BY station) AS i FROM (SELECT DISTINCT station
  FROM hourly WHERE pm25 > 250)) USING (station)""")
def id_lookup(t):
    hourly = t.hourly()
    return joins.join_station_ids(hourly, station_ids(hourly.filter("pm25 > 250")))


WATCHED = ["NATION_3", "NATION_4", "NATION_99"]


@query("j16_watched_cities", "city:s n:i note:s", sql=f"""
SELECT city, coalesce(n, 0) AS n, CASE WHEN n > 0 THEN 'OK' ELSE 'MISSING' END AS note
FROM {values_sql([(w,) for w in WATCHED])} w(city) LEFT JOIN (SELECT n_name AS city, count(*) AS n
  FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1) USING (city)""")
def watched(t):
    customers = t.table("customer").join(
        t.table("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    names = t.spark.createDataFrame([(w,) for w in WATCHED], "city string")
    return joins.watched_city_counts(customers.withColumnRenamed("n_name", "city"), names)


ROWS = "(SELECT station, city, timestamp, lat FROM hourly JOIN stations USING (station))"
STORED = ("(SELECT city, timestamp, " + ", ".join(
    f"max(pm25) / {i * 1000}.0 AS {c}" for i, c in enumerate(fixed.NEWS_SIGNALS, 1))
    + " FROM hourly JOIN stations USING (station) WHERE pm25 > 100 AND city < 'NATION_2' "
    + "GROUP BY 1, 2)")


@query("j17_news_for_station", f"station:s timestamp:t {NEWS_OUT}", views="hourly stations",
       sql=f"""SELECT r.station, r.timestamp, """ + ", ".join(
           f"CASE WHEN r.city IN (SELECT city FROM {STORED}) THEN coalesce(s.{c}, 0) "
           f"ELSE r.{c} END AS {c}" for c in fixed.NEWS_SIGNALS)
       + f" FROM ({calendar_news_sql('station, city, timestamp', ROWS)}) r "
       f"LEFT JOIN {STORED} s ON r.city = s.city AND r.timestamp = s.timestamp")
def station_news(t):
    rows = joins.join_stations(t.hourly(), t.stations(), ["city", "lat"])
    strong = rows.filter("pm25 > 100 AND city < 'NATION_2'").groupBy("city", "timestamp").agg(
        *[(F.max("pm25") / (i * 1000.0)).alias(c)
          for i, c in enumerate(fixed.NEWS_SIGNALS, 1)])
    return joins.news_for_station(rows, strong)


# --- sets ----------------------------------------------------------------------------------

@query("u01_union_all", "key:i name:s balance:f", sql="""
SELECT c_custkey AS key, c_name AS name, c_acctbal AS balance FROM customer UNION ALL
SELECT s_suppkey, s_name, s_acctbal FROM supplier UNION ALL
SELECT n_nationkey, n_name, NULL FROM nation""")
def union_all(t):
    return joins.union_all(
        t.table("customer").selectExpr("c_custkey key", "c_name name", "c_acctbal balance"),
        t.table("supplier").selectExpr("s_name name", "s_acctbal balance", "s_suppkey key"),
        t.table("nation").selectExpr("cast(n_nationkey as bigint) key", "n_name name"))


@query("u02_union_common", "key:i balance:f source:s", sql="""
SELECT c_custkey AS key, c_acctbal AS balance, 'c' AS source FROM customer UNION ALL
SELECT s_suppkey, s_acctbal, 's' FROM supplier""")
def union_common(t):
    return joins.union_common({
        "c": t.table("customer").selectExpr("c_custkey key", "c_mktsegment seg",
                                            "c_acctbal balance"),
        "s": t.table("supplier").selectExpr("s_acctbal balance", "s_suppkey key",
                                            "s_nationkey n")})


@query("u03_distinct_ids", "station:s ids:s", sql=f"""
SELECT station, array_to_string(list_prepend(coalesce(p, ids[1]),
  list_filter(ids, lambda x: x <> coalesce(p, ids[1]))), ',') AS ids
FROM (SELECT station, ids, CASE WHEN ids[2] % 3 = 0 THEN ids[2] WHEN ids[2] % 3 = 1 THEN ids[1]
  END AS p FROM {SITES})""")
def distinct_ids(t):
    k = F.col("sensor_ids")[1]
    primary = F.when(k % 3 == 0, k).when(k % 3 == 1, F.col("sensor_ids")[0])
    return sites(t).select("station", F.array_join(aggregate.all_sensor_ids(
        primary, F.col("sensor_ids")), ",").alias("ids"))


@query("u04_not_yet_done", "station:s timestamp:t pm25:f", views="hourly", sql="""
SELECT * FROM hourly WHERE station NOT IN (SELECT station FROM hourly WHERE pm25 > 300)""")
def not_done(t):
    hourly = t.hourly()
    return joins.not_yet_done(hourly, hourly.filter("pm25 > 300"))


# --- products ------------------------------------------------------------------------------

def calendar_sql(ts, lat):
    """All features of the clock, the calendar and the season, by name."""
    local = local_sql(ts)
    at = lambda text: text.replace("timestamp", ts)
    rush, weekday, holiday = at(RUSH), at(WEEKDAY), at(HOLIDAY)

    def turn(value, length):
        return [f"{fn}(2 * pi() * {value} / {length})" for fn in ("sin", "cos")]
    hour, month, day = (turn(f"hour({local})", 24), turn(f"month({ts})", 12), turn(f"(isodow({local}) - 1)", 7))
    season = f"month({local})"
    return {
        "rush_hour": rush, "is_weekday": weekday, "is_holiday": holiday,
        "traffic_index": f"{rush} * {weekday} * (1 - {holiday})",
        "day_of_week_sin": day[0], "day_of_week_cos": day[1], "hour_sin": hour[0], "hour_cos": hour[1],
        "month_sin": month[0], "month_cos": month[1],
        "is_monsoon": f"CAST({season} BETWEEN 6 AND 9 AS INT)",
        "is_winter": f"CAST({season} IN (12, 1, 2) AS INT)",
        "is_harvest_season": f"CAST(CASE WHEN {lat} > 25 THEN {season} IN (10, 11) "
                             f"ELSE {season} IN (1, 2, 10, 11) END AS INT)",
        "is_diwali_period": f"CAST({at(DIWALI)} AS INT)", "is_holi_period": f"CAST({at(HOLI)} AS INT)"}


# a station's measurements that the fixture does not have
NO_SOURCE = ["surface_pressure", "precipitation", "cloud_cover", "shortwave_radiation",
             "boundary_layer_height"]


def features_sql(source="hourly", weather=True, fires=True, pollutants=False):
    """Every feature and target, as one SELECT over joins."""
    w = (f"""LEFT JOIN (SELECT *, 17.27 * temperature_2m / (237.3 + temperature_2m)
    + ln(relative_humidity_2m / 100.0 + 1e-9) AS a FROM {CELL_WEATHER}) w
  ON s.cell_lat = w.cell_lat AND s.cell_lon = w.cell_lon AND x.timestamp = w.timestamp""" if weather else "")
    f = (f"""LEFT JOIN ({FIRE_HOURS.format(places='stations')}) f
  ON x.station = f.station AND x.timestamp = f.timestamp""" if fires else "")
    p = f"LEFT JOIN {POLLUTED} p ON x.station = p.station AND x.timestamp = p.timestamp" if pollutants else ""
    if weather:
        measured = """temperature_2m, relative_humidity_2m, 237.3 * a / (17.27 - a) AS dew_point_2m,
  coalesce(wind_speed_10m, 0) AS wind_speed,
  coalesce(wind_speed_10m, 0) * cos(radians(coalesce(wind_direction_10m, 0))) AS wind_u,
  coalesce(wind_speed_10m, 0) * sin(radians(coalesce(wind_direction_10m, 0))) AS wind_v"""
    else:
        # the dew point of 25 degrees and 60 percent
        a = "(17.27 * 25.0 / (237.3 + 25.0) + ln(60.0 / 100.0 + 1e-9))"
        measured = f"""0 AS temperature_2m, 0 AS relative_humidity_2m, 237.3 * {a} / (17.27 - {a}) AS dew_point_2m,
  0 AS wind_speed, 0 AS wind_u, 0 AS wind_v"""
    burnt = FIRES_ZEROED if fires else ", ".join(f"0 AS {c}" for c in fixed.FIRE_MEASURES)
    gases = ", ".join(f"p.{c}" if pollutants else f"0 AS {c}" for c in fixed.COPOLLUTANTS)
    return f"""
SELECT x.*, lat, lon, city, {bands_sql('x.pm25', 3, 0)} AS aqi_category, {gases}, {measured},
  {", ".join(f"0 AS {c}" for c in NO_SOURCE)}, {burnt},
  {", ".join(f"{v} AS {c}" for c, v in calendar_sql('x.timestamp', 'lat').items())}
FROM (SELECT *, {LAG_SQL}, {ROLL_SQL}, {TREND_SQL}, {", ".join(
    f"lead(pm25, {h}) OVER w AS target_{h}h" for h in range(1, 25))}
  FROM {source} {W}) x
JOIN (SELECT *, {CELLS} FROM stations) s ON x.station = s.station
{w} {f} {p}"""


NO_NEWS = ", ".join(f"0 AS {c}" for c in fixed.NEWS_SIGNALS)
FEATURE_OUT = "station:s timestamp:t " + " ".join(f"{c}:f" for c in fixed.FEATURES + fixed.TARGETS)


@query("m03_features", FEATURE_OUT, views="hourly weather fires stations",
       sql=f"SELECT *, {NO_NEWS} FROM ({features_sql()})")
def build_features(t):
    hours = spatial.fire_hourly(t.stations(), t.fires(), shared=True)
    return features.build_features(t.hourly(), t.stations(), cell_weather(t), hours)


GATED = "(SELECT * FROM hourly WHERE station IN (SELECT station FROM hourly GROUP BY 1 HAVING count(*) >= 200))"

# kinds of events stand for the co-pollutants, but for ozone, which no station measures
GASES = dict(zip(["pm10", "no2", "so2", "co"], ["click", "purchase", "signup", "view"], strict=True))
POLLUTED = ("(SELECT station, date_trunc('hour', ts) AS timestamp, " + ", ".join(
    f"avg(pm25) FILTER (kind = '{k}') AS {c}" for c, k in GASES.items())
    + ", CAST(NULL AS DOUBLE) AS o3 FROM raw GROUP BY 1, 2)")


def gas_hours(t):
    named = F.coalesce(*[F.when(F.col("kind") == k, c) for c, k in GASES.items()])
    long = t.raw().select("station", "ts", named.alias("parameter"), F.col("pm25").alias("value"))
    return aggregate.copollutant_hours(long.filter("parameter is not null"), ts="ts",
                                       names=fixed.COPOLLUTANTS)


# news are known for some cities only; the others follow the calendar
NEWS_CITY = "CAST(split_part(city, '_', 2) AS INT) % 2 = 0"
CITY_NEWS = f"""(SELECT city, timestamp, max(temperature_2m) / 50 AS news_calamity,
    min(relative_humidity_2m) / 100 AS news_dust_storm FROM weather JOIN stations USING (station)
  WHERE {NEWS_CITY} GROUP BY 1, 2)"""


def city_news(t):
    placed = t.weather().join(t.stations(), "station").filter(
        F.split("city", "_")[1].cast("int") % 2 == 0)
    return placed.groupBy("city", "timestamp").agg(
        (F.max("temperature_2m") / 50).alias("news_calamity"),
        (F.min("relative_humidity_2m") / 100).alias("news_dust_storm"))


def news_sql(source):
    """Rows of ``source`` with the news of their city, or with the calendar's."""
    live = {"news_calamity": "coalesce(n.news_calamity, 0)", "news_dust_storm": "coalesce(n.news_dust_storm, 0)"}
    chosen = ", ".join(f"CASE WHEN k.city IS NOT NULL THEN {live.get(c, '0')} ELSE c.{c} END AS {c}"
                       for c in fixed.NEWS_SIGNALS)
    by_date = calendar_news_sql("station, timestamp", source)
    return f"""(SELECT f.*, {chosen} FROM {source} f
  JOIN ({by_date}) c ON f.station = c.station AND f.timestamp = c.timestamp
  LEFT JOIN (SELECT DISTINCT city FROM {CITY_NEWS}) k ON f.city = k.city
  LEFT JOIN {CITY_NEWS} n ON f.city = n.city AND f.timestamp = n.timestamp)"""


REPAIRED = features.REPAIRABLE


def repaired_sql(source, cols=REPAIRED):
    """Interpolated columns of the rows of ``source``, by row number."""
    over = "OVER (PARTITION BY station ORDER BY pos ROWS BETWEEN "
    back, ahead = over + "UNBOUNDED PRECEDING AND CURRENT ROW)", over + "CURRENT ROW AND UNBOUNDED FOLLOWING)"
    edges = ", ".join(
        f"last_value(CASE WHEN {c} IS NOT NULL THEN pos END IGNORE NULLS) {back} AS p0_{c}, "
        f"last_value({c} IGNORE NULLS) {back} AS v0_{c}, "
        f"first_value(CASE WHEN {c} IS NOT NULL THEN pos END IGNORE NULLS) {ahead} AS p1_{c}, "
        f"first_value({c} IGNORE NULLS) {ahead} AS v1_{c}" for c in cols)
    fixes = ", ".join(
        f"coalesce({c}, v0_{c} + (v1_{c} - v0_{c}) * ((pos - p0_{c}) / (p1_{c} - p0_{c})), "
        f"v0_{c}, v1_{c}, 0) AS {c}" for c in cols)
    return f"""SELECT * REPLACE ({fixes}) FROM (SELECT *, {edges} FROM (
  SELECT *, row_number() OVER (PARTITION BY station ORDER BY timestamp) AS pos FROM {source}))"""


STORED = fixed.FEATURES + fixed.TARGETS
DATASET_OUT = "station:s timestamp:t " + " ".join(f"{c}:f3" for c in STORED)
COMPLETE_ROWS = f"""(SELECT * FROM ({features_sql(GATED, pollutants=True)})
  WHERE pm25_lag24 IS NOT NULL AND target_24h IS NOT NULL)"""


@query("m04_dataset", DATASET_OUT, views="hourly weather fires stations", sql=f"""
WITH complete AS MATERIALIZED {COMPLETE_ROWS}, told AS MATERIALIZED {news_sql('complete')}
SELECT station, timestamp, """ + ", ".join(f"CAST({c} AS FLOAT) AS {c}" for c in STORED)
       + f" FROM ({repaired_sql('told')})")
def build_dataset(t):
    return features.build_dataset(t.hourly(), t.stations(), cell_weather(t), t.fires(),
                                  copollutants=gas_hours(t), news=city_news(t))


LIVE_OUT = "station:s timestamp:t " + " ".join(f"{c}:f" for c in fixed.FEATURES)


def live_sql(source="hourly", weather=False, fires=False, news=False):
    """The newest 72 rows of every station, repaired and without nulls."""
    rows = f"""(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY station
      ORDER BY timestamp DESC) AS rn FROM ({features_sql(source, weather, fires)})) WHERE rn <= 72)"""
    told = news_sql("newest") if news else f"""(SELECT f.*, {", ".join(f"c.{c}" for c in fixed.NEWS_SIGNALS)}
  FROM newest f JOIN ({calendar_news_sql("station, timestamp", "newest")}) c USING (station, timestamp))"""
    zeroed = ", ".join(f"coalesce({c}, 0) AS {c}" for c in fixed.FEATURES)
    return f"""
WITH newest AS MATERIALIZED {rows}, told AS MATERIALIZED {told}
SELECT station, timestamp, {zeroed} FROM ({repaired_sql('told')})"""


@query("m05_live_window", LIVE_OUT, views="hourly weather fires stations",
       sql=live_sql("hourly", True, True, True))
def live(t):
    return features.live_window(t.hourly(), t.stations(), cell_weather(t), t.fires(), city_news(t))


ARCHIVE = """(SELECT o_custkey AS location_id, o_orderdate + INTERVAL 1 MINUTE *
    (o_orderkey % 1440) AS ts, o_totalprice / 200 - 100 AS v FROM orders
  WHERE o_orderkey % 7 <> 0 AND o_orderkey % 5 <> 0)"""


@query("m08_history", "timestamp:t pm25:f station:s city:s lat:f lon:f location_id:i",
       views="places", sql=f"""
SELECT timestamp, pm25, station, city, lat, lon, location_id FROM (
  SELECT location_id, date_trunc('hour', ts) AS timestamp,
    avg(least(greatest(v, 0), 1500)) AS pm25 FROM {ARCHIVE} GROUP BY 1, 2)
JOIN places USING (location_id)""")
def build_history(t):
    return history.build_history(archive_texts(t), t.places())


def archive_texts(t):
    """Orders as archive rows: texts, with unreadable values and other pollutants."""
    key = F.col("o_orderkey")
    when = F.col("o_orderdate") + F.make_dt_interval(mins=(key % 1440).cast("int"))
    return t.table("orders").select(
        F.col("o_custkey").alias("location_id"),
        F.date_format(when, "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("timestamp"),
        F.when(key % 7 == 0, "broken").otherwise(
            (F.col("o_totalprice") / 200 - 100).cast("string")).alias("pm25"),
        F.when(key % 5 == 0, "no2").otherwise("PM2.5").alias("parameter"))


@query("m09_merge_history", "station:s timestamp:t pm25:f", views="hourly raw", sql="""
SELECT station, timestamp, coalesce(h.pm25, c.pm25) AS pm25 FROM hourly c FULL JOIN (
  SELECT station, timestamp, max(pm25) AS pm25 FROM (
    SELECT station, date_trunc('hour', ts) + INTERVAL 12 HOUR AS timestamp, pm25 FROM raw)
  GROUP BY 1, 2) h USING (station, timestamp)""")
def merge(t):
    """The archive runs half a day ahead of the readings, so either has hours that the other lacks."""
    current = t.hourly().withColumn("extra", F.lit(1))
    old = t.raw().groupBy("station", (F.date_trunc("hour", "ts") + F.expr("INTERVAL 12 HOURS")).alias("timestamp")).agg(
        F.max("pm25").alias("pm25"))
    return history.merge_history(current, old)


NEWS_FROM, NEWS_TO = "2024-01-01", "2024-01-31"


@query("m10_news_hours", "city:s timestamp:t " + " ".join(f"{s}:f" for s in TERMS),
       views="articles", sql=f"""
SELECT city, timestamp, """ + ", ".join(
    f"least(coalesce({s}, 0) / 3.0, 1) AS {s}" for s in TERMS) + f"""
FROM (SELECT city, unnest(generate_series(TIMESTAMP '{NEWS_FROM}', TIMESTAMP '{NEWS_TO}',
    INTERVAL 1 HOUR)) AS timestamp FROM {values_sql([(c,) for c in PLACES])} c(city))
LEFT JOIN (SELECT city, date_trunc('hour', timestamp) AS timestamp, """ + ", ".join(
    f"sum(CAST({mention_sql(terms)} AS INT)) AS {s}" for s, terms in TERMS.items())
    + " FROM (" + " UNION ALL ".join(
        f"SELECT '{c}' AS city, timestamp, text FROM articles WHERE {mention_sql(terms)}"
        for c, terms in PLACES.items()) + ") GROUP BY 1, 2) USING (city, timestamp)")
def news_hours(t):
    cities = t.spark.createDataFrame([(c,) for c in PLACES], "city string")
    bounds = (F.lit(x).cast("timestamp") for x in (NEWS_FROM, NEWS_TO))
    return news.news_hours(t.articles(), cities, *bounds, TERMS, PLACES)


@query("m11_calendar_table", f"city:s timestamp:t {NEWS_OUT.replace(':f', ':f4')}",
       views="places", sql=calendar_news_sql("city, timestamp", f"""
(SELECT station AS city, lat, unnest(generate_series(TIMESTAMP '2023-10-30',
  TIMESTAMP '2023-11-16', INTERVAL 1 HOUR)) AS timestamp FROM places)"""))
def calendar_table(t):
    bounds = (F.lit(x).cast("timestamp") for x in ("2023-10-30", "2023-11-16"))
    return news.calendar_news_table(
        t.places().select(F.col("station").alias("city"), "lat"), *bounds)


def found_locations(t):
    """Customers as discovered locations with nested sensors."""
    key = F.col("c_custkey")
    name = F.when(key % 4 != 0, F.lit("pm25")).otherwise("o3")

    def sensor(i, n):
        return F.struct(i.alias("id"), F.struct(n.alias("name")).alias("parameter"))
    return t.table("customer").select(
        key.alias("location_id"),
        F.when(key % 6 != 0, F.col("c_name")).alias("name"),
        F.when(key % 3 == 0, "").otherwise(F.col("c_mktsegment")).alias("locality"),
        F.when(key % 5 != 0, F.concat(F.lit("Town "), F.col("c_nationkey").cast("string")))
        .alias("city"),
        (4 + key * 37 % 3900 / F.lit(100.0)).alias("lat"),
        F.when(key % 11 != 0, 64 + key * 53 % 3700 / F.lit(100.0)).alias("lon"),
        F.lit("net").alias("owner"),
        F.array(sensor(key * 9000, name), sensor(key * 9000 + 5, name)).alias("sensors"))


REGISTRY = f"""(SELECT lower(substr(replace(coalesce(CASE WHEN k % 6 <> 0 THEN c_name END,
    'loc_' || CAST(k AS VARCHAR)), ' ', '_'), 1, 49 - length(CAST(k AS VARCHAR)))
    || '_' || CAST(k AS VARCHAR)) AS station,
  k AS location_id, k * 9000 + 5 AS sensor_id, lat, lon,
  CASE WHEN k % 3 <> 0 THEN c_mktsegment WHEN k % 5 <> 0
    THEN 'Town ' || CAST(c_nationkey AS VARCHAR) ELSE 'Unknown' END AS city
FROM (SELECT *, c_custkey AS k, 4 + (c_custkey * 37 % 3900) / 100.0::DOUBLE AS lat,
  64 + (c_custkey * 53 % 3700) / 100.0::DOUBLE AS lon FROM customer)
WHERE k % 4 <> 0 AND k % 11 <> 0 AND lat BETWEEN 5 AND 40 AND lon BETWEEN 65 AND 100)"""


@query("m12_build_registry", "station:s location_id:i sensor_id:i lat:f lon:f city:s",
       sql=f"SELECT * FROM {REGISTRY}")
def build_registry(t):
    return registry.build_registry(found_locations(t))


@query("m12_label_registry", "station:s city:s state:s", sql=f"""
SELECT g.station, coalesce(n.city, 'Unknown') AS city, coalesce(n.state, 'Unknown') AS state
FROM {REGISTRY} g LEFT JOIN (SELECT * FROM (SELECT p.station, r.city, r.state, row_number() OVER (
    PARTITION BY p.station ORDER BY {haversine_sql('p.lat', 'p.lon', 'r.lat', 'r.lon')}, ord) AS rn
  FROM {REGISTRY} p JOIN {CITY_ROWS} r(ord, city, state, lat, lon)
  ON {haversine_sql('p.lat', 'p.lon', 'r.lat', 'r.lon')} < 81) WHERE rn = 1) n USING (station)""")
def label_registry(t):
    stations = registry.build_registry(found_locations(t))
    return registry.label_cities(stations, dims.cities(t.spark))


@query("m12_clean_registry", "station:s sensor_id:i reason:s", sql=f"""
SELECT station, sensor_id, CASE WHEN NOT (lat BETWEEN 6.5 AND 37.5 AND lon BETWEEN 67 AND 97.5)
  THEN 'outside area' WHEN NOT (sensor_id BETWEEN 2000000 AND 12100000 OR
    sensor_id BETWEEN 12200000 AND 16800000) THEN 'unproductive sensor' END AS reason
FROM {REGISTRY}""")
def clean_registry(t):
    stations = registry.build_registry(found_locations(t))
    kept, dropped = registry.clean_stations(stations)
    return kept.withColumn("reason", F.lit(None).cast("string")).unionByName(dropped)


@query("m12_screen_registry", "station:s sensor_id:i data_start:s data_end:s", views="raw", sql=f"""
SELECT station, arg_min(sensor_id, i) AS sensor_id,
  strftime(arg_min(a, i), '%Y-%m-%dT%H:%M:%SZ') AS data_start,
  strftime(arg_min(b, i), '%Y-%m-%dT%H:%M:%SZ') AS data_end
FROM (SELECT station, unnest(ids) AS sensor_id, unnest([1, 2, 3]) AS i FROM {SITES})
JOIN (SELECT sensor_id, min(ts) AS a, max(ts) AS b FROM raw GROUP BY 1) USING (sensor_id) GROUP BY station""")
def screen_registry(t):
    seen = aggregate.sensor_coverage(t.raw(), ts="ts")
    return registry.screen_stations(sites(t), seen, cities=["SOMEWHERE"])
