"""Row windows W1–W13, each also over long series that span several segments."""

from pyspark.sql import functions as F

from aqspark.functions import fixed
from aqspark.operators import ranks, windows
from aqspark.queries.base import query

W = "WINDOW w AS (PARTITION BY station ORDER BY timestamp)"
LAG_SQL = ", ".join(f"lag(pm25, {k}) OVER w AS pm25_lag{k}" for k in fixed.LAGS)
LAG_OUT = " ".join(f"pm25_lag{k}:f" for k in fixed.LAGS)


def frame(rows):
    return (f"(PARTITION BY station ORDER BY timestamp ROWS BETWEEN {rows} PRECEDING "
            "AND 1 PRECEDING)")


def earlier(fn, rows, at_least):
    return (f"CASE WHEN count(pm25) OVER {frame(rows)} >= {at_least} "
            f"THEN {fn}(pm25) OVER {frame(rows)} END")


ROLL_SQL = f"""{earlier('avg', 24, 3)} AS pm25_rmean24, {earlier('max', 24, 3)} AS pm25_rmax24,
  {earlier('min', 24, 3)} AS pm25_rmin24,
  coalesce({earlier('stddev_samp', 24, 3)}, 0) AS pm25_rstd24"""
ROLL_OUT = "pm25_rmean24:f pm25_rmax24:f pm25_rmin24:f pm25_rstd24:f"
TREND_SQL = f"coalesce({earlier('avg', 6, 2)} - {earlier('avg', 12, 3)}, 0) AS pm25_trend6h"

# Order totals per priority and day: five series of some 2,400 rows
SERIES = """(SELECT o_orderpriority AS station, o_orderdate AS timestamp,
  CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS pm25
  FROM orders GROUP BY 1, 2)"""


def series(t):
    total = F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double")
    return t.table("orders").groupBy(
        F.col("o_orderpriority").alias("station"), F.col("o_orderdate").alias("timestamp")).agg(
        total.alias("pm25"))


SEGMENT = 300


@query("w01_lags", f"station:s timestamp:t pm25:f {LAG_OUT}", views="hourly",
       sql=f"SELECT *, {LAG_SQL} FROM hourly {W}")
def lags(t):
    return windows.add_lags(t.hourly())


@query("w01_lags_long_series", f"station:s timestamp:t {LAG_OUT}",
       sql=f"SELECT *, {LAG_SQL} FROM {SERIES} {W}")
def lags_long(t):
    return windows.add_lags(series(t), rows=SEGMENT)


@query("w02_rolling", f"station:s timestamp:t {ROLL_OUT}", views="hourly",
       sql=f"SELECT *, {ROLL_SQL} FROM hourly")
def rolling(t):
    return windows.add_rolling(t.hourly())


# totals are large, so fewer digits of their deviations are certain
@query("w02_rolling_long_series",
       "station:s timestamp:t pm25_rmean24:f6 pm25_rmax24:f6 pm25_rmin24:f6 pm25_rstd24:f4",
       sql=f"SELECT *, {ROLL_SQL} FROM {SERIES}")
def rolling_long(t):
    return windows.add_rolling(series(t), rows=SEGMENT)


@query("w03_trend", "station:s timestamp:t pm25_trend6h:f", views="hourly",
       sql=f"SELECT *, {TREND_SQL} FROM hourly")
def trend(t):
    return windows.add_trend(t.hourly())


TARGET_SQL = ", ".join(f"lead(pm25, {h}) OVER w AS target_{h}h" for h in range(1, 25))
TARGET_OUT = " ".join(f"target_{h}h:f" for h in range(1, 25))


@query("w04_targets", f"station:s timestamp:t {TARGET_OUT}", views="hourly",
       sql=f"SELECT *, {TARGET_SQL} FROM hourly {W}")
def targets(t):
    return windows.add_targets(t.hourly())


@query("w04_targets_long_series", f"station:s timestamp:t {TARGET_OUT}",
       sql=f"SELECT *, {TARGET_SQL} FROM {SERIES} {W}")
def targets_long(t):
    return windows.add_targets(series(t), rows=SEGMENT)


# every reading above a level is unknown, and one series has no reading at all
HOLES = "CASE WHEN pm25 < {level} AND station NOT IN ('st_3', '3-MEDIUM') THEN pm25 END"


def holes(df, level):
    return df.withColumn("x", F.when((F.col("pm25") < level)
                                     & ~F.col("station").isin("st_3", "3-MEDIUM"), F.col("pm25")))


def neighbours_sql(source, level):
    """Each row with the nearest known position and value on both sides."""
    x = HOLES.format(level=level)
    back = "OVER (PARTITION BY station ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    ahead = "OVER (PARTITION BY station ORDER BY pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)"
    return f"""(SELECT *, last_value(p IGNORE NULLS) {back} AS p0, last_value(x IGNORE NULLS) {back} AS x0,
  first_value(p IGNORE NULLS) {ahead} AS p1, first_value(x IGNORE NULLS) {ahead} AS x1
FROM (SELECT *, CASE WHEN x IS NOT NULL THEN pos END AS p FROM (SELECT *, {x} AS x,
  row_number() OVER (PARTITION BY station ORDER BY timestamp) AS pos FROM {source})))"""


def interpolate_sql(source, level):
    return f"""SELECT station, timestamp, coalesce(x, x0 + (x1 - x0) * ((pos - p0) / (p1 - p0)),
  x0, x1, -1) AS x FROM {neighbours_sql(source, level)}"""


def fill_sql(source, level):
    return f"SELECT station, timestamp, coalesce(x0, x1, 0) AS x FROM {neighbours_sql(source, level)}"


@query("w05_interpolate", "station:s timestamp:t x:f", views="hourly",
       sql=interpolate_sql("hourly", 60))
def interpolated(t):
    return windows.interpolate(holes(t.hourly(), 60), ["x"], default=-1)


@query("w05_interpolate_long_series", "station:s timestamp:t x:f",
       sql=interpolate_sql(SERIES, 150000))
def interpolated_long(t):
    return windows.interpolate(holes(series(t), 150_000), ["x"], default=-1, rows=SEGMENT)


@query("w06_fill_forward_back", "station:s timestamp:t x:f", views="hourly",
       sql=fill_sql("hourly", 25))
def filled(t):
    return windows.fill_forward_back(holes(t.hourly(), 25), ["x"])


@query("w06_fill_long_series", "station:s timestamp:t x:f", sql=fill_sql(SERIES, 60000))
def filled_long(t):
    return windows.fill_forward_back(holes(series(t), 60_000), ["x"], rows=SEGMENT)


@query("w07_last_rows", "station:s timestamp:t pm25:f", views="hourly", sql="""
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY station ORDER BY timestamp DESC) AS rn,
  count(*) OVER (PARTITION BY station) AS n FROM hourly) WHERE rn <= 72 AND n >= 72""")
def last_rows(t):
    return windows.last_n(t.hourly(), 72)


@query("w08_station_ids", "station:s base1:i base0:i", sql="""
SELECT station, row_number() OVER (ORDER BY station) AS base1,
  row_number() OVER (ORDER BY station) - 1 AS base0
FROM (SELECT DISTINCT 'u' || CAST(user_id AS VARCHAR) AS station FROM events)""")
def ids(t):
    users = t.table("events").select(F.concat(F.lit("u"), F.col("user_id").cast("string"))
                                     .alias("station"))
    return ranks.station_ids(users, 1).select(
        "station", F.col("station_id").alias("base1"), (F.col("station_id") - 1).alias("base0"))


def sequence_sql(gap):
    end = "1 PRECEDING" if gap else "CURRENT ROW"
    start = "72 PRECEDING" if gap else "71 PRECEDING"
    over = f"OVER (PARTITION BY station ORDER BY timestamp ROWS BETWEEN {start} AND {end})"
    return f"""SELECT * FROM (SELECT station, timestamp,
  row_number() OVER (PARTITION BY station ORDER BY timestamp) - 1 AS row,
  count(*) OVER (PARTITION BY station) AS n, count(*) {over} AS len,
  CAST(first_value(pm25) {over} AS FLOAT) AS x_first,
  CAST(last_value(pm25) {over} AS FLOAT) AS x_last,
  CAST(pm25 AS FLOAT) AS y_first FROM hourly)
WHERE row >= 72 AND row <= n - 24"""


SEQUENCE_OUT = "station:s timestamp:t row:i len:i x_first:f x_last:f y_first:f"


def sequence_ends(t, gap):
    s = windows.sequences(t.hourly(), ["pm25"], ["pm25"], gap=gap)
    return s.select("station", "timestamp", "row", F.size("x").alias("len"),
                    F.element_at("x", 1)[0].alias("x_first"),
                    F.element_at("x", -1)[0].alias("x_last"),
                    F.element_at("y", 1).alias("y_first"))


@query("w09_sequences", SEQUENCE_OUT, views="hourly", sql=sequence_sql(1))
def sequences(t):
    return sequence_ends(t, 1)


@query("w09_sequences_aligned", SEQUENCE_OUT, views="hourly", sql=sequence_sql(0))
def sequences_aligned(t):
    return sequence_ends(t, 0)


@query("w10_chrono_split", "station:s timestamp:t split:s", views="hourly", sql="""
SELECT station, timestamp, CASE WHEN i < floor(n * 0.70::DOUBLE) THEN 'train'
  WHEN i < floor(n * (0.70::DOUBLE + 0.15::DOUBLE)) THEN 'val' ELSE 'test' END AS split
FROM (SELECT *, row_number() OVER (ORDER BY timestamp, station) - 1 AS i, count(*) OVER () AS n
      FROM hourly)""")
def split(t):
    return ranks.chrono_split(t.hourly())


@query("w11_dedupe_by_source",
       "l_orderkey:i l_linenumber:i src:s l_extendedprice:f l_quantity:f", sql="""
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber
  ORDER BY CASE src WHEN 'odd' THEN 1 ELSE 2 END, l_extendedprice, l_quantity) AS rn
  FROM (SELECT l_orderkey, l_linenumber, l_extendedprice, l_quantity,
          CASE WHEN l_suppkey % 2 = 1 THEN 'odd' ELSE 'even' END AS src FROM lineitem))
WHERE rn = 1""")
def dedupe(t):
    src = F.when(F.col("l_suppkey") % 2 == 1, "odd").otherwise("even")
    lines = t.table("lineitem").select(
        "l_orderkey", "l_linenumber", "l_extendedprice", "l_quantity", src.alias("src"))
    return windows.dedupe_by_source(lines, ["l_orderkey", "l_linenumber"], "src", ["odd", "even"])


@query("w12_current_value", "station:s timestamp:t pm25:f", views="hourly", sql="""
SELECT station, max(timestamp) AS timestamp, arg_max(pm25, timestamp) AS pm25
FROM hourly GROUP BY station""")
def current(t):
    return windows.current_value(t.hourly())


@query("w13_densify_hours", "station:s timestamp:t pm25:f", views="hourly", sql="""
SELECT g.station, g.timestamp, coalesce(pm25, 0) AS pm25 FROM (
  SELECT station, unnest(generate_series(a, b, INTERVAL 1 HOUR)) AS timestamp
  FROM (SELECT station, min(timestamp) AS a, max(timestamp) AS b FROM hourly GROUP BY station)) g
LEFT JOIN hourly h ON g.station = h.station AND g.timestamp = h.timestamp""")
def dense(t):
    hourly = t.hourly()
    spans = hourly.groupBy("station").agg(F.min("timestamp").alias("a"),
                                          F.max("timestamp").alias("b"))
    return windows.densify_hours(hourly, spans, F.col("a"), F.col("b"))
