"""Streams R1–R6 over landed files. What has arrived is processed, then read back.

The rows arrive in four files, each of them a batch: one for each quarter of the time, but one row in ten comes a file later than
its time, one two files and one three files later. When a batch begins, rows at or before the watermark are too late; that is two hours
before the newest row of all files but the one just before it, because Spark moves the watermark on between batches and drops by
the one before. ``Delivery`` says the same in SQL, so the twins tell exactly which rows count.
"""

from dataclasses import dataclass

from pyspark.sql import functions as F

from aqspark.functions import fixed
from aqspark.operators.ranks import station_ids
from aqspark.plans import forecast
from aqspark.queries.aggregates import FIRE_HOURS, FIRE_OUT
from aqspark.queries.base import query
from aqspark.queries.joining import LIVE_OUT, live_sql
from aqspark.queries.scalars import PLACES, TERMS, mention_sql
from aqspark.sources import schemas
from aqspark.sources.readers import stream_readings
from aqspark.storage import new_path, remove, stored_files
from aqspark.streaming import streams
from aqspark.streaming.changes import latest_rows
from aqspark.streaming.station_state import stored_means


FILES = 4
# of a landed file, in one part
LANDED_BYTES = 64 << 20


@dataclass
class Delivery:
    """Which file brings each row: ``source`` is a view, ``key`` an integer per row, in both engines' SQL."""
    source: str
    key: str
    ts: str = "ts"

    def land(self, t, df, schema, again=None):
        """A folder of files and the stream that reads one after the other. ``again`` (SQL) is how many files
        later each row comes a second time.

        A file of more than ``LANDED_BYTES`` lands in parts of about that size, so that no task writes or reads all of it. All have
        as many parts, if need be empty ones, and the stream takes that many at a time.
        """
        path, staged = new_path(t.spark, "landing"), new_path(t.spark, "staged")
        names = [c.strip().split(" ")[0] for c in schema.split(",")]
        seconds = F.unix_timestamp(self.ts)
        first, last = df.agg(F.min(seconds), F.max(seconds)).first()
        due = F.floor((seconds - F.lit(first)) * FILES / F.lit(max(last - first, 0) + 1))
        rows = df.withColumn("_file", F.least(F.lit(FILES - 1), due + F.expr(f"greatest(0, {self.key} % 10 - 6)")))
        if again:
            later = rows.withColumn("_file", F.least(F.lit(FILES - 1), F.col("_file") + F.expr(again)))
            rows = rows.unionByName(later)
        rows = rows.select(*names, F.col("_file").cast("int"))
        rows.write.partitionBy("_file").parquet(staged)
        parts = max(1, *[-(-stored_files(t.spark, f"{staged}/_file={n}")[0] // LANDED_BYTES) for n in range(FILES)])
        arrived = t.spark.read.schema(rows.schema).parquet(staged)
        nothing = t.spark.createDataFrame([], rows.select(*names).schema)
        for number in range(FILES):
            arrived.filter(F.col("_file") == number).select(*names).coalesce(parts).write.mode("append").parquet(path)
            # Spark writes no file for a task without rows
            for _ in range(stored_files(t.spark, path)[1], parts * (number + 1)):
                nothing.coalesce(1).write.mode("append").parquet(path)
        remove(t.spark, staged)
        return stream_readings(t.spark, path, schema, files_per_trigger=parts)

    def due_sql(self):
        """The rows with the file that brings them, the milliseconds of their time, and where the watermark dropped by stands then."""
        seconds = f"epoch_ms({self.ts}) // 1000"
        arrived = f"""SELECT *, epoch_ms({self.ts}) AS ms, least({FILES - 1}, ({seconds} - first) * {FILES} // (last - first + 1)
    + greatest(0, {self.key} % 10 - 6)) AS file FROM {self.source},
    (SELECT min({seconds}) AS first, max({seconds}) AS last FROM {self.source})"""
        marks = f"""SELECT n, coalesce((SELECT max(ms) - 7200000 FROM ({arrived}) WHERE file < n - 1), 0) AS mark FROM range({FILES}) t(n)"""
        return f"(SELECT a.* EXCLUDE (first, last), mark FROM ({arrived}) a JOIN ({marks}) ON file = n)"

    def counted_sql(self):
        """The rows that are not too late for their hour."""
        return f"(SELECT * FROM {self.due_sql()} WHERE epoch_ms(date_trunc('hour', {self.ts})) + 3600000 > mark)"

    def closed_sql(self):
        """Condition on ``timestamp``: the hour is complete when all has arrived."""
        return f"timestamp + INTERVAL 1 HOUR <= (SELECT max({self.ts}) - INTERVAL 2 HOUR FROM {self.source})"


READINGS = Delivery("raw", "event_id")
FIRES = Delivery("fires", "CAST(round(frp * 100) AS BIGINT)", "timestamp")
ARTICLES = Delivery("articles", "doc_id", "timestamp")


def drained(t, stream):
    out, state = new_path(t.spark, "stream"), new_path(t.spark, "state")
    streams.run_available(stream, out, state)
    return t.spark.read.schema(stream.schema).parquet(out)


def updated(t, stream, keys):
    out, state = new_path(t.spark, "changes"), new_path(t.spark, "state")
    streams.run_updates(stream, out, state)
    return latest_rows(t.spark, out, stream.schema, keys=keys)


@query("s17_stream_readings", "sensor_id:i station:s ts:t pm25:f", views="raw",
       sql="SELECT sensor_id, station, ts, pm25 FROM raw")
def readings(t):
    return drained(t, READINGS.land(t, t.raw(), schemas.READINGS))


HOURS = f"""SELECT station, date_trunc('hour', ts) AS timestamp, avg(pm25) AS pm25 FROM {READINGS.counted_sql()}
GROUP BY ALL HAVING avg(pm25) BETWEEN 0 AND 1500"""


@query("r01_stream_hourly_mean", "station:s timestamp:t pm25:f", views="raw",
       sql=f"SELECT * FROM ({HOURS}) WHERE {READINGS.closed_sql()}")
def hourly(t):
    """Hours come out once, when nothing more is awaited for them."""
    return drained(t, streams.stream_hourly_mean(READINGS.land(t, t.raw(), schemas.READINGS)))


@query("r01_stream_hourly_updates", "station:s timestamp:t pm25:f", views="raw", sql=HOURS)
def hourly_updates(t):
    """Hours come out with every reading that changes them, the open ones too."""
    means = streams.stream_hourly_mean(READINGS.land(t, t.raw(), schemas.READINGS))
    return updated(t, means, ["station", "timestamp"])


@query("r02_stream_dedupe", "sensor_id:i station:s ts:t pm25:f", views="raw",
       sql=f"SELECT sensor_id, station, ts, pm25 FROM {READINGS.due_sql()} WHERE ms > mark")
def dedupe(t):
    """Every reading is delivered a second time, in the same file, the next or the one after."""
    twice = READINGS.land(t, t.raw(), schemas.READINGS, again="event_id % 3")
    return drained(t, streams.stream_dedupe(twice))


@query("r03_stream_fire_hours", f"station:s timestamp:t {FIRE_OUT}", views="fires places",
       sql=f"SELECT * FROM ({FIRE_HOURS.replace('FROM fires', f'FROM {FIRES.counted_sql()}').format(places='places')}) "
           f"WHERE {FIRES.closed_sql()}")
def fire_hours(t):
    fires = FIRES.land(t, t.fires(), schemas.FIRE_EVENTS)
    return drained(t, streams.stream_fire_hours(fires, t.places()))


NEWS = "SELECT *, least(n / 3.0, 1) AS score FROM (" + " UNION ALL ".join(
    f"SELECT '{c}' AS city, date_trunc('hour', timestamp) AS timestamp, '{s}' AS signal, "
    f"count(*) AS n FROM counted WHERE {mention_sql(ct)} AND {mention_sql(st)} GROUP BY 2"
    for c, ct in PLACES.items() for s, st in TERMS.items()) + ")"
COUNTED = f"WITH counted AS MATERIALIZED {ARTICLES.counted_sql()} "


@query("r04_stream_news_counts", "city:s timestamp:t signal:s n:i score:f", views="articles",
       sql=f"{COUNTED} {NEWS} WHERE {ARTICLES.closed_sql()}")
def news_counts(t):
    articles = ARTICLES.land(t, t.articles(), schemas.ARTICLE_ROWS)
    return drained(t, streams.stream_news_counts(articles, TERMS, PLACES))


@query("r04_stream_news_updates", "city:s timestamp:t signal:s n:i score:f", views="articles", sql=f"{COUNTED} {NEWS}")
def news_updates(t):
    articles = ARTICLES.land(t, t.articles(), schemas.ARTICLE_ROWS)
    return updated(t, streams.stream_news_counts(articles, TERMS, PLACES), ["city", "timestamp", "signal"])


def disturbed(t):
    """Readings of which one station's clock runs two months ahead, and another fails every sixth hour."""
    ahead = F.when(F.col("station") == "st_1", F.col("ts") + F.expr("INTERVAL 60 DAYS")).otherwise(F.col("ts"))
    fails = (F.col("station") == "st_2") & (F.hour("ts") % 6 == 0)
    return t.raw().withColumns({"ts": ahead, "pm25": F.when(fails, F.col("pm25") - 5000).otherwise(F.col("pm25"))})


# every station's newest valid rows, however far its clock is from that of others and whenever its readings came
DISTURBED = """(SELECT station, date_trunc('hour', ts) AS timestamp, avg(pm25) AS pm25 FROM (
  SELECT station, CASE WHEN station = 'st_2' AND hour(ts) % 6 = 0 THEN pm25 - 5000 ELSE pm25 END AS pm25,
    CASE WHEN station = 'st_1' THEN ts + INTERVAL 60 DAY ELSE ts END AS ts FROM raw)
  GROUP BY ALL HAVING avg(pm25) BETWEEN 0 AND 1500)"""
NEWEST = f"""(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY station
  ORDER BY timestamp DESC) AS rn FROM {DISTURBED}) WHERE rn <= {{rows}})"""


@query("r05_stream_features", LIVE_OUT, views="raw stations", sql=live_sql(DISTURBED))
def features(t):
    out = new_path(t.spark, "windows")
    streams.stream_features(READINGS.land(t, disturbed(t), schemas.READINGS), out, new_path(t.spark, "state"),
                            t.stations()).awaitTermination()
    return latest_rows(t.spark, out)


@query("r05_stored_hours", "station:s timestamp:t pm25:f", views="raw", sql=f"""
SELECT station, timestamp, pm25 FROM {NEWEST.format(rows=144)}""")
def stored(t):
    """The state of the stream, as its checkpoint has it: the hours of every station that a window can still need."""
    state = new_path(t.spark, "state")
    streams.start_windows(READINGS.land(t, disturbed(t), schemas.READINGS), state, lambda hours, i: hours.count()).awaitTermination()
    return stored_means(t.spark, state)


@query("r06_stream_score", "station:s later:f2", views="raw", sql=f"""
SELECT station, round(CAST(CAST(pm25 AS FLOAT) AS DOUBLE), 1) AS later FROM {NEWEST.format(rows=72)}
WHERE rn = 1 AND station IN (SELECT station FROM {NEWEST.format(rows=72)} GROUP BY 1 HAVING count(*) >= 72)""")
def score(t):
    out = new_path(t.spark, "documents")
    load = forecast.persistence(fixed.FEATURES.index("pm25"))
    streams.stream_score(
        READINGS.land(t, disturbed(t), schemas.READINGS), out, new_path(t.spark, "state"), t.stations(), load,
        {"pm25": (0.0, 64.0)}, (0.0, 64.0), ids=station_ids(t.stations())).awaitTermination()
    schema = "station string, forecast map<string, struct<pm25: double>>"
    return latest_rows(t.spark, out, schema, "json").select("station", F.col("forecast")["+9h"]["pm25"].alias("later"))
