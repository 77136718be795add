"""Structured Streaming versions of the hourly facts, features and forecasts."""

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aqspark.functions import fixed
from aqspark.functions.text import news_score
from aqspark.operators.clean import valid_range
from aqspark.operators.spatial import fire_measures, shared_sites, site_hours, spot_sums, station_hours
from aqspark.plans.features import live_window
from aqspark.plans.forecast import score
from aqspark.plans.news import matched_articles
from aqspark.storage import materialise, scratch
from aqspark.streaming.changes import add_changes
from aqspark.streaming.station_state import newest_hours, rocks_state

LATENESS = "2 hours"
# a live window has 72 rows, and the longest lag looks back 72 rows from the first of them
HISTORY_ROWS = fixed.LOOKBACK + max(fixed.LAGS)


def stream_hourly_mean(readings: DataFrame, lateness=LATENESS, ts="ts",
                       value="pm25") -> DataFrame:
    """Mean per station and hour; an hour comes out once no more late rows are awaited."""
    hours = (readings.filter(F.col(value).isNotNull())
             .withWatermark(ts, lateness)
             .groupBy(F.window(ts, "1 hour").alias("_w"), "station")
             .agg(F.avg(value).alias(value)))
    return valid_range(hours.select("station", F.col("_w.start").alias("timestamp"), value), value)


def stream_dedupe(readings: DataFrame, keys=("sensor_id", "ts"), lateness=LATENESS,
                  ts="ts") -> DataFrame:
    """First delivery of each reading; keys are remembered as long as rows may be late."""
    return readings.withWatermark(ts, lateness).dropDuplicatesWithinWatermark(list(keys))


def stream_fire_hours(fires: DataFrame, stations: DataFrame, km=fixed.FIRE_RADIUS_KM,
                      lateness=LATENESS) -> DataFrame:
    """Fire measures per station and hour from a stream of detections.

    Detections are summed by spot and hour first. The hour's spots leave that state together, once nothing more is awaited, and
    only then meet the stations.
    """
    seen = fires.filter(F.col("frp").isNotNull()).withWatermark("timestamp", lateness)
    seen = seen.filter(F.col("latitude").isNotNull() & F.col("longitude").isNotNull())
    spots = seen.groupBy(F.window("timestamp", "1 hour").alias("_w"), "latitude", "longitude").agg(*spot_sums())
    sites, members = shared_sites(stations)
    sums = site_hours(sites, spots, km, "_w").groupBy("_w", "_site").agg(*fire_measures())
    hours = station_hours(sums, members, "_w")
    return hours.select("station", F.col("_w.start").alias("timestamp"), *fixed.FIRE_MEASURES)


def stream_news_counts(articles: DataFrame, signal_terms=None, city_terms=None,
                       lateness=LATENESS) -> DataFrame:
    """Articles and score per city, signal and hour."""
    matched = matched_articles(articles.withWatermark("timestamp", lateness),
                               signal_terms, city_terms)
    hours = matched.groupBy(F.window("timestamp", "1 hour").alias("_w"), "city", "signal").agg(
        F.count(F.lit(1)).alias("n"))
    return hours.select("city", F.col("_w.start").alias("timestamp"), "signal", "n",
                        news_score("n").alias("score"))


def run_available(stream: DataFrame, path: str, checkpoint: str, mode="append") -> None:
    """Process what has arrived into a parquet table, then stop."""
    query = (stream.writeStream.format("parquet").outputMode(mode)
             .option("checkpointLocation", checkpoint)
             .trigger(availableNow=True).start(path))
    query.awaitTermination()


def run_updates(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Process what has arrived in update mode, then stop: rows that changed are added to a log, of which
    ``changes.latest_rows`` shows the current state by key."""
    def add(rows, batch_id):
        add_changes(rows, path, batch_id)
    query = (stream.writeStream.foreachBatch(add).outputMode("update")
             .option("checkpointLocation", checkpoint)
             .trigger(availableNow=True).start())
    query.awaitTermination()


# --- features and forecasts of the stations a batch touches --------------------------------

def window_batches(sink: Callable[[DataFrame, int], None], stations: DataFrame, weather: DataFrame | None = None,
                   fires: DataFrame | None = None, news: DataFrame | None = None):
    """``foreachBatch`` handler of a stream of newest hours: live windows of its stations go to ``sink``.

    A batch without readings is passed over. Tables that a batch writes on its way are
    deleted when the sink is done.
    """
    def handle(hours: DataFrame, batch_id: int) -> None:
        with scratch(hours.sparkSession):
            # the state moves on once per batch, so its rows are written before they are used more than once
            hours = materialise(hours)
            if not hours.isEmpty():
                sink(live_window(hours, stations, weather, fires, news), batch_id)
    return handle


def start_windows(readings: DataFrame, checkpoint: str, handler, history_rows=HISTORY_ROWS, silence_ms=None,
                  history: DataFrame | None = None, trigger=None):
    """Start a stream whose state is the newest hours of every station; what changes goes to ``handler``.

    To forget silent stations the stream has to go on, so ``silence_ms`` needs a ``processingTime`` trigger.
    """
    if silence_ms is not None and not (trigger or {}).get("processingTime"):
        raise ValueError("stations fall silent only in a stream that goes on: give a processingTime trigger")
    hours = newest_hours(readings, history_rows, silence_ms, history)
    with rocks_state(readings.sparkSession):
        return (hours.writeStream.outputMode("update").foreachBatch(handler)
                .option("checkpointLocation", checkpoint)
                .trigger(**(trigger or {"availableNow": True})).start())


def stream_features(readings: DataFrame, out: str, checkpoint: str, stations: DataFrame,
                    weather=None, fires=None, news=None, **state):
    """Keep the newest feature rows of every station in ``out``; read them by ``latest_rows``.

    ``state`` are the options of ``start_windows``: hours to keep, how long a silent station is remembered, hours
    to begin with, and the trigger (default: process what has arrived, then stop).
    """
    def sink(window, batch_id):
        add_changes(window, out, batch_id)
    return start_windows(readings, checkpoint, window_batches(sink, stations, weather, fires, news), **state)


def stream_score(readings: DataFrame, out: str, checkpoint: str, stations: DataFrame, load, params, target, ids=None,
                 features=fixed.FEATURES, weather=None, fires=None, news=None, **state):
    """Keep the newest forecast document of every station in ``out``; read them by ``latest_rows`` as JSON."""
    def sink(window, batch_id):
        add_changes(score(window, load, params, target, ids, features), out, batch_id, "json")
    return start_windows(readings, checkpoint, window_batches(sink, stations, weather, fires, news), **state)
