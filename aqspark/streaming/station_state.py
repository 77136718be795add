"""Each station's newest hours, as state that Structured Streaming keeps, checkpoints and restores."""

import contextlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from aqspark.functions import fixed
from aqspark.operators.clean import valid_range

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
# hours are numbered from the epoch; the clock of the library is UTC
SUMS = "station string, hour long, total double, n long"
MEANS = "station string, hour long, pm25 double"
STATE = "hours array<bigint>, totals array<double>, counts array<bigint>"
_HOUR = 3600


def hour_sums(readings: DataFrame) -> DataFrame:
    """Sums per station and hour, added up within each batch of rows before they are shuffled.

    A station with many rows sends few; the state adds the rest.
    """
    def run(batches):
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            seconds = pc.floor(pc.divide(pc.cast(pc.cast(rows["ts"], pa.timestamp("us")), pa.int64()).cast(pa.float64()), _HOUR * 1e6))
            rows = pa.table({"station": rows["station"], "hour": seconds.cast(pa.int64()), "pm25": rows["pm25"]})
            sums = rows.group_by(["station", "hour"]).aggregate([("pm25", "sum"), ("pm25", "count")])
            yield from sums.select(["station", "hour", "pm25_sum", "pm25_count"]).rename_columns(
                ["station", "hour", "total", "n"]).to_batches()

    known = readings.filter("pm25 IS NOT NULL AND ts IS NOT NULL AND station IS NOT NULL")
    return known.select("station", "ts", F.col("pm25").cast("double")).mapInArrow(run, SUMS)


def from_history(hours: DataFrame) -> DataFrame:
    """Hour means (station, timestamp, pm25) as sums of one reading each, to start a stream with."""
    return hours.filter("pm25 IS NOT NULL").select(
        "station", F.floor(F.unix_timestamp("timestamp") / _HOUR).alias("hour"), F.col("pm25").cast("double").alias("total"),
        F.lit(1).cast("long").alias("n"))


class NewestHours(StatefulProcessor):
    """Adds readings to the hours of a station and returns its hour means back to the ``keep``-th newest valid one.

    Impossible means do not count and are not returned, but their sums stay among the others, since late readings may
    still correct them. Hours before the oldest one wanted are forgotten. A station is forgotten as a whole when it has
    been silent for ``silence_ms`` of processing time, if that is given.
    """

    def __init__(self, keep: int, silence_ms: int | None = None, low=0.0, high=fixed.MAX_READING):
        self.keep, self.silence_ms, self.low, self.high = keep, silence_ms, low, high

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("hours", STATE)

    def _sums(self) -> dict[int, tuple[float, int]]:
        # one call: none is what a station without state has
        stored = self.state.get()
        if stored is None:
            return {}
        hours, totals, counts = stored
        return dict(zip(hours, zip(totals, counts, strict=True), strict=True))

    def _add(self, sums, frames: Iterator[pd.DataFrame]):
        for frame in frames:
            for hour, total, n in zip(frame["hour"].tolist(), frame["total"].tolist(), frame["n"].tolist(), strict=True):
                old = sums.get(hour, (0.0, 0))
                sums[hour] = (old[0] + total, old[1] + n)

    def _keep_newest(self, sums) -> list[tuple[int, float]]:
        """Store what may still matter; returns the valid means, oldest first."""
        means = sorted((h, total / n) for h, (total, n) in sums.items() if self.low <= total / n <= self.high)[-self.keep:]
        if len(means) == self.keep:
            sums = {h: s for h, s in sums.items() if h >= means[0][0]}
        hours = sorted(sums)
        self.state.update((hours, [sums[h][0] for h in hours], [sums[h][1] for h in hours]))
        return means

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        sums = self._sums()
        self._add(sums, rows)
        means = self._keep_newest(sums)
        self._wake(timerValues)
        if means:
            yield pd.DataFrame({"station": key[0], "hour": [h for h, _ in means], "pm25": [m for _, m in means]})

    def handleInitialState(self, key, initialState, timerValues) -> None:
        sums = self._sums()
        self._add(sums, [initialState])
        self._keep_newest(sums)
        self._wake(timerValues)

    def _wake(self, timer_values):
        """One timer per station, moved on with every reading."""
        if self.silence_ms is None:
            return
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(timer_values.getCurrentProcessingTimeInMs() + self.silence_ms)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.state.clear()
        return iter(())

    def close(self) -> None:
        pass


def newest_hours(readings: DataFrame, keep: int, silence_ms: int | None = None, history: DataFrame | None = None) -> DataFrame:
    """(station, timestamp, pm25): the newest valid hours of every station that has news, as a stream in update mode.

    ``history`` holds hour means to begin with.
    """
    start = None if history is None else from_history(history).groupBy("station")
    found = hour_sums(readings).groupBy("station").transformWithStateInPandas(
        NewestHours(keep, silence_ms), MEANS, "Update", "None" if silence_ms is None else "ProcessingTime", start)
    return found.select("station", F.timestamp_seconds(F.col("hour") * _HOUR).alias("timestamp"), "pm25")


def stored_hours(spark: SparkSession, checkpoint: str) -> DataFrame:
    """(station, timestamp, total, n): the state itself, read from a stream's checkpoint, impossible hours included."""
    rows = spark.read.format("statestore").option("stateVarName", "hours").load(checkpoint)
    hours = rows.select("key.station", F.explode(F.arrays_zip("value.hours", "value.totals", "value.counts")).alias("s"))
    return hours.select("station", F.timestamp_seconds(F.col("s.hours") * _HOUR).alias("timestamp"),
                        F.col("s.totals").alias("total"), F.col("s.counts").alias("n"))


def stored_means(spark: SparkSession, checkpoint: str) -> DataFrame:
    """The valid hours that every station has in a stream's checkpoint, for windows of all stations at any time."""
    sums = stored_hours(spark, checkpoint)
    return valid_range(sums.select("station", "timestamp", (F.col("total") / F.col("n")).alias("pm25")))


@contextlib.contextmanager
def rocks_state(spark: SparkSession):
    """Streams started inside keep their state in RocksDB, which keyed state of this kind needs."""
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKS)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(PROVIDER)
        else:
            spark.conf.set(PROVIDER, before)
