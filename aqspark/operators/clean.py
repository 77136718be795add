"""Filters, cleaning and projections."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from aqspark.functions import fixed
from aqspark.functions.calendar import any_of
from aqspark.functions.scalars import as_col, clamp, iso_day
from aqspark.functions.text import is_pm25, is_pm25_archive


# --- stations --------------------------------------------------------------------------

def inside_box(lat, lon, box) -> Column:
    """False, never null, for missing coordinates."""
    south, north, west, east = box
    return F.coalesce(as_col(lat).between(south, north) & as_col(lon).between(west, east),
                      F.lit(False))


def in_bbox(df: DataFrame, box=fixed.WIDE_BOX, lat="lat", lon="lon") -> DataFrame:
    return df.filter(inside_box(lat, lon, box))


def is_productive(sensor_id, ranges=fixed.SENSOR_RANGES,
                  allow=fixed.SENSOR_EXCEPTIONS) -> Column:
    sensor_id = as_col(sensor_id)
    listed = sensor_id.isin(list(allow)) if allow else F.lit(False)
    return F.coalesce(any_of(sensor_id.between(lo, hi) for lo, hi in ranges) | listed,
                      F.lit(False))


def productive_sensors(df: DataFrame, col="sensor_id", **rule) -> DataFrame:
    return df.filter(is_productive(col, **rule))


def reject_reason(df: DataFrame, box=fixed.INNER_BOX, sensor="sensor_id",
                  **rule) -> DataFrame:
    """Add ``reason``, the first screening rule a station fails; null means kept."""
    lat, lon = (F.coalesce(F.col(c), F.lit(0.0)) for c in ("lat", "lon"))
    return df.withColumn(
        "reason",
        F.when(F.col(sensor).isNull(), "no sensor")
        .when(~inside_box(lat, lon, box), "outside area")
        .when(~is_productive(sensor, **rule), "unproductive sensor"))


def split_kept(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    return (df.filter(F.col("reason").isNull()).drop("reason"),
            df.filter(F.col("reason").isNotNull()))


def filter_cities(df: DataFrame, cities, col="city") -> DataFrame:
    return df.filter(F.lower(col).isin([c.lower() for c in cities]))


def find_stations(df: DataFrame, query: str) -> DataFrame:
    """Stations whose key or city contains the text, whatever its case."""
    q = query.lower()
    return df.filter(F.lower("station").contains(q)
                     | F.coalesce(F.lower("city").contains(q), F.lit(False)))


def has_location(df: DataFrame) -> DataFrame:
    return df.filter(F.col("location_id").isNotNull())


def sensor_candidates(sensors) -> Column:
    """PM2.5 sensor ids of a location, highest (newest) first; empty if there is none."""
    pm25 = F.filter(as_col(sensors), lambda s: is_pm25(s["parameter"]["name"]))
    return F.sort_array(F.transform(pm25, lambda s: s["id"]), asc=False)


# --- readings ----------------------------------------------------------------------------

def select_parameter(df: DataFrame, col="parameter", archive=False) -> DataFrame:
    return df.filter(is_pm25_archive(col) if archive else is_pm25(col))


def valid_range(df: DataFrame, col="pm25", low=0.0, high=fixed.MAX_READING) -> DataFrame:
    return df.filter(F.col(col).between(low, high))


def clip(df: DataFrame, col="pm25", low=0.0, high=fixed.MAX_READING) -> DataFrame:
    return df.withColumn(col, clamp(col, low, high))


def to_number(text) -> Column:
    """Number or null; ``nan`` is no reading either."""
    number = as_col(text).try_cast("double")
    return F.when(~F.isnan(number), number)


def coerce(df: DataFrame, ts="timestamp", value="pm25") -> DataFrame:
    """Texts to timestamp and number; rows where either fails are dropped."""
    return (df.withColumn(ts, F.try_to_timestamp(ts))
            .withColumn(value, to_number(value))
            .dropna(subset=[ts, value]))


def resolve_columns(df: DataFrame, aliases: dict[str, list[str]]) -> DataFrame | None:
    """Rename the first alias present to its canonical name. Missing time or value
    columns make the table unusable (None); a missing parameter column is left out."""
    found = {name: next((a for a in names if a in df.columns), None)
             for name, names in aliases.items()}
    if any(found[n] is None for n in found if n != "parameter"):
        return None
    return df.select(*[F.col(a).alias(n) for n, a in found.items() if a])


def effective_start(readings: DataFrame, stations: DataFrame, start: str,
                    ts="timestamp") -> DataFrame:
    """Readings from ``start`` on, or from the station's own first day if that is
    earlier and its data spans more than one moment."""
    known = F.when(F.col("data_start") != F.col("data_end"), iso_day("data_start"))
    begin = F.least(F.lit(start).cast("date"), known)      # least skips nulls
    begins = stations.select("station", begin.alias("_begin"))
    return (readings.join(begins, "station")
            .filter(F.col(ts) >= F.col("_begin").cast("timestamp")).drop("_begin"))


# --- feature rows -------------------------------------------------------------------------

def min_records(df: DataFrame, n: int, key="station") -> DataFrame:
    """Keep stations with at least ``n`` rows; counts are partly summed before the shuffle."""
    enough = df.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") >= n)
    return df.join(enough.select(key), key, "left_semi")


def drop_incomplete(df: DataFrame, cols=None) -> DataFrame:
    return df.dropna(subset=cols or ["pm25_lag24"] + fixed.TARGETS)


def drop_any_null(df: DataFrame) -> DataFrame:
    return df.dropna("any")


def ensure_columns(df: DataFrame, defaults: dict) -> DataFrame:
    """Add absent columns as constants; present ones keep their nulls."""
    absent = {c: F.lit(v).cast("double") for c, v in defaults.items()
              if c not in df.columns}
    return df.withColumns(absent) if absent else df


def zero_fill(df: DataFrame, cols) -> DataFrame:
    return df.fillna(0.0, subset=list(cols))


def project_features(df: DataFrame, keys=("timestamp", "station"),
                     cols=None) -> DataFrame:
    """The contract: keys, then the features in model order, then targets if present."""
    cols = cols or fixed.FEATURES + [t for t in fixed.TARGETS if t in df.columns]
    return df.select(*keys, *cols)


def to_float32(df: DataFrame) -> DataFrame:
    return df.select(*[
        F.col(f.name).cast("float").alias(f.name)
        if isinstance(f.dataType, T.NumericType) else F.col(f.name)
        for f in df.schema.fields])


def active_signals(cols=fixed.SHOWN_SIGNALS, above=0.1) -> Column:
    """Map of the signals stronger than ``above``, rounded to two digits."""
    all_signals = F.map_from_arrays(F.array(*[F.lit(c) for c in cols]),
                                    F.array(*[F.col(c).cast("double") for c in cols]))
    strong = F.map_filter(all_signals, lambda _, v: v > above)
    return F.transform_values(strong, lambda _, v: F.bround(v, 2))
