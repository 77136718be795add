"""Readers of landed documents, tables and streams."""

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from aqspark.functions import fixed
from aqspark.functions.scalars import acquired_at
from aqspark.operators.clean import ensure_columns
from aqspark.sources import schemas


def _documents(spark, path, schema, multiline=False, broken="fail"):
    """JSON documents. One that cannot be parsed stops the job, or with ``broken="skip"``
    is left out; ``broken_documents`` lists those."""
    if broken not in ("fail", "skip"):
        raise ValueError(f"broken: {broken}")
    reader = spark.read.option("multiLine", multiline)
    if broken == "fail":
        return reader.schema(schema).option("mode", "FAILFAST").json(path)
    return reader.schema(schema).option("mode", "DROPMALFORMED").json(path)


def broken_documents(spark: SparkSession, path, schema, multiline=False) -> DataFrame:
    """(file, document) of every document under ``path`` that does not parse as ``schema``."""
    columns = T.StructType.fromDDL(schema).add("_broken", "string")
    rows = (spark.read.schema(columns).option("multiLine", multiline)
            .option("columnNameOfCorruptRecord", "_broken").json(path))
    # the other columns have to be parsed for a document to be found broken
    parsed = F.to_json(F.struct(*[c for c in columns.names if c != "_broken"]))
    return (rows.select(F.col("_metadata.file_path").alias("file"), F.col("_broken").alias("document"),
                        parsed.alias("_parsed"))
            .filter(F.col("document").isNotNull() & F.coalesce(F.col("_parsed") != "", F.lit(True)))
            .drop("_parsed"))


def read_locations(spark: SparkSession, path, multiline=False, broken="fail") -> DataFrame:
    """Location pages → one row per location, sensors still nested."""
    pages = _documents(spark, path, schemas.LOCATIONS, multiline, broken)
    return pages.select(F.explode("results").alias("l")).select(
        F.col("l.id").alias("location_id"), F.col("l.name").alias("name"),
        F.col("l.locality").alias("locality"), F.col("l.city").alias("city"),
        F.col("l.coordinates.latitude").alias("lat"),
        F.col("l.coordinates.longitude").alias("lon"),
        F.coalesce(F.get(F.col("l.providers"), F.lit(0))["name"], F.lit("")).alias("owner"),
        F.col("l.sensors").alias("sensors"))


def _moment(period):
    """Start of a measuring period, under either of its two names."""
    texts = [F.nullif(period[name]["utc"], F.lit("")) for name in ("datetimeFrom", "dateFrom")]
    return F.try_to_timestamp(F.coalesce(*texts))


def read_hourly_measurements(spark: SparkSession, path, multiline=False,
                             broken="fail") -> DataFrame:
    """Value pages → (sensor_id, ts, value) without incomplete readings."""
    pages = _documents(spark, path, schemas.MEASUREMENTS, multiline, broken)
    rows = pages.select("sensor_id", F.explode("results").alias("r"))
    return rows.select("sensor_id", _moment(F.col("r.period")).alias("ts"),
                       F.col("r.value").alias("value")).dropna(subset=["ts", "value"])


def read_parameter_measurements(spark: SparkSession, path, params=fixed.COPOLLUTANTS,
                                multiline=False, broken="fail") -> DataFrame:
    """Value pages that name their pollutant → (location_id, parameter, ts, value)."""
    pages = _documents(spark, path, schemas.MEASUREMENTS, multiline, broken)
    named = pages.withColumn("parameter", F.lower("parameter.name")).filter(
        F.col("parameter").isin(list(params)))
    rows = named.select("location_id", "parameter", F.explode("results").alias("r"))
    return rows.select("location_id", "parameter", _moment(F.col("r.period")).alias("ts"),
                       F.col("r.value").alias("value")).dropna(subset=["ts", "value"])


def read_weather(spark: SparkSession, path, require_temperature=True,
                 multiline=False, broken="fail") -> DataFrame:
    """Parallel-array series → one row per cell and hour.

    A variable that a document lacks is null; a missing boundary layer height is 0.
    """
    docs = _documents(spark, path, schemas.WEATHER, multiline, broken)
    height = F.coalesce(F.col("hourly.boundary_layer_height"),
                        F.transform("hourly.time", lambda _: F.lit(0.0)))
    series = [F.col("hourly.time").alias("time")]
    series += [F.col(f"hourly.{c}").alias(c) for c in fixed.WEATHER[:-1]]
    series += [height.alias("boundary_layer_height")]
    rows = docs.filter(F.col("hourly.time").isNotNull())
    # absent arrays would null the whole zip, so they become empty
    filled = [s if i in (0, len(series) - 1) else
              F.coalesce(F.col(f"hourly.{fixed.WEATHER[i - 1]}"),
                         F.array().cast("array<double>")).alias(fixed.WEATHER[i - 1])
              for i, s in enumerate(series)]
    rows = rows.select("cell_lat", "cell_lon", F.inline(F.arrays_zip(*filled)))
    rows = rows.withColumn("timestamp", F.try_to_timestamp("time")).drop("time")
    return rows.dropna(subset=["temperature_2m"]) if require_temperature else rows


def read_fires(spark: SparkSession, path) -> DataFrame:
    """Fire detections with their hour; rows without radiative power are dropped."""
    rows = spark.read.schema(schemas.FIRES).option("header", True).csv(path)
    hour = F.date_trunc("hour", acquired_at("acq_date", "acq_time"))
    return rows.select(hour.alias("timestamp"), "latitude", "longitude", "frp",
                       "bright_ti4", "bright_ti5").dropna(subset=["frp"])


# commas that no quotes enclose
CELL_END = ',(?=(?:[^"]*"[^"]*")*[^"]*$)'


def read_archive(spark: SparkSession, root, stations=None, start=None, end=None) -> DataFrame:
    """Daily archive files under ``locationid=/year=/month=`` → texts
    (location_id, timestamp, pm25, parameter).

    Files name and order their columns differently, and may have any number of them; each
    file's own header line says which column is which. A file holds one day, so it is read
    as one text, cut into header and lines in a single pass. Files without a time or value
    column are skipped; missing days are simply not there. ``stations`` prunes to their
    locations, ``start``/``end`` to their months and then days.
    """
    files = (spark.read.schema("value string, locationid bigint, year int, month int")
             .option("ignoreMissingFiles", True).text(root, wholetext=True))
    month = F.col("year") * 12 + F.col("month")
    for bound, keep in ((start, month.__ge__), (end, month.__le__)):
        if bound:
            year, month_of_year = (int(x) for x in bound.split("-")[:2])
            files = files.filter(keep(year * 12 + month_of_year))
    if stations is not None:
        wanted = stations.filter("location_id is not null").select(
            F.col("location_id").alias("locationid")).distinct()
        files = files.join(wanted, "locationid", "left_semi")

    def cells(line):
        parts = F.split(line, CELL_END)
        return F.transform(parts, lambda c: F.regexp_replace(
            F.regexp_replace(c, '^\\s*"|"\\s*$', ""), '""', '"'))

    def place(head, aliases):
        return F.coalesce(*[F.nullif(F.array_position(head, a), F.lit(0)) for a in aliases])

    def is_head(line):
        head = cells(line)
        return F.arrays_overlap(head, F.array(*[F.lit(a) for a in fixed.TIME_ALIASES])) & F.arrays_overlap(
            head, F.array(*[F.lit(a) for a in fixed.VALUE_ALIASES]))

    lines = files.select("locationid", F.filter(
        F.split("value", "\r?\n"), lambda x: F.trim(x) != "").alias("_lines"))
    heads = lines.withColumn("_head", cells(F.get(F.filter("_lines", is_head), F.lit(0))))
    heads = heads.filter(F.col("_head").isNotNull()).select(
        "locationid", "_lines", place(F.col("_head"), fixed.TIME_ALIASES).alias("_t"),
        place(F.col("_head"), fixed.VALUE_ALIASES).alias("_v"),
        place(F.col("_head"), fixed.PARAMETER_ALIASES).alias("_p"))
    rows = heads.select("locationid", "_t", "_v", "_p", F.explode("_lines").alias("_line"))
    rows = rows.filter(~is_head(F.col("_line"))).withColumn("_cells", cells(F.col("_line")))

    def cell(i):
        return F.when(F.col(i).isNotNull(), F.nullif(
            F.get("_cells", (F.col(i) - 1).cast("int")), F.lit("")))

    rows = rows.select(F.col("locationid").alias("location_id"),
                       cell("_t").alias("timestamp"), cell("_v").alias("pm25"),
                       cell("_p").alias("parameter"),
                       F.col("_p").isNotNull().alias("has_parameter"))
    day = F.to_date(F.try_to_timestamp("timestamp"))
    if start:
        rows = rows.filter(day.isNull() | (day >= F.lit(start).cast("date")))
    if end:
        rows = rows.filter(day.isNull() | (day <= F.lit(end).cast("date")))
    return rows


def read_articles(spark: SparkSession, path, multiline=False, broken="fail") -> DataFrame:
    """Article lists → (timestamp, text); unreadable publication times are skipped."""
    docs = _documents(spark, path, schemas.ARTICLES, multiline, broken)
    rows = docs.select(F.explode("articles").alias("a"))
    return rows.select(
        F.try_to_timestamp("a.publishedAt").alias("timestamp"),
        F.concat_ws(" ", "a.title", "a.description").alias("text")).dropna(subset=["timestamp"])


def _is_list(spark, path) -> bool:
    """True if the file holds one JSON array, perhaps over many lines."""
    first = spark.read.text(path).filter(F.trim("value") != "").first()
    return first is not None and first["value"].lstrip().startswith("[")


def read_registry(spark: SparkSession, *paths, broken="fail") -> DataFrame:
    """Station registry from the first of ``paths`` that exists: one document per line, or
    one array of documents."""
    missing = None
    for path in paths:
        try:
            return _documents(spark, path, schemas.REGISTRY, _is_list(spark, path), broken)
        except AnalysisException as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            missing = e
    raise missing or ValueError("no registry path given")


def read_dataset(spark: SparkSession, path) -> DataFrame:
    """Feature table ready for learning: absent features are 0, rows without a reading
    or any target are dropped."""
    df = ensure_columns(spark.read.parquet(path), dict.fromkeys(fixed.FEATURES, 0.0))
    df = ensure_columns(df, dict.fromkeys(fixed.TARGETS, None))
    return df.dropna(subset=fixed.TARGETS + ["pm25"])


def read_live(spark: SparkSession, path, since=None) -> DataFrame:
    """Feature table ready for scoring: no targets are asked for, absent features are 0, and rows
    without a reading are dropped. ``since`` (a day) leaves older days of a table by day unread."""
    df = spark.read.parquet(path)
    if since is not None:
        day = F.lit(since).cast("date")
        df = df.filter(F.col("date") >= day if "date" in df.columns else F.to_date("timestamp") >= day)
    df = ensure_columns(df, dict.fromkeys(fixed.FEATURES, 0.0))
    return df.drop(*fixed.TARGETS).dropna(subset=["pm25"])


def stream_readings(spark: SparkSession, path, schema=schemas.READINGS, fmt="parquet",
                    files_per_trigger=None) -> DataFrame:
    """Files arriving in a folder, as a stream."""
    reader = spark.readStream.schema(schema).format(fmt)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.load(path)
