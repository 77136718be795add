"""Quantile sketches kept by day, so that scales are fitted again from the new days alone.

A folder holds one mergeable sketch per day and column. ``refresh`` brings it up to date with a dataset by day and
reads only days whose number of rows has changed. ``rough_scales`` merges the sketches and reads no row of the
dataset; ``stored_scales`` takes brackets from them and finds the exact quantiles in one pass over the rows. Sketches
are wrong with a small probability, and stale ones may be; quantiles that turn out to lie outside their bracket are
computed again without it, so the exact scales never depend on the sketches.

Unknown values (null, NaN) do not count. A column without a known value has no scale.
"""

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aqspark.operators.scaling import CUTS, center_scale, exact_quantiles, quantiles_within
from aqspark.storage import materialise

SIZE = 4096              # a sketch quantile is off by more than 0.0007 of the rows in one case of a hundred
MARGIN = 0.002
PROBS = (0.25, 0.5, 0.75)
SCHEMA = "rows bigint, feature string, n bigint, sketch binary, date date"


def _known(name):
    value = F.col(name).cast("double")
    return F.when(~F.isnan(value), value)


def day_sketches(rows: DataFrame, cols, size=SIZE) -> DataFrame:
    """(date, rows, feature, n, sketch) of a dataset with a ``date``: rows of the day, known values, their sketch."""
    cols = list(cols)
    known = rows.select("date", *[_known(c).alias(f"v{i}") for i, c in enumerate(cols)])
    daily = known.groupBy("date").agg(
        F.count(F.lit(1)).alias("rows"),
        *[F.count(f"v{i}").alias(f"n{i}") for i in range(len(cols))],
        *[F.kll_sketch_agg_double(f"v{i}", F.lit(size)).alias(f"s{i}") for i in range(len(cols))])
    found = F.explode(F.array(*[
        F.struct(F.lit(c).alias("feature"), F.col(f"n{i}").alias("n"), F.col(f"s{i}").alias("sketch"))
        for i, c in enumerate(cols)]))
    return daily.select("date", "rows", found.alias("found")).select("date", "rows", "found.*")


def read_sketches(spark, path) -> DataFrame:
    """The stored sketches; none if nothing has been stored."""
    try:
        return spark.read.schema(SCHEMA).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], SCHEMA)


def due_days(rows: DataFrame, sketches: DataFrame, cols) -> list:
    """Days whose stored sketches are missing, lack a column, or belong to another number of rows.

    A day that the dataset no longer has is due as well. Counting reads no columns but those the dataset is
    filtered by. The calendar bounds the days.
    """
    wanted = sketches.filter(F.col("feature").isin(list(cols)))
    stored = wanted.groupBy("date").agg(
        F.min("rows").alias("then"), F.max("rows").alias("most"), F.countDistinct("feature").alias("features"))
    now = rows.groupBy("date").agg(F.count(F.lit(1)).alias("now"))
    rows_now = F.coalesce("now", F.lit(0))
    same = ((F.col("then") == rows_now) & (F.col("most") == rows_now)
            & (F.col("features") == len(set(cols))))
    due = now.join(stored, "date", "full").filter(F.col("date").isNotNull() & ~F.coalesce(same, F.lit(False)))
    return sorted(r["date"] for r in due.select("date").collect())


def refresh(rows: DataFrame, path, cols, size=SIZE) -> list:
    """Store sketches of the days that are due and return these days; others keep their files.

    A day is replaced as a whole, so a run that broke off is completed by the next one. A day that is gone
    keeps an empty sketch.
    """
    spark = rows.sparkSession
    days = due_days(rows, read_sketches(spark, path), cols)
    if not days:
        return days
    found = day_sketches(rows.filter(F.col("date").isin(days)), cols, size)
    gone = spark.createDataFrame([(d,) for d in days], "date date").join(
        found.select("date").distinct(), "date", "left_anti")
    empty = gone.select("date", F.lit(0).cast("bigint").alias("rows"), F.explode(
        F.array(*[F.lit(c) for c in cols])).alias("feature"), F.lit(0).cast("bigint").alias("n"),
        F.lit(None).cast("binary").alias("sketch"))
    (found.unionByName(empty).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("date").parquet(path))
    return days


def merged(sketches: DataFrame, cols) -> DataFrame:
    """(feature, n, sketch) over all days."""
    return sketches.filter(F.col("feature").isin(list(cols)) & (F.col("n") > 0)).groupBy("feature").agg(
        F.sum("n").alias("n"), F.kll_merge_agg_double("sketch").alias("sketch"))


def _quantile(p):
    return F.kll_sketch_get_quantile_double("sketch", F.lit(float(p)))


def rough_scales(sketches: DataFrame, cols) -> DataFrame:
    """(feature, center, scale) within the error of the sketches; the dataset is not read."""
    marks = F.explode(F.array(*[F.struct(F.lit(p).alias("p"), _quantile(p).alias("quantile")) for p in PROBS]))
    found = materialise(merged(sketches, cols))
    return center_scale(found.select("feature", marks.alias("mark")).select("feature", "mark.*"))


def brackets(sketches: DataFrame, cols, probs=PROBS) -> DataFrame:
    """(feature, _n, _marks, _cuts) as ``quantiles_within`` takes them."""
    def ranks(p, steps):
        low, high = max(0.0, p - MARGIN), min(1.0, p + MARGIN)
        return [low + (high - low) * step / (CUTS + 1) for step in steps]

    return materialise(merged(sketches, cols)).select(
        "feature", F.col("n").alias("_n"),
        F.array(*[_quantile(r) for p in probs for r in ranks(p, (0, CUTS + 1))]).alias("_marks"),
        F.array(*[F.array(*[_quantile(r) for r in ranks(p, range(1, CUTS + 1))]) for p in probs]).alias("_cuts"))


def stored_scales(rows: DataFrame, sketches: DataFrame, cols) -> DataFrame:
    """(feature, center, scale), exact: one pass over ``rows``, whose days the sketches bracket."""
    long = rows.select(*[_known(c).alias(c) for c in cols]).unpivot([], list(cols), "feature", "value").filter(
        F.col("value").isNotNull())
    found = materialise(quantiles_within(long, materialise(brackets(sketches, cols)), PROBS))
    # one row per column
    sure = {r["feature"] for r in found.groupBy("feature").agg(
        F.min("sure").alias("sure"), F.count(F.lit(1)).alias("n")).collect() if r["sure"] and r["n"] == len(PROBS)}
    quantiles = found.filter(F.col("feature").isin(list(sure))).drop("sure")
    unsure = [c for c in cols if c not in sure]
    if unsure:
        quantiles = quantiles.unionByName(exact_quantiles(long.filter(F.col("feature").isin(unsure)), PROBS))
    return center_scale(quantiles)
