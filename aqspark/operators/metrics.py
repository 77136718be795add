"""Forecast errors over rows (station, timestamp, horizon, y_true, y_pred)."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aqspark.functions import fixed
from aqspark.functions.scalars import horizon_weights


def horizon_metrics(pairs: DataFrame, round_digits=False) -> DataFrame:
    """MAE, RMSE and R² per horizon, in the units of the values."""
    known = pairs.filter(F.col("y_true").isNotNull() & F.col("y_pred").isNotNull())
    error = F.col("y_true") - F.col("y_pred")
    sums = known.groupBy("horizon").agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.abs(error)).alias("mae"),
        F.avg(error * error).alias("mse"), F.var_pop("y_true").alias("spread"))
    r2 = F.when(F.col("spread") > 0, 1 - F.col("mse") / F.col("spread")).otherwise(
        F.when(F.col("mse") == 0, 1.0).otherwise(0.0))
    out = sums.select("horizon", "n", "mae", F.sqrt("mse").alias("rmse"), r2.alias("r2"))
    if round_digits:
        out = out.withColumns({"mae": F.bround("mae", 3), "rmse": F.bround("rmse", 3),
                               "r2": F.bround("r2", 4)})
    return out


def weighted_huber(pairs: DataFrame, delta=15.0, weights=None) -> DataFrame:
    """Mean weighted Huber loss over all rows and horizons, as one row ``loss``.

    Defaults are one of the two variants in use; the other is ``delta=1`` with
    ``horizon_weights("power", 0.95)``.
    """
    weights = weights or horizon_weights("exp", 0.04)
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), F.col("horizon").cast("int"))
    size = F.abs(F.col("y_true") - F.col("y_pred"))
    loss = F.when(size < delta, size * size / 2).otherwise(delta * (size - delta / 2))
    return pairs.filter(size.isNotNull()).agg(F.avg(weight * loss).alias("loss"))


def long_pairs(df: DataFrame, y_pred="y_pred", y_true="y_true",
               keys=("station", "timestamp")) -> DataFrame:
    """Arrays per row → one row per horizon."""
    steps = F.arrays_zip(F.col(y_true).alias("t"), F.col(y_pred).alias("p"))
    zipped = F.transform(steps, lambda s: F.struct(s["t"].alias("y_true"), s["p"].alias("y_pred")))
    return df.select(*keys, F.posexplode(zipped).alias("_h", "_s")).select(
        *keys, (F.col("_h") + 1).alias("horizon"),
        F.col("_s.y_true").cast("double").alias("y_true"),
        F.col("_s.y_pred").cast("double").alias("y_pred"))


def target_pairs(df: DataFrame, prediction, keys=("station", "timestamp"),
                 horizons=fixed.HORIZONS) -> DataFrame:
    """Wide targets and a prediction per horizon → long pairs.

    ``prediction(h)`` gives the column that forecasts horizon h.
    """
    steps = F.array(*[F.struct(F.lit(h).alias("horizon"),
                               F.col(f"target_{h}h").cast("double").alias("y_true"),
                               prediction(h).cast("double").alias("y_pred"))
                      for h in range(1, horizons + 1)])
    return df.select(*keys, F.inline(steps))
