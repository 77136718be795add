"""Linear forecasters of all horizons, fitted from sums that one pass over the rows yields.

Least squares needs one pass: all horizons share the matrix of products of features, and each adds its
products with the features. The robust fit (Huber's loss, with the scale of the errors estimated beside the
coefficients) weighs rows anew in each pass, by the errors of every horizon, so a pass costs one matrix per horizon and
the number of passes is that of the reweightings, whatever the number of horizons. Tasks send only
sums; these are added in groups before the driver sees them, and never depend on the number of rows.
"""

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from aqspark.functions import fixed
from aqspark.storage import materialise

# errors up to so many scales count squared, beyond linearly: 95 % as efficient as least squares on normal errors
EPSILON = 1.35
# sums are added up in so many groups per horizon
GROUPS = 16
# horizon number of what all horizons share
SHARED = -1


@dataclass
class LinearModel:
    """``intercept + coefficients · features``; ``scale`` is that of its errors."""
    coefficients: np.ndarray
    intercept: float
    scale: float


def _added(table: DataFrame, run) -> dict[int, np.ndarray]:
    """Sums by horizon of the arrays that ``run`` makes of each task's batches."""
    def parts(batches):
        group = TaskContext.get().partitionId() % GROUPS
        sums = run(batches)
        yield pa.record_batch([pa.array(list(sums), pa.int32()), pa.array([group] * len(sums), pa.int32()),
                               pa.array([v.tolist() for v in sums.values()], pa.list_(pa.float64()))], ["horizon", "part", "sums"])

    def merged(group: pa.Table) -> pa.Table:
        total = group["sums"].combine_chunks().flatten().to_numpy().reshape(group.num_rows, -1).sum(axis=0)
        return pa.table({"horizon": group["horizon"].slice(0, 1), "sums": pa.array([total.tolist()], pa.list_(pa.float64()))})

    rows = table.mapInArrow(parts, "horizon int, part int, sums array<double>")
    out: dict[int, np.ndarray] = {}
    for horizon, sums in rows.groupBy("horizon", "part").applyInArrow(merged, "horizon int, sums array<double>").collect():
        out[horizon] = out.get(horizon, 0) + np.array(sums)
    return out


def _matrices(batch: pa.RecordBatch, n_features: int) -> tuple[np.ndarray, np.ndarray]:
    """Features behind a column of ones, and targets."""
    values = np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.columns])
    return np.column_stack([np.ones(len(values)), values[:, :n_features]]), values[:, n_features:]


def plain_sums(table: DataFrame, n_features: int, n_targets: int) -> dict[int, np.ndarray]:
    """Products of features, and by horizon products with the target, its sum of squares."""
    def run(batches):
        size = n_features + 1
        shared, own = np.zeros((size, size)), np.zeros((n_targets, size + 1))
        for batch in batches:
            z, y = _matrices(batch, n_features)
            shared += z.T @ z
            own[:, :size] += y.T @ z
            own[:, size] += (y * y).sum(axis=0)
        return {SHARED: shared.ravel()} | dict(enumerate(own))
    return _added(table, run)


def weighted_sums(table: DataFrame, n_features: int, theta: np.ndarray, scale: np.ndarray, epsilon=EPSILON) -> dict[int, np.ndarray]:
    """By horizon: weighted products of features, with the target, squares of the errors within bounds, and the number beyond."""
    def run(batches):
        size, n_targets = n_features + 1, len(theta)
        out = np.zeros((n_targets, size * size + size + 2))
        for batch in batches:
            z, y = _matrices(batch, n_features)
            error = np.abs(y - z @ theta.T)
            inside = error <= epsilon * scale
            weight = np.where(inside, 1.0, epsilon * scale / np.where(inside, 1.0, error))
            for h in range(n_targets):
                weighed = z * weight[:, h, None]
                out[h, :size * size] += (z.T @ weighed).ravel()
                out[h, size * size:-2] += weighed.T @ y[:, h]
            out[:, -2] += np.where(inside, error * error, 0.0).sum(axis=0)
            out[:, -1] += (~inside).sum(axis=0)
        return dict(enumerate(out))
    return _added(table, run)


def _solved(products, with_target, spread, penalty):
    """Coefficients of standardized features, turned back; features without spread get none."""
    used = np.r_[True, spread > 0]
    unit = np.r_[1.0, spread][used]
    a = products[np.ix_(used, used)] / np.outer(unit, unit) + np.diag(np.r_[0.0, np.full(used.sum() - 1, penalty)])
    out = np.zeros(len(used))
    out[used] = np.linalg.lstsq(a, with_target[used] / unit, rcond=1e-12)[0] / unit
    return out


def fit_linear(rows: DataFrame, horizons=range(1, fixed.HORIZONS + 1), features=fixed.FEATURES, max_iter=50, loss="huber",
               ridge=0.01, tolerance=1e-6, epsilon=EPSILON, stored=False) -> dict[int, LinearModel]:
    """One linear model per horizon, on rows without nulls: robust, or by least squares with ``loss="squaredError"``.

    Minimized is the mean loss, halved, plus half of ``ridge`` times the squares of the coefficients of standardized features. One
    job fits all by least squares; the robust fit takes one more for each reweighting, up to ``max_iter`` or until nothing
    moves by more than ``tolerance``. Every pass reads the rows, so they are written first, unless they are ``stored`` already.
    """
    horizons, features = list(horizons), list(features)
    targets = [f"target_{h}h" for h in horizons]
    # one test over an array: the optimizer would multiply out the tests of computed columns
    known = rows.select(F.array(*[F.col(c).cast("double") for c in [*features, *targets]]).alias("v")).filter(
        ~F.exists("v", lambda v: v.isNull() | F.isnan(v)))
    table = known.select(*[F.col("v")[i].alias(f"c{i}") for i in range(len(features) + len(targets))])
    table = table if stored else materialise(table)

    size = len(features) + 1
    sums = plain_sums(table, len(features), len(targets))
    products = sums[SHARED].reshape(size, size) if SHARED in sums else np.zeros((size, size))
    n = products[0, 0]
    if n < 2:
        raise ValueError("too few complete rows to fit on")
    mean = products[0, 1:] / n
    # the sample's spread, with n - 1; what rounding leaves of a constant is none
    spread = np.sqrt(np.maximum(np.diag(products)[1:] - n * mean ** 2, 0) / (n - 1))
    spread[spread < 1e-9 * np.maximum(1.0, np.abs(mean))] = 0.0
    theta = np.array([_solved(products / n, sums[h][:size] / n, spread, ridge) for h in range(len(targets))])
    squares = np.array([sums[h][size] - 2 * t @ sums[h][:size] + t @ products @ t for h, t in enumerate(theta)])
    scale = np.sqrt(np.maximum(squares / n, 1e-12))
    if loss == "huber":
        unit = np.r_[1.0, spread]
        for _ in range(max_iter):
            sums = weighted_sums(table, len(features), theta, scale, epsilon)
            moved = np.array([_solved(s[:size * size].reshape(size, size) / (n * scale[h]), s[size * size:-2] / (n * scale[h]), spread, ridge)
                              for h, s in sorted(sums.items())])
            inside, beyond = (np.array([sums[h][i] for h in range(len(targets))]) for i in (-2, -1))
            wider = np.sqrt(np.maximum(inside / np.maximum(n - beyond * epsilon ** 2, 1.0), 1e-12))
            step = max(np.abs((moved - theta) * unit).max() / max(1.0, np.abs(theta * unit).max()), np.abs(wider / scale - 1).max())
            theta, scale = moved, wider
            if step < tolerance:
                break
    elif loss != "squaredError":
        raise ValueError(f"loss is huber or squaredError, not {loss}")
    return {h: LinearModel(t[1:], float(t[0]), float(s)) for h, t, s in zip(horizons, theta, scale, strict=True)}


def predict_linear(models: dict[int, LinearModel], rows: DataFrame, features=fixed.FEATURES, keep=()) -> DataFrame:
    """Long pairs: all horizons are computed in one pass over the rows, as compiled sums. Columns to ``keep`` go with them."""
    def value(h):
        model = models[h]
        out = F.lit(float(model.intercept))
        for name, weight in zip(features, model.coefficients, strict=True):
            # features without influence cost nothing
            if weight != 0:
                out = out + F.col(name).cast("double") * F.lit(float(weight))
        return out

    steps = F.array(*[F.struct(F.lit(h).alias("horizon"),
                               F.col(f"target_{h}h").cast("double").alias("y_true"),
                               F.col(f"_forecast_{h}").alias("y_pred")) for h in sorted(models)])
    named = rows.select("*", *[value(h).alias(f"_forecast_{h}") for h in sorted(models)])
    return named.select("station", "timestamp", *keep, F.inline(steps))


# --- kept models -----------------------------------------------------------------------------

WEIGHTS = "horizon int, feature string, weight double"
INTERCEPT, SCALE = "(intercept)", "(scale)"


def write_linear(spark: SparkSession, models: dict[int, LinearModel], path: str, features=fixed.FEATURES) -> None:
    """One row per horizon and feature, like the other parameters of a learning set."""
    rows = [(h, name, float(w)) for h, m in models.items() for name, w in zip(
        [*features, INTERCEPT, SCALE], [*m.coefficients, m.intercept, m.scale], strict=True)]
    spark.createDataFrame(rows, WEIGHTS).coalesce(1).write.mode("overwrite").parquet(path)


def read_linear(spark: SparkSession, path: str, features=fixed.FEATURES) -> dict[int, LinearModel]:
    """The models for features in the given order; a feature they do not know has no influence."""
    weights: dict[int, dict[str, float]] = {}
    for horizon, feature, weight in spark.read.schema(WEIGHTS).parquet(path).collect():
        weights.setdefault(horizon, {})[feature] = weight
    return {h: LinearModel(np.array([w.get(f, 0.0) for f in features]), w[INTERCEPT], w[SCALE]) for h, w in sorted(weights.items())}


def linear_predictor(models: dict[int, LinearModel]):
    """The models as a predictor for scoring: every horizon from a window's newest row. Horizons without a model
    take that of the nearest shorter one, or the shortest there is."""
    have = sorted(models)
    chosen = [models[max((k for k in have if k <= h), default=have[0])] for h in range(1, fixed.HORIZONS + 1)]
    matrix, start = np.array([m.coefficients for m in chosen]).T, np.array([m.intercept for m in chosen])

    def load():
        return lambda x, ids: x[:, -1, :].astype(np.float64) @ matrix + start
    return load
