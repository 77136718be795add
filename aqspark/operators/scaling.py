"""Robust scaling with exact quantiles that no single task has to hold."""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from aqspark.functions import fixed
from aqspark.functions.scalars import scaled, unscaled
from aqspark.storage import materialise

SKETCH = 10_000          # a sketch quantile is off by at most 1 / SKETCH of the rows
MARGIN = 3 / SKETCH
SLOTS = 1024             # a bracket's values are counted in so many slots before any are ranked
CUTS = 15                # values that divide a bracket into parts of about equal count, where they are known


def exact_quantiles(long: DataFrame, probs, key="feature", value="value") -> DataFrame:
    """Linearly interpolated quantiles of ``value`` per ``key`` (few keys, any rows).

    A mergeable sketch brackets each quantile. A second pass counts what lies below
    the brackets and keeps counts per distinct value only inside them. Counts per slot of a bracket
    then tell which slots hold the quantile, and only their values are ranked in one task: about a
    millionth of the rows.
    """
    long = long.filter(F.col(value).isNotNull()).withColumn(value, F.col(value).cast("double"))
    return quantiles_within(long, _brackets(long, probs, key, value), probs, key, value).drop("sure")


def column_quantiles(df: DataFrame, names, probs) -> DataFrame:
    """``exact_quantiles`` of the columns of ``df`` (doubles), whose features ``names`` tells in order; columns of one feature are pooled."""
    long = _long(df, names).filter(F.col("value").isNotNull())
    bounds = materialise(_brackets(long, probs, "feature", "value"))
    return _ranked(column_zones(df, names, bounds), bounds, probs, "feature").drop("sure")


def _long(df, names):
    """(feature, value): one row for each column of a row."""
    names = list(names)
    if len(set(names)) == len(names):
        return df.toDF(*names).unpivot([], names, "feature", "value")
    values = df.select(F.posexplode(F.array(*df.columns)).alias("_at", "value"))
    return values.select(F.element_at(F.array(*[F.lit(n) for n in names]), F.col("_at") + 1).alias("feature"), "value")


def _brackets(long, probs, key, value):
    """Per key the number of values and the brackets of the quantiles, from a sketch."""
    marks = [m for p in probs for m in (max(0.0, p - MARGIN), min(1.0, p + MARGIN))]
    return long.groupBy(key).agg(
        F.count(F.lit(1)).alias("_n"),
        F.percentile_approx(value, marks, SKETCH).alias("_marks"))


ZONES = "feature string, _sides array<int>, _v double, _c bigint, _min double, _max double"


def column_zones(df: DataFrame, names, bounds: DataFrame) -> DataFrame:
    """What ``quantiles_within`` counts per feature, zone and value inside a bracket, from columns.

    Values outside of all brackets, which is most of them, never become rows: every batch of rows is sorted by column, and the
    brackets cut it into zones.
    """
    # one row per feature
    marks = {r["feature"]: np.array(r["_marks"]) for r in bounds.collect()}

    def zones(values, marks):
        """(sides, value or None, count, least, greatest); like Spark's order, numpy's puts NaN last."""
        values = np.sort(values)
        low, high = values.searchsorted(marks[::2], "left"), values.searchsorted(marks[1::2], "right")
        cuts = sorted({0, len(values), *low.tolist(), *high.tolist()})
        for begin, end in zip(cuts, cuts[1:]):  # noqa: B905
            sides = np.where(begin < low, -1, np.where(begin >= high, 1, 0)).tolist()
            if 0 in sides:
                for v, n in zip(*(a.tolist() for a in np.unique(values[begin:end], return_counts=True)), strict=True):
                    yield sides, v, n, v, v
            else:
                yield sides, None, end - begin, values[begin].item(), values[end - 1].item()

    def run(batches):
        for batch in batches:
            rows = [(name, *zone) for name, column in zip(names, batch.columns, strict=True) if name in marks
                    for zone in zones(column.drop_null().to_numpy(zero_copy_only=False), marks[name])]
            if rows:
                kinds = [pa.string(), pa.list_(pa.int32()), pa.float64(), pa.int64(), pa.float64(), pa.float64()]
                yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)],
                                      ["feature", "_sides", "_v", "_c", "_min", "_max"])

    counts = df.mapInArrow(run, ZONES).groupBy("feature", "_sides", "_v").agg(
        F.sum("_c").alias("_c"), F.min("_min").alias("_min"), F.max("_max").alias("_max"))
    return counts.join(F.broadcast(bounds.select("feature", "_n", "_marks")), "feature")


def quantiles_within(long: DataFrame, bounds: DataFrame, probs, key="feature", value="value") -> DataFrame:
    """(key, p, quantile, sure) in one pass over the values, given brackets of the quantiles.

    ``bounds`` holds per key the number of values ``_n`` and the brackets ``_marks`` (low and high per quantile); where it
    has ``_cuts`` (values that divide each bracket into parts of about equal count), slots follow them. A quantile is
    ``sure`` if its rank lies in its bracket or next to it and ``_n`` is right; otherwise it may be wrong.
    """
    # one row per key, and keys are columns of a table: always small
    placed = long.join(F.broadcast(bounds.select(key, "_n", "_marks")), key)
    # per quantile: below (-1), inside (0) or above (1) its bracket
    sides = F.array(*[
        F.when(F.col(value) < F.col("_marks")[2 * i], -1)
        .when(F.col(value) > F.col("_marks")[2 * i + 1], 1).otherwise(0)
        for i in range(len(probs))])
    inside = F.when(F.array_contains("_sides", 0), F.col(value))
    zones = (placed.select(key, "_n", "_marks", value, sides.alias("_sides"))
             .groupBy(key, "_n", "_marks", "_sides", inside.alias("_v"))
             .agg(F.count(F.lit(1)).alias("_c"), F.min(value).alias("_min"),
                  F.max(value).alias("_max")))
    return _ranked(zones, bounds, probs, key)


def _ranked(zones: DataFrame, bounds: DataFrame, probs, key) -> DataFrame:
    """The quantiles from the counts per zone and value. These are few, and read twice."""
    zones = materialise(zones)
    each = zones.select(key, "_n", "_v", "_c", "_min", "_max", "_marks",
                        F.posexplode("_sides").alias("_i", "side"))
    # a bracket is cut into slots; what lies outside is one slot on each side
    low, high = F.col("_marks")[2 * F.col("_i")], F.col("_marks")[2 * F.col("_i") + 1]
    if "_cuts" in bounds.columns:
        each = each.join(F.broadcast(bounds.select(key, "_cuts")), key)
        inner = _slot_by_cuts(F.col("_v"), low, F.col("_cuts")[F.col("_i")], high)
    else:
        inner = _slot_by_width(F.col("_v"), low, high, SLOTS)
    slot = F.when(F.col("side") < 0, -1).when(F.col("side") > 0, SLOTS).otherwise(inner).cast("int")
    counted = (each.withColumn("_slot", slot)
               .groupBy(key, "_n", "_i", "_slot",
                        F.when(F.col("side") == 0, F.col("_v")).alias("_v"))
               .agg(F.sum("_c").alias("_c"), F.min("_min").alias("_min"),
                    F.max("_max").alias("_max"))
               .withColumn("_v", F.when(F.col("_slot") < 0, F.col("_max"))
                           .otherwise(F.col("_min")))
               .withColumn("p", F.array(*[F.lit(float(p)) for p in probs])[F.col("_i")])
               .withColumn("rank", F.col("p") * (F.col("_n") - 1)))
    # at most SLOTS + 2 rows per quantile tell which slots hold its two neighbours in rank
    upto = Window.partitionBy(key, "p", "rank").orderBy("_slot")
    slots = (counted.groupBy(key, "p", "rank", "_slot").agg(F.sum("_c").alias("_in"))
             .withColumn("_start", F.sum("_in").over(upto) - F.col("_in"))
             .withColumn("_all", F.sum("_in").over(Window.partitionBy(key, "p", "rank")))
             .filter((F.col("_start") <= F.ceil("rank"))
                     & (F.floor("rank") < F.col("_start") + F.col("_in"))))
    # only the values of these slots are ranked
    inside = (Window.partitionBy(key, "p", "rank", "_slot").orderBy("_v")
              .rowsBetween(Window.unboundedPreceding, 0))
    ranked = counted.join(F.broadcast(slots), [key, "p", "rank", "_slot"]).withColumn(
        "_cum", F.col("_start") + F.sum("_c").over(inside))

    def at(rank):
        return F.min(F.when(F.col("_cum") > rank, F.struct("_slot", "_v")))["_v"]

    # of what lies outside, only the value next to the bracket is known
    known = (F.when(F.col("_slot") < 0, F.floor("rank") >= F.col("_start") + F.col("_in") - 1)
             .when(F.col("_slot") == SLOTS, F.ceil("rank") <= F.col("_start")).otherwise(True))
    found = ranked.groupBy(key, "p", "rank").agg(
        at(F.floor("rank")).alias("_low"), at(F.ceil("rank")).alias("_high"),
        F.min(known & (F.col("_all") == F.col("_n"))).alias("sure"))
    share = F.col("rank") - F.floor("rank")
    return found.select(
        key, "p", (F.col("_low") + (F.col("_high") - F.col("_low")) * share).alias("quantile"), "sure")


def _slot_by_width(v, low, high, slots):
    place = F.when(high > low, (v - low) / (high - low)).otherwise(0.0)
    return F.least(F.floor(place * slots), F.lit(slots - 1))


def _slot_by_cuts(v, low, cuts, high):
    """Parts between the cuts, each of them cut into slots of equal width."""
    edges = F.concat(F.array(low), cuts, F.array(high))
    width = SLOTS // (CUTS + 1)
    part = F.least(F.size(F.filter(edges, lambda edge: edge <= v)), F.lit(CUTS + 1)) - 1
    return part * width + _slot_by_width(v, edges[part], edges[part + 1], width)


def center_scale(quantiles: DataFrame) -> DataFrame:
    def q(p):
        return F.max(F.when(F.col("p") == p, F.col("quantile")))
    spread = q(0.75) - q(0.25)
    return quantiles.groupBy("feature").agg(
        q(0.5).alias("center"),
        F.when(spread == 0, 1.0).otherwise(spread).alias("scale"))


def fit_robust(df: DataFrame, cols, approx=False) -> DataFrame:
    """Rows (feature, center, scale): median and interquartile range, 1 where that is 0."""
    return _quantile_params(df.select(*[F.col(c).cast("double").alias(c) for c in cols]), list(cols), approx)


def fit_robust_pooled(df: DataFrame, targets=fixed.TARGETS, name="target",
                      approx=False) -> DataFrame:
    """One median and range over all target columns together."""
    values = df.select(*[F.col(c).cast("double").alias(c) for c in targets])
    return _quantile_params(values, [name] * len(values.columns), approx)


def _quantile_params(values, names, approx):
    probs = [0.25, 0.5, 0.75]
    if not approx:
        return center_scale(column_quantiles(values, names, probs))
    long = _long(values, names)
    rough = long.filter(F.col("value").isNotNull()).groupBy("feature").agg(
        F.percentile_approx("value", probs, SKETCH).alias("q"))
    return center_scale(rough.select("feature", F.explode(F.array(*[
        F.struct(F.lit(p).alias("p"), F.col("q")[i].alias("quantile"))
        for i, p in enumerate(probs)])).alias("_q")).select("feature", "_q.*"))


def params_on_driver(params: DataFrame) -> dict[str, tuple[float, float]]:
    """One (center, scale) per table column, so never more rows than columns."""
    return {r["feature"]: (r["center"], r["scale"]) for r in params.collect()}


def robust_scale(df: DataFrame, params: dict[str, tuple[float, float]]) -> DataFrame:
    return df.withColumns({c: scaled(c, F.lit(m), F.lit(s))
                           for c, (m, s) in params.items() if c in df.columns})


def robust_unscale(df: DataFrame, params: dict[str, tuple[float, float]]) -> DataFrame:
    return df.withColumns({c: unscaled(c, F.lit(m), F.lit(s))
                           for c, (m, s) in params.items() if c in df.columns})
