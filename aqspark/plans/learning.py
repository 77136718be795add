"""Learning set, its examples, and reference forecasts."""

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aqspark.functions import fixed
from aqspark.operators import ranks, scaling
from aqspark.operators.aggregate import null_audit
from aqspark.operators.blocks import sequence_blocks
from aqspark.operators.joins import join_station_ids
from aqspark.operators.metrics import target_pairs
from aqspark.operators.segments import over_segments
from aqspark.operators.windows import fill_forward_back, sequences
from aqspark.storage import materialise


@dataclass
class LearningSet:
    rows: DataFrame          # features scaled, station_id and split added
    ids: DataFrame
    scaler: DataFrame        # (feature, center, scale), targets pooled as "target"


def null_columns(df: DataFrame, cols) -> list[str]:
    """Columns with any null: one pass, one row back."""
    counts = null_audit(df.select(*cols)).filter("nulls > 0").collect()
    return [r["field"] for r in counts]


def prepare(dataset: DataFrame, features=fixed.FEATURES, targets=fixed.TARGETS,
            base=1) -> LearningSet:
    """Split, ids and scales; scales are fitted on the training rows only.

    Unknown values are filled inside a station's split, so no split learns from a later one.
    A feature that no training row knows keeps its unit: center 0, scale 1.
    """
    split = materialise(ranks.chrono_split(dataset))
    train = split.filter(F.col("split") == "train")
    scaler = materialise(scaling.fit_robust(train, features).unionByName(
        scaling.fit_robust_pooled(train, targets)))
    known = scaling.params_on_driver(scaler)
    params = {c: known.get(c, (0.0, 1.0)) for c in [*features, "target"]}
    missing = [(c, *params[c]) for c in params if c not in known]
    if missing:
        scaler = scaler.unionByName(dataset.sparkSession.createDataFrame(missing, scaler.schema))
    # stored, their size is known: where they are few, the wide rows meet them without a shuffle
    ids = materialise(ranks.station_ids(split, base))
    unknown = null_columns(split, features)
    filled = split
    if unknown:
        part = F.concat_ws("|", "split", "station")
        filled = fill_forward_back(split.withColumn("_split_key", part), unknown, key="_split_key").drop("_split_key")
    scaled = scaling.robust_scale(filled, {c: params[c] for c in features})
    center, scale = params["target"]
    scaled = scaled.withColumns({
        t: (F.col(t).cast("double") - F.lit(center)) / F.lit(scale) for t in targets})
    # training, validation and test rows are each read many times
    return LearningSet(materialise(join_station_ids(scaled, ids)), ids, scaler)


def learning_sequences(rows: DataFrame, features=fixed.FEATURES, max_rows=0, gap=1,
                       seed=42) -> DataFrame:
    """Examples as arrays. ``max_rows`` spreads a cap over the stations; 0 means all.

    Where rows have a ``split``, no example reaches from one into another. The cap picks
    narrow (station, time) rows first, so examples that are not wanted
    are never built into arrays.
    """
    if "split" in rows.columns:
        own = rows.withColumn("station", F.concat_ws("|", "split", "station")).drop("split")
        out = learning_sequences(own, features, max_rows, gap, seed)
        return out.withColumn("split", F.expr("left(station, instr(station, '|') - 1)")).withColumn(
            "station", F.expr("substr(station, instr(station, '|') + 1)"))
    keep = None
    if max_rows:
        spots = sequences(rows.select("station", "timestamp"), [], [], gap=gap)
        cap = ranks.cap_for_total(spots, max_rows)
        chosen = ranks.cap_per_key(spots, cap, seed).select(
            "station", "timestamp", F.lit(True).alias("_keep"))
        rows = rows.join(chosen, ["station", "timestamp"], "left").withColumn(
            "_keep", F.coalesce("_keep", F.lit(False)))
        keep = "_keep"
    return sequences(rows, features, gap=gap, keep=keep)


def learning_blocks(rows: DataFrame, features=fixed.FEATURES, kind="float") -> DataFrame:
    """All examples as blocks, in which each row is stored once. Where rows have a ``split``, no example
    reaches from one into another."""
    if "split" not in rows.columns:
        return sequence_blocks(rows, features, kind=kind)
    own = rows.withColumn("_part", F.struct("split", "station"))
    blocks = sequence_blocks(own, features, key="_part", kind=kind)
    return blocks.select("_part.station", "_part.split", *[c for c in blocks.columns if c != "_part"])


# --- forecasters -------------------------------------------------------------------------

def naive(df: DataFrame, kind="persistence") -> DataFrame:
    """Long pairs for two reference forecasts over (station, timestamp, pm25).

    ``persistence`` repeats the current reading, ``yesterday`` the one 24 rows before
    the hour that is forecast.
    """
    def columns(w):
        out = [F.lead("pm25", h).over(w).alias(f"target_{h}h")
               for h in range(1, fixed.HORIZONS + 1)]
        if kind == "yesterday":
            out += [F.lag("pm25", 24 - h).over(w).alias(f"_y{h}")
                    for h in range(1, fixed.HORIZONS + 1)]
        return out

    wide = over_segments(df.select("station", "timestamp", "pm25"), columns,
                         before=24, after=fixed.HORIZONS)
    pick = (lambda h: F.col(f"_y{h}")) if kind == "yesterday" else (lambda h: F.col("pm25"))
    return target_pairs(wide, pick)
