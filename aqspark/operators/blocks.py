"""Learning examples stored as blocks: every row once, windows cut when read.

An example is 72 rows wide and its neighbour shares 71 of them, so examples written one by one repeat each row up to 72
times. A block holds consecutive rows of a station in one flat array, with those before it that its first windows
reach back to; an example is an offset into it. Blocks have a bounded number of rows, whatever a station has.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from aqspark.functions import fixed
from aqspark.operators.segments import over_segments, position

BLOCK_ROWS = 2048


def sequence_blocks(df: DataFrame, features, targets=fixed.TARGETS, lookback=fixed.LOOKBACK, horizons=fixed.HORIZONS,
                    key="station", ts="timestamp", block_rows=BLOCK_ROWS, kind="float") -> DataFrame:
    """(key, block, row, first, n, width, times, f, y): the examples of ``windows.sequences``, as blocks.

    ``row`` is the position of a block's first row in its station, ``f`` its rows of ``width`` features one after the other, and
    ``y`` likewise of the targets. The block has ``n`` examples; their target rows are ``first`` and those after it, counted in the block.
    """
    if block_rows < lookback:
        raise ValueError("a block has to hold a window")
    packed = df.select(key, ts, F.array(*[F.col(c).cast(kind) for c in features]).alias("_f"),
                       F.array(*[F.col(c).cast(kind) for c in targets]).alias("_y"))
    rows = over_segments(packed, lambda w: [position(w).alias("_pos"), F.col("_total").alias("_rows")], key=key, ts=ts)
    own = F.expr(f"_pos div {block_rows}")
    # the last rows of a block stand before the first of the next one, if there is one
    ahead = (F.col("_pos") % block_rows >= block_rows - lookback) & ((own + 1) * block_rows < F.col("_rows"))
    dealt = rows.withColumn("block", F.explode(F.when(ahead, F.array(own, own + 1)).otherwise(F.array(own))))
    blocks = dealt.groupBy(key, "block").agg(
        F.sort_array(F.collect_list(F.struct("_pos", F.col(ts).alias("_ts"), "_f", "_y"))).alias("_all"), F.first("_rows").alias("_rows"))
    start = F.col("_all")[0]["_pos"]
    first = F.greatest(F.col("block") * block_rows, F.lit(lookback))
    last = F.least((F.col("block") + 1) * block_rows - 1, F.col("_rows") - horizons)
    return blocks.select(
        key, "block", start.alias("row"), (first - start).cast("int").alias("first"), (last - first + 1).cast("int").alias("n"),
        F.lit(len(features)).alias("width"), F.col("_all._ts").alias("times"),
        F.flatten("_all._f").alias("f"), F.flatten("_all._y").alias("y")).filter("n > 0")


# of the blocks that a task holds in Python at a time
BATCH_BYTES = 64 << 20


def block_examples(blocks: DataFrame, lookback=fixed.LOOKBACK, gap=1, key="station", ts="timestamp", each=None) -> DataFrame:
    """(key, ts, y, row, x): every example of the blocks, cut out as it is read. With ``gap=0`` the target row is the last of the window.

    ``each`` is a function and the columns it makes (DDL): it gets all examples of a block as numpy views, ``x`` (examples, rows,
    features) and ``y`` (examples, targets), unknown values as NaN, and returns an array of its type for each column. The result is then
    (key, ts, row, columns), and no window is ever copied.
    """
    if each is not None:
        return _each_block(blocks, lookback, gap, key, ts, *each)
    at = blocks.select("*", F.explode(F.sequence(F.col("first"), F.col("first") + F.col("n") - 1)).alias("_at"))
    begin = F.col("_at") - lookback + (0 if gap else 1)
    heads = (F.size("y") / F.size("times")).cast("int")
    return at.select(
        key, F.get("times", F.col("_at")).alias(ts), F.slice("y", F.col("_at") * heads + 1, heads).alias("y"),
        (F.col("row") + F.col("_at")).alias("row"),
        F.transform(F.sequence(F.lit(0), F.lit(lookback - 1)),
                    lambda k: F.slice("f", (begin + k) * F.col("width") + 1, F.col("width"))).alias("x"))


def _each_block(blocks, lookback, gap, key, ts, function, columns):
    made = T.StructType.fromDDL(columns)
    schema = T.StructType([T.StructField(key, blocks.schema[key].dataType), T.StructField(ts, blocks.schema["times"].dataType.elementType),
                           T.StructField("row", T.LongType()), *made.fields])

    def run(batches):
        for batch in batches:
            for at, (row, first, n, width) in enumerate(zip(*(batch[c].to_pylist() for c in ("row", "first", "n", "width")), strict=True)):
                times, f, y = (batch[c][at].values for c in ("times", "f", "y"))
                f, y = (v.to_numpy(zero_copy_only=False).reshape(len(times), -1) for v in (f, y))
                windows = np.lib.stride_tricks.sliding_window_view(f, lookback, axis=0).transpose(0, 2, 1)
                begin = first - lookback + (0 if gap else 1)
                found = function(windows[begin:begin + n], y[first:first + n])
                yield pa.record_batch(
                    [batch[key].take(pa.array(np.full(n, at))), times.slice(first, n), pa.array(row + first + np.arange(n)),
                     *[pa.array(found[c]) for c in made.names]], [key, ts, "row", *made.names])

    # blocks are large rows
    blocks.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    return blocks.select(key, "row", "first", "n", "width", "times", "f", "y").mapInArrow(run, schema)
