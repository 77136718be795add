"""Helpers shared by the operators: column names, batches of text, tables read twice."""

import ctypes
import gc
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aqspark.storage import new_path

# bytes of text that one numpy step works on; a longer text makes a step of its own
STEP_BYTES = 1 << 20


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names like the given ones that no column of ``df`` has."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def held_out(doc_id: Column) -> Column:
    """The rows no model learns from: crc32 of the id as text, modulo 4, is 2.

    A null id is not held out, and nothing is learned from it either.
    """
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def written(df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
    """Write a table to the shared folder and read it back, so that what follows does not
    compute it again and a lost executor costs no more than a re-read."""
    path = new_path(df.sparkSession, name)
    writer = df.write.partitionBy(*partition_by) if partition_by else df.write
    writer.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


# bytes of one Arrow batch: a Python worker holds it as Arrow, as strings and as numbers at once
BATCH = "8m"


def map_arrow(df: DataFrame, run, schema: str, trim: bool = False) -> DataFrame:
    """``mapInArrow`` in small batches, so that the memory of the workers stays bounded by them.

    With ``trim`` a worker gives back what it no longer needs when its task ends: workers live on between
    stages, beside a JVM that needs the room.
    """
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH)

    def trimmed(batches):
        try:
            yield from run(batches)
        finally:
            give_back()
    return df.mapInArrow(trimmed if trim else run, schema)


def give_back() -> None:
    """Return freed memory of this process to the system, where its C library can."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def text_steps(batch: pa.RecordBatch, column: str, step_bytes: int = STEP_BYTES
               ) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Slices of a batch that hold about ``step_bytes`` of text, with the texts (null: empty)."""
    texts = batch.column(batch.schema.get_field_index(column))
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    start, total = 0, 0
    for row, size in enumerate(sizes.tolist()):
        if row > start and total + size > step_bytes:
            yield batch.slice(start, row - start), [t or "" for t in texts.slice(start, row - start).to_pylist()]
            start, total = row, 0
        total += size
    if start < batch.num_rows:
        yield batch.slice(start), [t or "" for t in texts.slice(start).to_pylist()]
    pa.default_memory_pool().release_unused()
