"""Shared storage: where written tables and checkpoints go, how long they live, and session set-up."""

import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"

# folders written inside each open ``scratch`` block, innermost last
_OPEN: list[list[str]] = []


def configure(spark: SparkSession) -> SparkSession:
    """Settings every result relies on: one time zone, zoned timestamps, AQE."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.parquet.inferTimestampNTZ.enabled", "false")
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "true")
    # row windows cost far more time than bytes, so small partitions are worth a task
    spark.conf.set("spark.sql.adaptive.coalescePartitions.minPartitionSize", "64k")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """Folder that every executor reaches, as the cluster names it.

    Only a local session, which has one machine, gets a folder of its own.
    """
    named = spark.conf.get(CHECKPOINT_KEY, None)
    context = spark.sparkContext
    current = named or context.getCheckpointDir()
    if not current:
        if not context.master.startswith("local"):
            raise ValueError(f"set {CHECKPOINT_KEY} to a folder all executors reach")
        current = tempfile.mkdtemp(prefix="aqspark-")
    if not context.getCheckpointDir():
        context.setCheckpointDir(current)
    return current


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame) -> DataFrame:
    """Write a table to the shared folder and go on from there.

    What follows reads the rows instead of computing them again, a lost executor costs
    no more than a re-read, and the optimizer starts from a plain scan. Inside a ``scratch``
    block the folder goes with the block.
    """
    spark = df.sparkSession
    path = new_path(spark, "table")
    if _OPEN:
        _OPEN[-1].append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _file_system(spark: SparkSession, path: str):
    location = spark._jvm.org.apache.hadoop.fs.Path(path)
    return location.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), location


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared storage, whatever file system holds it."""
    system, location = _file_system(spark, path)
    system.delete(location, True)


def stored_files(spark: SparkSession, path: str) -> tuple[int, int]:
    """Bytes and number of the data files in a folder, none if it does not exist."""
    system, location = _file_system(spark, path)
    if not system.exists(location):
        return 0, 0
    files = [f for f in system.listStatus(location) if f.getPath().getName().startswith("part-")]
    return sum(f.getLen() for f in files), len(files)


@contextlib.contextmanager
def scratch(spark: SparkSession):
    """Tables materialised inside the block are deleted at its end, so what is made of them has to
    be written by then."""
    _OPEN.append([])
    try:
        yield
    finally:
        for path in _OPEN.pop():
            remove(spark, path)
