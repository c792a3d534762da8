"""What the operators share: the cluster's shared folder, tables written to it, and bounded batches."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BATCH_ROWS = 256
BROADCAST_ROWS = 250_000  # of ids, numbers and digests: at most 25 MB
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_scratch: ContextVar[str | None] = ContextVar("scratch", default=None)


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: ``spark.checkpoint.dir`` of the session.

    Only in a local session where that is unset, as in a test, a new temporary folder is taken and
    remembered; on a cluster that would be another folder on each machine, so there it is an error.
    """
    known = spark.conf.get("spark.checkpoint.dir", None)
    if not known:
        if spark.sparkContext.master.partition("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        known = f"file://{tempfile.mkdtemp(prefix='recollect-')}"
        spark.conf.set("spark.checkpoint.dir", known)
    return known.rstrip("/")


def shared_path(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder, or in the scratch folder of the operator that runs."""
    return f"{_scratch.get() or shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


@contextmanager
def scratch(spark: SparkSession, label: str) -> Iterator[None]:
    """Tables written inside go to a folder of their own, which is dropped at the end.

    Only what is written after the end may be read later.
    """
    folder = shared_path(spark, label)
    token = _scratch.set(folder)
    try:
        yield
    finally:
        _scratch.reset(token)
        drop(spark, folder)


def drop(spark: SparkSession, path: str) -> None:
    """Removes a folder of the shared store through Hadoop's file systems."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def outside(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder itself: for what outlives the scratch folder."""
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str, path: str | None = None) -> DataFrame:
    """The same rows, from a table in the shared folder: they outlive executors and cut the lineage.

    Once the table is there, nothing needs the shuffle files that made it; Spark is told to drop them.
    """
    spark = df.sparkSession
    path = path or shared_path(spark, label)
    with during_writes(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def during_writes(spark: SparkSession, rows: int = BATCH_ROWS) -> Iterator[None]:
    """Settings of the jobs run inside, put back at the end: shuffle files go with their job, and what waits
    between a task and its Python worker is at most ``rows`` rows at a time."""
    own = {CLEANUP: "true", "spark.sql.execution.arrow.maxRecordsPerBatch": str(rows)}
    before = {key: spark.conf.get(key, None) for key in own}
    for key, value in own.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            if value is None:
                spark.conf.unset(key)
            else:
                spark.conf.set(key, value)


def slices(batches: Iterable[pa.RecordBatch], rows: int = BATCH_ROWS) -> Iterator[pa.RecordBatch]:
    """Parts of at most ``rows`` rows. Spark bounds a batch's bytes itself."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def sliced(run: Callable, rows: int = BATCH_ROWS) -> Callable:
    """``run``, given its batches in parts of at most ``rows`` rows. At the end of a task its worker gives free memory back,
    so that what waits idle beside later stages stays small."""

    def parts(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(slices(batches, rows))
        give_back()

    return parts


def give_back() -> None:
    """Returns what Arrow and the C library hold without use to the system, where they can."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def checked(small: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``small``, to be broadcast if it has at most ``rows`` rows; else Spark joins it by shuffles."""
    return F.broadcast(small) if small.limit(rows + 1).count() <= rows else small


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))
