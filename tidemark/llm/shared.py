"""Tables in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import ctypes
import functools
import inspect
import tempfile
import time
import uuid
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

_WRITTEN: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The cluster's spark.checkpoint.dir; a folder of our own only where that is unset (local tests)."""
    context = spark.sparkContext
    path = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not path:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        path = "file://" + tempfile.mkdtemp(prefix="tidemark-")
        context.setCheckpointDir(path)
    return path.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/tidemark-{uuid.uuid4().hex}/{name}"
    _WRITTEN.append((spark, path.rpartition("/")[0]))
    return path


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write df as a Parquet table in the shared folder and read it back.

    A lost executor costs at most the tasks of the stage that was running; what was written before is read again.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch_path = path
    return out


def drop(*tables: DataFrame) -> None:
    """Delete written tables that nothing will read again, and let go of shuffles behind frames that are gone."""
    for table in tables:
        discard(table.sparkSession, table._scratch_path)
    if tables:
        free_shuffles(tables[0].sparkSession)


def discard(spark: SparkSession, path: str) -> None:
    """Delete a table that new_path named."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def small_batches(spark: SparkSession) -> None:
    """Whole texts make large rows: send them to Python workers in batches of 1,000 instead of the default 10,000.

    A value that the session has set itself stays.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == "10000":
        spark.conf.set(key, "1000")


def free_shuffles(spark: SparkSession) -> None:
    """Let Spark's cleaner drop shuffle files of frames that nothing refers to any more."""
    import gc

    gc.collect()
    spark.sparkContext._jvm.System.gc()


_trimmed = 0.0


def _trim() -> None:
    """Give the memory that this process has freed back to the machine."""
    global _trimmed
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)
    _trimmed = time.monotonic()


def lean(function: Callable) -> Callable:
    """For functions on batches or tables: a Python worker that waits for its next task keeps no freed memory.

    Workers outlive stages, so what one stage's tasks needed would else count against the memory of the next.
    """
    if inspect.isgeneratorfunction(function):

        @functools.wraps(function)
        def run(batches):
            try:
                yield from function(batches)
            finally:
                _trim()

    else:

        @functools.wraps(function)
        def run(table):
            try:
                return function(table)
            finally:
                if time.monotonic() - _trimmed > 0.5:
                    _trim()

    return run


@atexit.register
def _clean() -> None:
    for spark, path in _WRITTEN:
        try:
            discard(spark, path)
        except Exception:  # the session may be gone; the folder is a scratch folder
            return
