"""Intermediate tables in the shared checkpoint folder.

A staged table cuts lineage and outlives any executor.  The folder is the
session's spark.checkpoint.dir; only where that is unset (tests) is a local
folder made.
"""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_KEY = "spark.checkpoint.dir"
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
# Rows sent to a Python worker at once: texts can be long.
BATCH_ROWS, BATCH_BYTES = 1000, 4 << 20
_WORKER = {"ARROW_DEFAULT_MEMORY_POOL": "system", "MALLOC_ARENA_MAX": "2", "MALLOC_TRIM_THRESHOLD_": "4000000", "MALLOC_MMAP_THRESHOLD_": "1000000"}
_recorders: list[list[DataFrame]] = []
_marked: set[str] = set()
_local: dict[str, str] = {}


def checkpoint_dir(spark: SparkSession) -> str:
    found = spark.conf.get(_KEY, None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"{_KEY} must name a folder that all executors share")
        found = _local.setdefault(spark.sparkContext.applicationId, f"file://{tempfile.gettempdir()}/tessera-{uuid.uuid4().hex}")
    return found.rstrip("/")


def _own_folder(spark: SparkSession) -> str:
    """This application's folder of staged tables; what is left there goes when the driver ends."""
    folder = f"{checkpoint_dir(spark)}/tessera/{spark.sparkContext.applicationId}"
    if folder not in _marked:
        _marked.add(folder)
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
        fs.mkdirs(path)
        fs.deleteOnExit(path)
    return folder


def staged(df: DataFrame, name: str, codec: str = "snappy") -> DataFrame:
    """Writes df once and returns the table read back."""
    spark = df.sparkSession
    path = f"{_own_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", codec).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._staged_path = path
    for r in _recorders:
        r.append(out)
    return out


def quoted(name: str) -> Column:
    """The column of exactly this name, dots and all."""
    return F.col(f"`{name.replace('`', '``')}`")


def small_batches(spark: SparkSession) -> None:
    """Bounds what one Arrow batch can hold and has Python workers give memory back, for the whole session."""
    for name, value in _WORKER.items():
        spark.sparkContext.environment.setdefault(name, value)
    if int(spark.conf.get(_BATCH)) > BATCH_ROWS or int(spark.conf.get(_BATCH)) <= 0:
        spark.conf.set(_BATCH, str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def give_back() -> None:
    """Has this process return freed memory to the system, where its C library can."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


@contextmanager
def recorded() -> Iterator[list[DataFrame]]:
    """The tables staged inside the block."""
    found: list[DataFrame] = []
    _recorders.append(found)
    try:
        yield found
    finally:
        _recorders.remove(found)


def clear_staged(spark: SparkSession) -> None:
    """Deletes all tables this application has staged; call it when their results are written."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{checkpoint_dir(spark)}/tessera/{spark.sparkContext.applicationId}")
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def drop_staged(*frames: DataFrame) -> None:
    """Deletes staged tables that no later plan reads."""
    for df in frames:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df._staged_path)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
