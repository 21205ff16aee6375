"""Intermediate tables and small relational helpers that the operators share."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import functools
import inspect
import tempfile
import uuid
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Tables of at most so many rows, whose width is fixed, are broadcast; larger ones take a shuffled join.
BROADCAST_ROWS = 200_000
BATCH_ROWS, BATCH_BYTES = 1000, 8 << 20
_WATCHED = False


def folder(spark: SparkSession) -> str:
    """The shared folder of ``spark.checkpoint.dir``; only a local session without it gets a temporary one."""
    place = spark.conf.get("spark.checkpoint.dir", None)
    if place is None:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        place = "file://" + tempfile.mkdtemp(prefix="tabtrust-")
        spark.conf.set("spark.checkpoint.dir", place)
    return place


def _place(spark: SparkSession) -> str:
    return f"{folder(spark)}/tabtrust/{spark.sparkContext.applicationId}"


def clear(spark: SparkSession) -> None:
    """Delete the tables that this application wrote; results that were made of them can't be read any more."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_place(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def _clear_last() -> None:
    with contextlib.suppress(Exception):  # the session may have ended before
        if (spark := SparkSession.getActiveSession()) is not None and spark.conf.get("spark.checkpoint.dir", None):
            clear(spark)


def table(df: DataFrame, name: str = "t") -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: lineage is cut, and a lost executor loses nothing.

    Tables are in a folder of the application, which is deleted when the driver's Python ends, or by `clear`.
    """
    global _WATCHED
    if not _WATCHED:
        atexit.register(_clear_last)
        _WATCHED = True
    spark = df.sparkSession
    path = f"{_place(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def light(df: DataFrame) -> DataFrame:
    """df; its session hands whole texts to Python in batches of at most BATCH_ROWS rows and BATCH_BYTES bytes from now on,
    as far as it has Spark's own bounds, which are made for short rows."""
    conf = df.sparkSession.conf
    if int(conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) == 10_000:
        conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
        conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    return df


def give_back() -> None:
    """Memory that a Python worker has freed goes back to the system; workers wait for their next task for long."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def trimmed(run: Callable) -> Callable:
    """A function of a Python worker, of batches or of a column or group, that gives memory back at its end."""

    @functools.wraps(run)
    def lazy(batches):
        try:
            yield from run(batches)
        finally:
            give_back()

    @functools.wraps(run)
    def whole(values):
        try:
            return run(values)
        finally:
            give_back()

    return lazy if inspect.isgeneratorfunction(run) else whole


def small(df: DataFrame, rows: int | None = None, limit: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if its counted rows (fixed width) are at most limit; else df, for a shuffled join."""
    return F.broadcast(df) if (df.count() if rows is None else rows) <= limit else df


def without(df: DataFrame, *names: str) -> DataFrame:
    """df less the columns that would clash, in any case, with the named result columns."""
    low = {n.lower() for n in names}
    return df.select([quoted(c) for c in df.columns if c.lower() not in low])


def quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")
