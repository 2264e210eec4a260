"""Shared helpers: the scratch folder, size-checked broadcasts and Arrow plumbing."""

from __future__ import annotations

import ctypes
import gc
import os
import tempfile
import uuid
from collections.abc import Callable
from contextlib import suppress

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Largest side, in bytes, that an operator of this package broadcasts.
BROADCAST_BYTES = 16 << 20
#: Empty what modules keep in a worker from task to task. Each module adds its own where it is imported.
KEPT: list[Callable[[], None]] = []


def scratch(spark: SparkSession, what: str) -> str:
    """A new folder name in the shared checkpoint folder, which the driver and all executors reach.

    The folder is the one that spark.checkpoint.dir names; only with a local master a temporary one is
    made where it is unset.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors reach")
        base = getattr(spark.sparkContext, "_vecloom_scratch", None)
        if base is None:
            base = "file://" + tempfile.mkdtemp(prefix="vecloom-")
            spark.sparkContext._vecloom_scratch = base
    return f"{base.rstrip('/')}/vecloom-{what}-{uuid.uuid4().hex}"


def stored(df: DataFrame, what: str) -> DataFrame:
    """Write df to the scratch folder and read it again: a cut of the lineage that outlives executors."""
    spark = df.sparkSession
    path = scratch(spark, what)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_folder(spark: SparkSession, path: str) -> None:
    """Delete a scratch folder whose readers are done."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def drop_stored(*frames: DataFrame) -> None:
    """Delete the scratch folders of frames made by stored() once nothing reads them."""
    for df in frames:
        for folder in {os.path.dirname(f) for f in df.inputFiles()}:
            drop_folder(df.sparkSession, folder)


def maybe_broadcast(df: DataFrame, rows: int, row_bytes: int) -> DataFrame:
    """Hint a broadcast if rows * row_bytes fits BROADCAST_BYTES; else Spark shuffles."""
    return F.broadcast(df) if rows * row_bytes <= BROADCAST_BYTES else df


def text_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Arrow batches of at most so many rows, where the session has Spark's default of 10,000.

    Texts have kilobytes each; the default would put tens of megabytes at a time into each worker.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == "10000":
        spark.conf.set(key, rows)


def release() -> None:
    """Give this process's free memory back to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with suppress(AttributeError, OSError):
        ctypes.CDLL(None).malloc_trim(0)


def forget() -> None:
    """Drop what other operators' tasks have kept in this worker."""
    if KEPT:
        for clear in KEPT:
            clear()
        release()


def released(run):
    """run, a function for mapInArrow, without the memory of tasks before it, and leaving none.

    Spark keeps idle workers for a minute, so what one stage's tasks held would count in the next stages, too.
    """

    def whole(batches):
        forget()
        try:
            yield from run(batches)
        finally:
            release()

    return whole


def text_bytes(text: str = "text") -> Column:
    """The UTF-8 bytes of a text column; null is empty."""
    return F.coalesce(F.col(text).cast("binary"), F.lit(b""))


def batch_of(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)
