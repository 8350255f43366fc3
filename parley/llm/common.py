"""Shared plumbing: session limits, shared storage, collision-free column names, Arrow text access."""

from __future__ import annotations

import functools
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes and rows in one Arrow batch: bounds a Python worker's memory whatever the text lengths are.
BATCH_BYTES = 2 << 20
BATCH_ROWS = 2048

SPACES = np.zeros(256, dtype=bool)
SPACES[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def bounded_batches(spark: SparkSession) -> None:
    """Caps Arrow batches by bytes, so that very long texts cannot fill a worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``; on a local master that has none, a new one.

    Work files stay there until the folder is cleared: results are read from them lazily.
    """
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="parley-shared-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def work_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder."""
    return f"{shared_dir(spark)}/parley/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Writes a table to the shared folder and reads it back: cuts lineage and survives lost executors."""
    spark, path = df.sparkSession, work_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def free_name(df: DataFrame, base: str) -> str:
    """``base``, or the first ``base_N`` that is no column of ``df`` (names compare without case, as Spark's do)."""
    taken, name, n = {c.lower() for c in df.columns}, base, 0
    while name.lower() in taken:
        n += 1
        name = f"{base}_{n}"
    return name


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(all bytes, n + 1 offsets from 0, validity) of a string or binary column; nulls have no bytes."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    valid = np.ones(len(column), dtype=bool) if not column.null_count else column.is_valid().to_numpy(zero_copy_only=False)
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64), valid
    at = np.frombuffer(column.buffers()[1], dtype=np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8)[at[0] : at[-1]] if data is not None and at[-1] > at[0] else np.zeros(0, np.uint8)
    return raw, at - at[0], valid


def between(running: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sums of a flag array over the slices that ``at`` bounds."""
    total = np.concatenate(([0], np.cumsum(running, dtype=np.int64)))
    return total[at[1:]] - total[at[:-1]]


def fixed_multipliers(n: int, seed: int) -> np.ndarray:
    """n odd 64-bit multipliers; the same for a seed everywhere."""
    return np.random.default_rng(seed).integers(1, 1 << 63, size=n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser over unsigned 64-bit values."""
    with np.errstate(over="ignore"):
        x = x.astype(np.uint64, copy=True)
        x ^= x >> np.uint64(32)
        x *= np.uint64(0xD6E8FEB86659FD93)
        x ^= x >> np.uint64(32)
        x *= np.uint64(0xD6E8FEB86659FD93)
        x ^= x >> np.uint64(32)
    return x


def arrow_function(kind: str):
    """A vectorised Spark function over Arrow arrays; made when it is called, as a type needs a running session."""

    def wrap(f):
        @functools.wraps(f)
        def call(*columns):
            return F.arrow_udf(f, kind)(*columns)

        call.over_arrays = f
        return call

    return wrap
