"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import functools
import inspect
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Python workers get about this many bytes, and the kernels at most this many text bytes, at once.
BATCH_BYTES = 4 << 20
SLICE_BYTES = 4 << 20
LIBC = ctypes.CDLL(None)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where it is unset, a temporary folder does in local mode (tests); on a cluster this is an error.
    """
    path = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        path = "file://" + os.path.join(tempfile.gettempdir(), "checkpoints", "skyquilt")
        spark.conf.set("spark.checkpoint.dir", path)
        spark.sparkContext.setCheckpointDir(path)
    return path.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/skyquilt/{uuid.uuid4().hex}/{name}"


#: Spark removes the shuffle files of an execution as soon as it is over; else they stay until the driver collects its garbage.
FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialize(df: DataFrame, name: str, free: bool = False, **options: str) -> DataFrame:
    """Write df into the shared folder and read it again: cuts lineage and survives lost executors.

    ``free``: the shuffle files of this one write go with its end.
    """
    spark = df.sparkSession
    path = fresh_path(spark, name)
    before = spark.conf.get(FREE_SHUFFLES, None)
    if free:
        spark.conf.set(FREE_SHUFFLES, "true")
    try:
        df.write.options(**{"compression": "zstd", **options}).parquet(path)
    finally:
        if free and before is not None:
            spark.conf.set(FREE_SHUFFLES, before)
        elif free:
            spark.conf.unset(FREE_SHUFFLES)
    return spark.read.schema(df.schema).parquet(path)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bound_batches(spark: SparkSession) -> None:
    """Keep Arrow batches small in bytes, so that long texts cannot fill a Python worker."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def texts(df: DataFrame, *keys: str) -> DataFrame:
    """Only the named columns and ``text``, null text as the empty string."""
    return df.select(*keys, F.coalesce(F.col("text"), F.lit("")).alias("text"))


def slices(batch: pa.RecordBatch, column: str = "text", limit: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Cut a batch into runs of at most ``limit`` text bytes (one row at least): rows, UTF-8 bytes, offsets."""
    col = batch.column(batch.schema.get_field_index(column))
    if pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type):
        off = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + len(col) + 1]
    else:
        off = np.frombuffer(col.buffers()[1], np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    data = np.frombuffer(col.buffers()[2], np.uint8) if col.buffers()[2] is not None else np.zeros(0, np.uint8)
    start = 0
    while start < len(col):
        end = max(start + 1, int(np.searchsorted(off, off[start] + limit, "right")) - 1)
        end = min(end, len(col))
        yield batch.slice(start, end - start), data[off[start] : off[end]], off[start : end + 1] - off[start]
        start = end


def release() -> None:
    """Give memory that this process has freed, and long tables of powers, back to the system."""
    if len(POWERS.up) > MOST_POWERS:
        POWERS.__init__()
    pa.default_memory_pool().release_unused()
    if hasattr(LIBC, "malloc_trim"):
        LIBC.malloc_trim(0)


def lean(work: Callable) -> Callable:
    """work, a worker's function or generator, with a release() at its end: idle workers else keep the most that they ever held."""

    @functools.wraps(work)
    def generate(*args):  # noqa: ANN002, ANN202
        try:
            yield from work(*args)
        finally:
            release()

    @functools.wraps(work)
    def call(*args):  # noqa: ANN002, ANN202
        try:
            return work(*args)
        finally:
            release()

    return generate if inspect.isgeneratorfunction(work) else call


class Powers:
    """Powers of an odd multiplier and of its inverse modulo 2**64, grown on demand."""

    def __init__(self, r: int = 0x9E3779B97F4A7C15) -> None:
        self.r, self.inv = np.uint64(r), np.uint64(pow(r, -1, 1 << 64))
        self.up = self.down = np.ones(1, np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 2 * len(self.up))
            for name, base in (("up", self.r), ("down", self.inv)):
                a = np.full(size, base, np.uint64)
                a[0] = 1
                setattr(self, name, np.multiply.accumulate(a))
        return self.up, self.down


#: A fixed 64-bit value for each byte.
BYTE_VALUES = np.random.Generator(np.random.PCG64(20240229)).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
POWERS = Powers()
#: Powers that an idle worker keeps (32 MB for both tables).
MOST_POWERS = 1 << 21


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def prefix_sums(values: np.ndarray) -> np.ndarray:
    """S with S[i] = sum of values[j] * r**j for j < i, modulo 2**64."""
    up, _ = POWERS.get(len(values) + 1)
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[: len(values)], out=out[1:])
    return out


def span_hashes(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of values[start:end], the same wherever the span stands."""
    _, down = POWERS.get(len(sums))
    return mix((sums[end] - sums[start]) * down[start])


def signed(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x).view(np.int64)


def output(schema: pa.Schema, columns: dict) -> pa.RecordBatch:
    return pa.record_batch([pa.array(columns[f.name], f.type) if not isinstance(columns[f.name], pa.Array) else columns[f.name].cast(f.type) for f in schema], schema=schema)


def ddl(schema: pa.Schema) -> str:
    kinds = {pa.int64(): "long", pa.int32(): "int", pa.string(): "string", pa.binary(): "binary", pa.bool_(): "boolean", pa.float64(): "double", pa.list_(pa.int32()): "array<int>", pa.list_(pa.int64()): "array<long>"}
    return ", ".join(f"{f.name} {kinds[f.type]}" for f in schema)
