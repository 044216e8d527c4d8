"""Session, storage and Arrow helpers shared by the operators of this subpackage."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share (``spark.checkpoint.dir``).

    Only a local session that has none (tests) gets a local one; on a cluster a missing setting is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = tempfile.mkdtemp(prefix="markwright-checkpoints-")
        spark.sparkContext.setCheckpointDir(root)
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder."""
    return f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut lineage: write ``df`` as a table in the shared folder and read it back."""
    spark, schema = df.sparkSession, df.schema
    path = shared_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(schema).parquet(path)


@contextmanager
def rows_a_batch(spark: SparkSession, most: int) -> Iterator[None]:
    """What runs inside hands at most ``most`` rows at a time to Python; a smaller setting of the session holds.

    Whole texts in batches of Spark's 10,000 rows take some 100 MB of an executor for each task, on both sides.
    """
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    if not 0 < int(before) <= most:
        spark.conf.set(name, most)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def keep_rows_a_batch(spark: SparkSession, most: int) -> None:
    """As ``rows_a_batch``, but the session keeps the setting: for a plan that runs only when its caller writes it."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= most:
        spark.conf.set(name, most)


def filesystem(path: str):
    """(pyarrow filesystem, path) of a local or remote address, for files Spark has no writer for."""
    from pyarrow import fs

    if "://" not in path and path.startswith("file:"):
        path = path[5:]
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


_remembered: dict[str, dict] = {}


def remembered(owner: str) -> dict:
    """What the operator ``owner`` keeps in this Python worker from task to task; what others kept there goes.

    Workers outlive a query, and an executor's memory has room for the words of one operator only. Free memory that
    earlier tasks left with the allocators goes back too: that of Arrow, and that of the C library below Python and numpy.
    """
    for x in [x for x in _remembered if x != owner]:
        del _remembered[x]
    for pool in (pa.default_memory_pool(), pa.system_memory_pool()):
        pool.release_unused()
    return _remembered.setdefault(owner, {})


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (n + 1) of a string column without copying its text; a null has no bytes."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.string())
    wide = np.int64 if pa.types.is_large_string(column.type) else np.int32
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, wide)[column.offset : column.offset + n + 1].astype(np.int64)
    buf = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return buf, off


def blocks(off: np.ndarray, most: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Runs [i, j) of documents of at most ``most`` bytes together (or one longer document)."""
    n, i = len(off) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + most, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def longs(column: pa.Array) -> np.ndarray:
    """An integer column as int64; nulls are 0 (ask ``is_valid`` for them)."""
    return column.cast(pa.int64()).fill_null(0).to_numpy(zero_copy_only=False)


def batches(rows: pa.Table, most: int = 20_000) -> Iterator[pa.RecordBatch]:
    yield from rows.to_batches(max_chunksize=most)
