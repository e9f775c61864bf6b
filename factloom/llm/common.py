"""What the operators of this package share: staged tables in the shared folder and Arrow helpers."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side of at most this many bytes (counted first) may be broadcast; larger ones are joined by shuffle.
BROADCAST_BYTES = 8 << 20
#: Rows per file of a table whose size is known.
FILE_ROWS = 250_000
#: Bytes of an Arrow batch for Python: rows differ in length by orders, so a bound on their number bounds no memory.
BATCH_BYTES = 8 << 20
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def shared_dir(spark: SparkSession, label: str) -> str:
    """A new folder name below ``spark.checkpoint.dir``; a temporary base is set only where that is unset (tests).

    Every operator asks for one first, so this is also where the session's Arrow batches are bounded, unless they are already.
    """
    given = spark.conf.get(_BATCH).rstrip("b")
    if not (given.isdigit() and 0 < int(given) <= BATCH_BYTES):
        spark.conf.set(_BATCH, str(BATCH_BYTES))
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = getattr(shared_dir, "own", None)
        if base is None:
            base = shared_dir.own = "file://" + tempfile.mkdtemp(prefix="factloom-")
    return f"{base.rstrip('/')}/factloom/{label}-{uuid.uuid4().hex}"


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def cleaning(spark: SparkSession) -> Iterator[None]:
    """Actions inside leave no shuffle files; for those whose result is written, so that nothing reads them again."""
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)


def stage(df: DataFrame, label: str, codec: str = "snappy", rows: int | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage, and a lost executor loses nothing of it.

    rows: a bound on the rows where it is known; a small table is then written in as few files as there are cores.
    """
    spark = df.sparkSession
    path = shared_dir(spark, label)
    if rows is not None:
        df = df.coalesce(max(spark.sparkContext.defaultParallelism, -(-rows // FILE_ROWS)))
    with cleaning(spark):
        df.write.option("compression", codec).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._staged_at = path
    return out


def drop_staged(*tables: DataFrame) -> None:
    """Delete staged tables that nothing reads any more."""
    for table in tables:
        jvm = table.sparkSession._jvm
        path = jvm.org.apache.hadoop.fs.Path(table._staged_at)
        path.getFileSystem(table.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def partitions(spark: SparkSession) -> int:
    """Partitions of a shuffle whose rows take long for their few bytes, so that they aren't merged by their size."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def bounded(df: DataFrame, row_bytes: int) -> DataFrame:
    """A staged table with a broadcast hint if its counted rows are within the bound."""
    return F.broadcast(df) if df.count() * row_bytes <= BROADCAST_BYTES else df


def string_bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and its n + 1 offsets, without a copy; null counts as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if len(col) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    if col.null_count:
        col = col.fill_null("")
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    _, offsets, data = col.buffers()
    offs = np.frombuffer(offsets, np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[offs[0] : offs[-1]], offs - offs[0]


def doc_chunks(offsets: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows of at most ``most`` bytes each; a longer row is a range of its own."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def give_back() -> None:
    """Return the memory that a Python worker has freed to the system; between chunks, so that workers stay small."""
    import ctypes

    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def trimmed(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """``run`` for ``mapInArrow``, after which the worker, idle until its next task, holds little memory."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        give_back()

    return wrapped


def open_fs(uri: str):
    """(file system, path) of a folder or file of the shared store, for Python workers."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri else "file://" + uri)


def read_bytes(uri: str) -> pa.Buffer:
    """A file of the shared store: memory-mapped where it is a local path, else read whole."""
    filesystem, path = open_fs(uri)
    if filesystem.type_name == "local":
        return pa.memory_map(path).read_buffer()
    with filesystem.open_input_file(path) as f:
        return f.read_buffer()


def write_bytes(uri: str, data) -> None:
    """Write a file of the shared store under a name of its own, then rename: a repeated task leaves one whole file."""
    filesystem, path = open_fs(uri)
    filesystem.create_dir(path.rpartition("/")[0], recursive=True)
    tmp = f"{path}.{uuid.uuid4().hex}.tmp"
    with filesystem.open_output_stream(tmp) as f:
        f.write(data)
    filesystem.move(tmp, path)
