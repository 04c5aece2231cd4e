"""Helpers shared by the corpus operators: the shared folder, written tables, Arrow text views."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """A folder that the driver and all executors see.

    It lies below ``spark.checkpoint.dir``. Where neither that setting nor the context's checkpoint folder is set, a
    temporary folder is made for a session on one machine; on a cluster that is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        sc = spark.sparkContext
        if sc.getCheckpointDir() is None:
            if sc.master.split("[")[0] != "local":
                raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors see")
            sc.setCheckpointDir(tempfile.mkdtemp(prefix="bitloom-"))
        base = sc.getCheckpointDir()
    return f"{base.rstrip('/')}/bitloom-{spark.sparkContext.applicationId}"


_RELEASED_AT_EXIT: set[str] = set()


def fresh_path(spark: SparkSession, label: str) -> str:
    """A new path in this application's folder, which is deleted when the driver ends."""
    app = spark.sparkContext.applicationId
    if app not in _RELEASED_AT_EXIT:
        _RELEASED_AT_EXIT.add(app)
        atexit.register(_release_at_exit, spark)
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once into the shared folder and return the table read back.

    This cuts the lineage and keeps results when executors are lost, and an
    expensive scan that feeds two branches runs once.
    """
    spark = df.sparkSession
    path = fresh_path(spark, label)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._bitloom_path = path
    return out


def _delete(spark: SparkSession, uri: str) -> None:
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(uri)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def discard(*tables: DataFrame) -> None:
    """Delete tables made by :func:`materialize` that no later result is read from."""
    for df in tables:
        _delete(df.sparkSession, df._bitloom_path)


def release(spark: SparkSession) -> None:
    """Delete all tables this application wrote to the shared folder."""
    _delete(spark, shared_dir(spark))


def _release_at_exit(spark: SparkSession) -> None:
    if spark.sparkContext._jsc is not None:
        with contextlib.suppress(Exception):
            release(spark)


BATCH_BYTES = 8 << 20
#: Called when a task of another stage starts, to drop what the worker process has kept.
AT_STAGE_START: list[Callable[[], object]] = []
_STAGE: list[int] = []


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` for mapInArrow, giving memory back when the task ends.

    Worker processes are reused by later stages, so what one stage caches would add to the memory
    of the next; caches are dropped when a task of another stage starts. Input batches are bounded by bytes as well as by rows (a session setting, which
    counts when the query runs), as rows may hold very long texts.
    """
    spark = SparkSession.getActiveSession()
    if spark is not None:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)

    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stage = task.stageId() if (task := TaskContext.get()) else -1
        if _STAGE != [stage]:
            _STAGE[:] = [stage]
            _POWERS.clear()
            for drop in AT_STAGE_START:
                drop()
        try:
            yield from run(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            with contextlib.suppress(OSError, AttributeError):
                ctypes.CDLL(None).malloc_trim(0)

    return tidied


def flat_text(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string array (null: empty) and the n + 1 offsets into them."""
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
    if arr.null_count:
        arr = pc.fill_null(arr, "")
    wide = pa.types.is_large_string(arr.type) or pa.types.is_large_binary(arr.type)
    kind = np.dtype(np.int64 if wide else np.int32)
    _, offsets, data = arr.buffers()
    if len(arr) == 0 or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(len(arr) + 1, np.int64)
    off = np.frombuffer(offsets, kind, len(arr) + 1, arr.offset * kind.itemsize).astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def pieces(batch: pa.RecordBatch, column: str, limit: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """Cut a batch into slices of at most ``limit`` bytes of ``column`` each (one row at least).

    Nothing is dropped: this only bounds the working memory of the vectorised steps.
    """
    _, off = flat_text(batch.column(batch.schema.get_field_index(column)))
    at = 0
    while at < batch.num_rows:
        to = int(np.searchsorted(off, off[at] + limit, side="right")) - 1
        to = min(max(to, at + 1), batch.num_rows)
        yield batch.slice(at, to - at)
        at = to


#: LUT of ASCII lower case.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def find_words(data: np.ndarray, off: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends (exclusive) of maximal runs of word bytes that don't cross texts,
    and the n + 1 offsets of each text's words. ``is_word``: 256 booleans."""
    n = len(data)
    if n == 0:
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(off), np.int64)
    mask = is_word[data]
    first = np.empty(n, bool)
    first[0] = True
    np.logical_not(mask[:-1], out=first[1:])
    last = np.empty(n, bool)
    last[-1] = True
    np.logical_not(mask[1:], out=last[:-1])
    edge = off[(off > 0) & (off < n)]
    first[edge] = True
    last[edge - 1] = True
    starts = np.flatnonzero(first & mask)
    ends = np.flatnonzero(last & mask) + 1
    return starts, ends, np.searchsorted(starts, off)


_R = 0x9E3779B97F4A7C15
_POWERS: list[np.ndarray] = []


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit polynomial hash of each word; equal words have equal hashes."""
    if len(starts) == 0:
        return np.zeros(0, np.uint64)
    if not _POWERS:
        p = np.empty(65536, np.uint64)
        x = 1
        for i in range(65536):
            p[i] = x
            x = x * _R & (2**64 - 1)
        _POWERS.append(p)
    lens = ends - starts
    begin = np.cumsum(lens) - lens
    total = int(lens.sum())
    within = np.arange(total, dtype=np.int64) - np.repeat(begin, lens)
    byte = data[np.repeat(starts, lens) + within].astype(np.uint64) + np.uint64(1)
    byte *= _POWERS[0][within & 0xFFFF]
    h = np.add.reduceat(byte, begin)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    return h
