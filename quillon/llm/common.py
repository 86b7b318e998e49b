"""Shared plumbing of the training-data operators: inputs, shared storage, Arrow batches."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: A word: a run without the six ASCII white-space characters. bytes.split() cuts at exactly these.
ASCII_SPACE = b"\x20\x09\x0a\x0b\x0c\x0d"

#: Spark's setting for deleting an execution's shuffle files when it ends, and not when the driver's JVM collects garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

ROWS_SETTING, BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", 1_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """A fresh folder below the cluster's shared spark.checkpoint.dir.

    Only where the setting is absent (tests, a single machine) a local folder stands in for it.
    """
    context = spark.sparkContext
    root = context.getConf().get("spark.checkpoint.dir")
    if not root:
        root = getattr(context, "_quillon_dir", None)
        if root is None:
            root = context._quillon_dir = "file://" + tempfile.mkdtemp(prefix="quillon-")
    return f"{root.rstrip('/')}/quillon-{uuid.uuid4().hex}"


def stored(df: DataFrame, at: str | None = None) -> DataFrame:
    """Cut the lineage of df: write it to the shared folder and read it again.

    Unlike a cached or locally checkpointed frame, the files outlive any executor.
    """
    spark = df.sparkSession
    at = at or shared_dir(spark)
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")  # the shuffle files of this write go with its end
    try:
        df.select("*").write.mode("overwrite").parquet(at)
    finally:
        spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(at)


def mapped(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterable[pa.RecordBatch]], schema: str) -> DataFrame:
    """fn over Arrow batches, of BATCH_ROWS rows each unless the session asks for another number than Spark's default."""
    conf = df.sparkSession.conf
    if conf.get(ROWS_SETTING) == "10000":  # so many whole texts are tens of MB, held by JVM and worker alike
        conf.set(ROWS_SETTING, str(BATCH_ROWS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hold()
        yield from fn(batches)
        trim()

    return df.mapInArrow(run, schema)


def hold() -> None:
    """Let a worker's allocator keep freed arrays until trim(): fetching their pages anew costs more than most numpy work on them."""
    libc = ctypes.CDLL(None)
    if hasattr(libc, "mallopt"):  # glibc
        libc.mallopt(-3, 32 << 20)  # M_MMAP_THRESHOLD
        libc.mallopt(-1, 64 << 20)  # M_TRIM_THRESHOLD


def trim() -> None:
    """Give the system back what a worker's allocators hold unused: Spark keeps the worker for later tasks."""
    pa.default_memory_pool().release_unused()
    libc = ctypes.CDLL(None)
    if hasattr(libc, "malloc_trim"):  # glibc
        libc.malloc_trim(0)


def shuffle_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column as one array, and the n + 1 bounds of its rows; null is empty."""
    if column.null_count:
        column = column.fill_null("")
    return binary_bytes(column.cast(pa.large_string()))


def binary_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The same of a binary column without nulls."""
    if column.type == pa.binary():
        column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    if data is None or not len(column):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[bounds[0] : bounds[-1]], bounds - bounds[0]


def slices_by_bytes(batch: pa.RecordBatch, name: str, most: int) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of rows whose texts hold about most bytes (one row at least).

    Bounds the memory that work on a batch takes, however long its texts are.
    """
    _, bounds = text_bytes(batch.column(batch.schema.get_field_index(name)))
    start = 0
    while start < len(batch):
        end = max(start + 1, int(np.searchsorted(bounds, bounds[start] + most, "right")) - 1)
        yield batch.slice(start, end - start)
        start = end


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit mixer (the finaliser of splitmix64)."""
    x = x.astype(np.uint64)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def word_hashes(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """64-bit hashes of all words of the texts data[bounds[i]:bounds[i + 1]].

    Returns hash, start byte, end byte and row of each word. A word's hash depends on its bytes alone:
    a polynomial of its bytes modulo 2**64, taken from prefix sums, then mixed with its length.
    """
    space = np.zeros(256, bool)
    space[list(ASCII_SPACE)] = True
    inside = ~space[data]
    # a row's first byte begins a word even if the row before ends inside one
    edge = np.zeros(len(data) + 1, bool)
    edge[bounds] = True
    begins = inside & (edge[:-1] | np.concatenate(([True], ~inside[:-1])))
    ends = inside & (edge[1:] | np.concatenate((~inside[1:], [True])))
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    if not len(start):
        none = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), none, none, none
    row = np.searchsorted(bounds, start, "right") - 1
    # the words' bytes at places 8k..8k+7 as one integer, mixed in turn: words are short, so few rounds
    length = end - start
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    eights = np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))
    h = mix64(length.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
    live, at = np.arange(len(start)), 0
    while len(live):
        left = length[live] - at
        word = eights[start[live] + at]
        keep = np.minimum(left, 8).astype(np.uint64)
        word = word & (np.uint64(0xFFFFFFFFFFFFFFFF) >> (np.uint64(64) - keep * np.uint64(8)))
        h[live] = mix64((h[live] ^ word) * np.uint64(0x9FB21C651E98DF25) + np.uint64(at + 1))
        at += 8
        live = live[left > 8]
    return h, start, end, row
