"""What the operators share: the shared folder, written tables, text batches and packed exchanges.

Python workers meet text as Arrow buffers. ``text_slices`` hands out pieces of bounded size as numpy
arrays, so that a worker's memory follows the slice, not the partition. ``packed`` deals binary blobs
to numbered partitions: each map task sends one row a bucket, so a hot key costs one entry a task.
"""

from __future__ import annotations

import atexit
import ctypes
import gc
import hashlib
import shutil
import sys
import tempfile
import uuid
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.shared import base

ROWS_PER_BATCH = 1024
SLICE_BYTES = 2 << 20


_shipped: set[str] = set()


def prepare(spark: SparkSession) -> None:
    """Arrow batches of few rows: texts are long, and rows bound a batch's memory. Workers get this package."""
    if spark.sparkContext.applicationId not in _shipped:
        _shipped.add(spark.sparkContext.applicationId)
        root = Path(__file__).resolve().parents[1]
        folder = tempfile.mkdtemp(prefix="quillspark-")
        atexit.register(shutil.rmtree, folder, True)
        spark.sparkContext.addPyFile(shutil.make_archive(f"{folder}/{root.name}", "zip", root.parent, root.name))
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key, "10000")) > ROWS_PER_BATCH:
        spark.conf.set(key, str(ROWS_PER_BATCH))


def work_dir(spark: SparkSession, name: str) -> str:
    """A new folder below the shared one. It goes when the driver's Python ends."""
    uri = f"{base(spark)}/quillspark/{name}-{uuid.uuid4().hex}"
    filesystem, path = fs.FileSystem.from_uri(uri)
    filesystem.create_dir(path, recursive=True)
    atexit.register(remove, uri)
    return uri


def unused(df: DataFrame, name: str) -> str:
    """The name, with as many underscores as it takes not to be a column of df."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def remove(uri: str) -> None:
    filesystem, path = fs.FileSystem.from_uri(uri)
    try:
        filesystem.delete_dir(path)
    except OSError:
        pass  # already gone


def table(df: DataFrame, uri: str) -> DataFrame:
    """Writes df and reads it back: lineage ends there, and a lost executor loses nothing."""
    df.write.mode("overwrite").option("compression", "zstd").parquet(uri)
    return df.sparkSession.read.schema(df.schema).parquet(uri)


def release(spark: SparkSession) -> None:
    """Spark deletes the shuffle files of plans that nothing holds any more; it learns of that when the driver collects garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def arrow(df: DataFrame, each, schema, keep: bool = False) -> DataFrame:
    """mapInArrow that gives memory back when a task ends. Workers outlive tasks: keep: so do tokenizers and what they know."""

    def own(batches):
        trim(keep)
        yield from each(batches)
        trim(keep)

    return df.mapInArrow(own, schema)


def trim(keep: bool) -> None:
    tokens = sys.modules.get("quillspark.llm.tokens")
    if tokens and not keep:
        tokens.Encoder._own.clear()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:
        pass  # a C library without it


def buckets(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def text_slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES):
    """(first row, offsets, bytes) of runs of whole texts with at most ``limit`` bytes, or one longer text. Null: empty."""
    values = batch.column(batch.schema.get_field_index(column))
    if pa.types.is_string(values.type) or pa.types.is_large_string(values.type):
        values = pc.fill_null(values, "")
    values = values.cast(pa.large_binary())
    n = len(values)
    if not n:
        return
    _, where, what = values.buffers()
    offsets = np.frombuffer(where, np.int64)[values.offset : values.offset + n + 1]
    data = np.frombuffer(what, np.uint8) if what is not None and what.size else np.empty(0, np.uint8)
    row = 0
    while row < n:
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + limit, "right")) - 1)
        yield row, offsets[row : end + 1] - offsets[row], data[offsets[row] : offsets[end]]
        row = end


_rng = np.random.Generator(np.random.PCG64(20240607))
BYTE = _rng.integers(0, 2**63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
K = np.uint64(0x9E3779B97F4A7C15)
K_INVERSE = np.uint64(pow(int(K), -1, 2**64))
LOWER = BYTE.copy()
LOWER[65:91] = BYTE[97:123]
_powers: dict[str, np.ndarray] = {}


def _power(name: str, base: np.uint64, n: int) -> np.ndarray:
    have = _powers.get(name)
    if have is None or len(have) < n:
        size = max(n, SLICE_BYTES + 2)
        have = np.full(size, base, np.uint64)
        have[0] = 1
        _powers[name] = have = np.cumprod(have)
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(32))


LONG = 256  # bytes; sums of powers modulo 2**64 are equal for some pairs of regular strings of 1024 bytes and more


class Substrings:
    """64-bit hashes of any byte ranges of ``data``, from one pass of prefix sums; those of more than LONG bytes are digests."""

    def __init__(self, data: np.ndarray, letters: np.ndarray = BYTE):
        self.data, self.lower, self.key = data, letters is LOWER, letters[:4].tobytes()
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(letters[data] * _power("k", K, len(data)), out=self.sums[1:])

    def raw(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self.sums[end] - self.sums[start]) * _power("i", K_INVERSE, len(self.sums))[start]

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        out = mix(self.raw(start, end))
        far = np.flatnonzero(end - start > LONG)
        if len(far):
            view = memoryview(np.ascontiguousarray(self.data))
            for i in far.tolist():
                own = view[int(start[i]) : int(end[i])]
                out[i] = int.from_bytes(hashlib.blake2b(bytes(own).lower() if self.lower else own, digest_size=8, key=self.key).digest(), "little")
        return out


SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the runs of bytes other than 0x20 and 0x09-0x0D; first word of each text, with the total last."""
    n = len(data)
    if not n:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.zeros(len(offsets), np.int64)
    inside = ~SPACE[data]
    border = np.zeros(n + 1, bool)
    border[offsets] = True
    before, after = np.empty(n, bool), np.empty(n, bool)
    before[0], before[1:] = True, ~inside[:-1]
    after[-1], after[:-1] = True, ~inside[1:]
    starts = np.flatnonzero(inside & (before | border[:-1]))
    ends = np.flatnonzero(inside & (after | border[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def grams(hashes: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of k words in a row that don't cross texts, and how many before each text; texts of fewer words have none."""
    n = len(hashes)
    if n < k:
        return np.empty(0, np.uint64), np.zeros(len(first), np.int64)
    out = np.zeros(n - k + 1, np.uint64)
    for j in range(k):
        out += hashes[j : n - k + 1 + j] * np.uint64(pow(0xD6E8FEB86659FD93, j + 1, 2**64))
    counts = np.maximum(np.diff(first) - k + 1, 0)
    ptr = np.concatenate([[0], np.cumsum(counts)])
    at = np.arange(ptr[-1]) + np.repeat(first[:-1] - ptr[:-1], counts)
    return mix(out[at]), ptr


def per_text(values: np.ndarray, ptr: np.ndarray) -> np.ndarray:
    """Sums of values between the bounds in ptr; 0 for empty ranges."""
    sums = np.concatenate([np.zeros(1, values.dtype if values.dtype.kind == "f" else np.int64), np.cumsum(values, dtype=None if values.dtype.kind == "f" else np.int64)])
    return sums[ptr[1:]] - sums[ptr[:-1]]


def packed(df: DataFrame, send, receive, schema: str, n: int) -> DataFrame:
    """send(batches) yields (bucket, blob) in each map task; receive(blobs) yields Arrow batches, once in each of n partitions."""

    def out(batches):
        got: list = []
        for bucket, blob in send(batches):
            got.append((int(bucket), blob))
            if len(got) >= 256:
                yield pa.RecordBatch.from_arrays([pa.array([b for b, _ in got], pa.int32()), pa.array([x for _, x in got], pa.binary())], ["bucket", "blob"])
                got = []
        if got:
            yield pa.RecordBatch.from_arrays([pa.array([b for b, _ in got], pa.int32()), pa.array([x for _, x in got], pa.binary())], ["bucket", "blob"])

    def take(batches):
        yield from receive([x for batch in batches for x in batch.column(1).to_pylist()])

    return arrow(deal(arrow(df, out, "bucket int, blob binary"), n), take, schema)


def deal(df: DataFrame, n: int) -> DataFrame:
    """Row to the partition of its bucket number."""
    return df.repartitionById(n, F.col("bucket"))


def cut(bucket: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """A stable order by bucket, and the n + 1 bounds of the buckets in it."""
    order = np.argsort(bucket, kind="stable")
    return order, np.searchsorted(bucket[order], np.arange(n + 1))
