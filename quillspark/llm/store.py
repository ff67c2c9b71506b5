"""Documents in numbered files of the shared folder, that later passes read one by one.

Each scan task writes its documents as one file of compressed Arrow batches of bounded bytes: doc_id, bytes of the text,
their 128-bit digest and, if asked for, a struct of other columns. Texts are then never shuffled; passes exchange keys and answers by
file number, and a batch can be read alone. A retried task
writes under a new name and renames it; the numbers of the attempts that Spark counted are those returned.
"""

from __future__ import annotations

import hashlib
import uuid

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm.common import arrow, deal, prepare, text_slices

NAMES = ["doc_id", "text", "digest", "rest"]
LAST = 2**63 - 1  # null doc_ids come after all others


class TextStore:
    def __init__(self, folder: str, rest: bool = False):
        self.folder, self.files, self.rest = folder, 0, rest
        filesystem, path = fs.FileSystem.from_uri(folder)
        filesystem.create_dir(path, recursive=True)

    def append(self, docs: DataFrame) -> list[int]:
        """Writes doc_id, text and, where docs has it, rest; the numbers of the files, from the number of files so far."""
        prepare(docs.sparkSession)
        rest = F.col("rest") if self.rest else F.lit(None).cast("string")
        folder, first = self.folder, self.files

        def write(batches):
            from pyspark import TaskContext

            part, out = TaskContext.get().partitionId(), None
            filesystem, root = fs.FileSystem.from_uri(folder)
            new = f"{root}/.{uuid.uuid4().hex}"
            for batch in batches:
                for row, offsets, data in text_slices(batch, "text"):
                    view, n = memoryview(data), len(offsets) - 1
                    digests = [hashlib.blake2b(view[a:b], digest_size=16).digest() for a, b in zip(offsets, offsets[1:], strict=False)]
                    texts = pa.LargeBinaryArray.from_buffers(pa.large_binary(), n, [None, pa.py_buffer(np.ascontiguousarray(offsets)), pa.py_buffer(np.ascontiguousarray(data))])
                    own = pa.RecordBatch.from_arrays([batch.column(0).slice(row, n), texts, pa.array(digests, pa.binary(16)), batch.column(2).slice(row, n)], NAMES)
                    if out is None:
                        sink = filesystem.open_output_stream(new)
                        out = pa.ipc.new_file(sink, own.schema, options=pa.ipc.IpcWriteOptions(compression="zstd"))
                    out.write_batch(own)
            if out is not None:
                out.close()
                sink.close()
                filesystem.move(new, f"{root}/text-{first + part:06d}")
                yield pa.RecordBatch.from_pydict({"file": pa.array([first + part], pa.int32())})

        got = sorted(r[0] for r in arrow(docs.select(F.col("doc_id").cast("long"), "text", rest.alias("rest")), write, "file int").collect())  # one row a file
        self.files = max([self.files, *[x + 1 for x in got]])
        return got

    def listed(self, spark: SparkSession, files: list[int]) -> DataFrame:
        """A row (bucket, blob) for each file, in the partition of that number."""
        return deal(spark.createDataFrame([(x, None) for x in files], "bucket int, blob binary"), max(1, self.files))

    def batches(self, file: int, which: list[int] | None = None, columns: list[int] | None = None):
        """(number, batch) of these batches of a file, or all; of these columns, or all."""
        filesystem, root = fs.FileSystem.from_uri(self.folder)
        with filesystem.open_input_file(f"{root}/text-{file:06d}") as source:
            reader = pa.ipc.open_file(source, options=pa.ipc.IpcReadOptions(included_fields=columns))
            for number in range(reader.num_record_batches) if which is None else which:
                yield number, reader.get_batch(number)

    def has(self, file: int) -> bool:
        """Empty tasks write no file."""
        filesystem, root = fs.FileSystem.from_uri(self.folder)
        return filesystem.get_file_info(f"{root}/text-{file:06d}").type == fs.FileType.File

    def read(self, file: int, which: list[int] | None = None):
        """doc_ids (nulls: LAST), whether null, offsets, bytes, digests of each batch."""
        for _, batch in self.batches(file, which):
            ids = batch.column(0)
            _, offsets, data = next(text_slices(batch, "text", 1 << 62))
            yield ids.fill_null(LAST).to_numpy(), ids.is_null().to_numpy(zero_copy_only=False), offsets, data, batch.column(2).to_pylist()

    def rests(self, file: int):
        """The column rest of each batch."""
        for _, batch in self.batches(file, columns=[3]):
            yield batch.column(0)

    def drop(self, names: list[str], n: int) -> None:
        """Deletes the side files of these names with numbers under n."""
        filesystem, root = fs.FileSystem.from_uri(self.folder)
        have = {x.path for x in filesystem.get_file_info(fs.FileSelector(root))}
        for path in {f"{root}/{name}-{i:06d}" for name in names for i in range(n)} & have:
            filesystem.delete_file(path)

    def side(self, name: str, file: int) -> str:
        return f"{self.folder}/{name}-{file:06d}"


def save(uri: str, arrays: list[np.ndarray]) -> None:
    filesystem, path = fs.FileSystem.from_uri(uri)
    new = f"{path}.{uuid.uuid4().hex}"
    with filesystem.open_output_stream(new) as out:
        out.write(dump(arrays))
    filesystem.move(new, path)


def load(uri: str) -> list[np.ndarray]:
    filesystem, path = fs.FileSystem.from_uri(uri)
    with filesystem.open_input_stream(path) as source:
        return parse(source.read())


def dump(arrays: list[np.ndarray]) -> bytes:
    """Arrays as one compressed blob; the first bytes of all numbers come first, then the second ones, which compresses better."""
    batch = [np.ascontiguousarray(x) for x in arrays]
    head = ";".join(f"{x.dtype.str},{len(x)}" for x in batch).encode()
    body = b"".join(x.view(np.uint8).reshape(len(x), -1).T.tobytes() if x.dtype.itemsize > 1 and len(x) else x.tobytes() for x in batch)
    packed = pa.compress(body, codec="zstd", asbytes=True) if body else b""
    return len(head).to_bytes(4, "little") + len(body).to_bytes(8, "little") + head + packed


def parse(blob: bytes) -> list[np.ndarray]:
    n, size = int.from_bytes(blob[:4], "little"), int.from_bytes(blob[4:12], "little")
    body = pa.decompress(blob[12 + n :], decompressed_size=size, codec="zstd", asbytes=True) if size else b""
    out, at = [], 0
    for x in blob[12 : 12 + n].decode().split(";") if n else []:
        kind, length = x.split(",")
        dtype, length = np.dtype(kind), int(length)
        own = np.frombuffer(body, np.uint8, dtype.itemsize * length, at)
        out.append(np.ascontiguousarray(own.reshape(dtype.itemsize, length).T).view(dtype).ravel() if dtype.itemsize > 1 and length else own.view(dtype))
        at += dtype.itemsize * length
    return out


def by_bucket(bucket: np.ndarray, n: int, arrays: list[np.ndarray]):
    """(bucket, arrays of its rows), for buckets that have any."""
    order = np.argsort(bucket, kind="stable")
    bounds = np.searchsorted(bucket[order], np.arange(n + 1))
    for b in np.flatnonzero(np.diff(bounds)):
        rows = order[bounds[b] : bounds[b + 1]]
        yield int(b), [x[rows] for x in arrays]


def joined(blobs: list[bytes], empty: list[np.dtype]) -> list[np.ndarray]:
    parts = [parse(x) for x in blobs]
    return [np.concatenate([p[i] for p in parts]) if parts else np.empty(0, d) for i, d in enumerate(empty)]
