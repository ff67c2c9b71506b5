"""Token-ID records: length-delimited binary frames with masked checksums and a separate offset index.

A frame is: length (unsigned 64), masked CRC-32C of those 8 bytes (unsigned 32), payload, masked CRC-32C of the payload.
A payload is: doc_id (signed 64), 1 if it is known (8 bits), bytes an id (8), 0 (16), count (unsigned 32), ids. All are
little-endian. ``part-N.idx`` holds the offset of each frame of ``part-N.rec`` as unsigned 64, for shuffled reads.
A part is one range of doc_id in ascending order, so parts in turn are the whole sequence. A retried task writes the same
bytes under another name first and renames them, so a reader never meets half a part.

Null and empty texts get the end id alone; null doc_ids come first and are read back as null; rows that repeat a
doc_id are kept, in the order of their texts' checksums (equal texts: any, as their records are the same). A text of any length is one
frame, held whole by its task. Columns other than doc_id and text aren't read, whatever their names. An empty table makes a folder
without parts.
"""

from __future__ import annotations

import struct
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm.common import arrow, buckets, prepare
from quillspark.llm.tokens import Encoder

BLOCK = 64


def _byte_table() -> np.ndarray:
    crc = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        crc = np.where(crc & 1, (crc >> np.uint32(1)) ^ np.uint32(0x82F63B78), crc >> np.uint32(1)).astype(np.uint32)
    return crc


ONE = _byte_table()


def _tables(columns: np.ndarray) -> np.ndarray:
    """Four tables of 256 for a linear map of 32 bits, given by its columns."""
    out = np.zeros((4, 256), np.uint32)
    for k in range(4):
        for bit in range(8):
            out[k, (np.arange(256) >> bit) & 1 == 1] ^= columns[8 * k + bit]
    return out


def _apply(tables: np.ndarray, crc: np.ndarray) -> np.ndarray:
    return tables[0][crc & 255] ^ tables[1][(crc >> 8) & 255] ^ tables[2][(crc >> 16) & 255] ^ tables[3][crc >> 24]


def _shifts(levels: int = 32) -> list[np.ndarray]:
    """Maps for BLOCK, 2 BLOCK, 4 BLOCK ... further zero bytes."""
    columns = np.uint32(1) << np.arange(32, dtype=np.uint32)
    for _ in range(BLOCK):
        columns = ONE[columns & 255] ^ (columns >> 8)
    out = []
    for _ in range(levels):
        out.append(_tables(columns))
        columns = _apply(out[-1], columns)
    return out


SHIFTS = _shifts()


def crc32c(buffers: list[bytes]) -> np.ndarray:
    """CRC-32C of each buffer of 4 bytes or more: blocks side by side, then joined in pairs."""
    if not buffers:
        return np.empty(0, np.uint32)
    sizes = np.array([len(x) for x in buffers])
    counts = -(-sizes // BLOCK)
    ends = np.cumsum(counts) * BLOCK
    data = np.zeros(int(ends[-1]), np.uint8)
    for buffer, end, size in zip(buffers, ends, sizes, strict=True):
        data[end - size : end] = np.frombuffer(buffer, np.uint8)
    first = (ends - sizes)[:, None] + np.arange(4)
    data[first] ^= 255
    columns = np.ascontiguousarray(data.reshape(-1, BLOCK).T)
    crc = np.zeros(columns.shape[1], np.uint32)
    for column in columns:
        crc = ONE[(crc ^ column) & 255] ^ (crc >> np.uint32(8))
    for shift in SHIFTS:
        if counts.max() == 1:
            break
        halves = -(-counts // 2)
        pairs = np.zeros(int(2 * halves.sum()), np.uint32)
        old, new = np.cumsum(counts) - counts, 2 * (np.cumsum(halves) - halves)
        pairs[np.arange(len(crc)) + np.repeat(new + 2 * halves - counts - old, counts)] = crc
        crc = _apply(shift, pairs[::2]) ^ pairs[1::2]
        counts = halves
    return crc ^ np.uint32(0xFFFFFFFF)


def masked(crc: np.ndarray) -> np.ndarray:
    return ((crc >> np.uint32(15)) | (crc << np.uint32(17))) + np.uint32(0xA282EAD8)


def frames(payloads: list[bytes]) -> list[bytes]:
    heads = [struct.pack("<Q", len(x)) for x in payloads]
    a, b = masked(crc32c(heads)), masked(crc32c(payloads))
    return [b"".join((h, struct.pack("<I", x), p, struct.pack("<I", y))) for h, x, p, y in zip(heads, a, payloads, b, strict=True)]


def parse(buffer: bytes) -> tuple[list[bytes], int]:
    """The payloads of the whole frames at the start of buffer, and the bytes used. ValueError: a checksum differs."""
    heads, lengths, bodies, ends, at = [], [], [], [], 0
    while at + 12 <= len(buffer):
        n = struct.unpack_from("<Q", buffer, at)[0]
        if at + 16 + n > len(buffer):
            break
        heads.append(buffer[at : at + 8])
        lengths.append(struct.unpack_from("<I", buffer, at + 8)[0])
        bodies.append(buffer[at + 12 : at + 12 + n])
        ends.append(struct.unpack_from("<I", buffer, at + 12 + n)[0])
        at += 16 + n
    if bodies and not (np.array_equal(masked(crc32c(heads)), lengths) and np.array_equal(masked(crc32c(bodies)), ends)):
        raise ValueError("a frame's checksum differs")
    return bodies, at


def payload(doc_id: int | None, ids: bytes, width: int) -> bytes:
    """ValueError: an id needs more than ``width`` bytes."""
    values = np.frombuffer(ids, "<u4")
    if width == 2 and len(values) and values.max() >= 1 << 16:
        raise ValueError("an id needs four bytes")
    return struct.pack("<qBBHI", doc_id or 0, doc_id is not None, width, 0, len(values)) + (values.astype("<u2").tobytes() if width == 2 else ids)


def unpack(body: bytes) -> tuple[int | None, np.ndarray]:
    doc_id, known, width, _, _ = struct.unpack_from("<qBBHI", body)
    return doc_id if known else None, np.frombuffer(body, f"<u{width}", offset=16).astype("<u4")


def write_records(docs: DataFrame, folder: str, tokenizer: str, end_id: int, drops_space: bool = True) -> list[tuple[int, int, int]]:
    """Encodes doc_id, text of docs into records below folder; (part, documents, ids) of each part, in order. Ids take two bytes if the vocabulary's all do."""
    prepare(docs.sparkSession)
    end = np.array([end_id], "<u4").tobytes()

    def write(batches):
        from pyspark import TaskContext

        part, encoder = TaskContext.get().partitionId(), None
        filesystem, root = fs.FileSystem.from_uri(folder)
        new, name = f"{root}/.{uuid.uuid4().hex}", f"{root}/part-{part:06d}"
        documents = ids = at = 0
        offsets, out = [], None
        for batch in batches:
            encoder = encoder or Encoder.of(tokenizer, drops_space)
            width = 2 if max(encoder.last, end_id) < 1 << 16 else 4
            out = out or filesystem.open_output_stream(f"{new}.rec")
            doc_ids, texts = batch.column(0).to_pylist(), [x or "" for x in batch.column(1).to_pylist()]
            for i in range(0, len(texts), 128):
                encoded = [x + end for x in encoder.encode(texts[i : i + 128])]
                for frame in frames([payload(d, x, width) for d, x in zip(doc_ids[i : i + 128], encoded, strict=True)]):
                    offsets.append(at)
                    at += len(frame)
                    out.write(frame)
                documents, ids = documents + len(encoded), ids + sum(map(len, encoded)) // 4
        if out:
            out.close()
            with filesystem.open_output_stream(f"{new}.idx") as index:
                index.write(np.array(offsets, "<u8").tobytes())
            for kind in ("idx", "rec"):
                filesystem.move(f"{new}.{kind}", f"{name}.{kind}")
            yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "documents": pa.array([documents], pa.int64()), "ids": pa.array([ids], pa.int64())})

    rows = docs.select(F.col("doc_id").cast("long"), "text", F.crc32(F.coalesce("text", F.lit(""))).alias("crc"))
    dealt = rows.repartitionByRange(buckets(docs.sparkSession), "doc_id", "crc").sortWithinPartitions("doc_id", "crc").select("doc_id", "text")
    return sorted(tuple(r) for r in arrow(dealt, write, "part int, documents long, ids long", keep=True).collect())  # one row a part


def read_records(spark: SparkSession, folder: str, parts: list[tuple[int, int, int]], with_ids: bool = True) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 and, if asked for, ids of every record; each task streams one part."""
    prepare(spark)
    starts, total = [], 0
    for part, _, ids in parts:
        starts.append((part, total))
        total += ids
    listed = spark.createDataFrame(starts, "part int, start long").repartitionByRange(max(1, len(parts)), "part")

    def read(batches):
        filesystem, root = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for part, start in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                with filesystem.open_input_stream(f"{root}/part-{part:06d}.rec") as source:
                    rest = b""
                    while block := source.read(4 << 20):
                        bodies, used = parse(rest + block)
                        rest = (rest + block)[used:]
                        found = [unpack(x) for x in bodies]
                        counts = [len(x) for _, x in found]
                        firsts = start + np.cumsum([0, *counts])
                        start = int(firsts[-1])
                        yield pa.RecordBatch.from_pydict(
                            {
                                "doc_id": pa.array([d for d, _ in found], pa.int64()),
                                "start": pa.array(firsts[:-1], pa.int64()),
                                "n_tokens": pa.array(counts, pa.int64()),
                                "ids_crc32": pa.array([zlib.crc32(x.tobytes()) for _, x in found], pa.int64()),
                            }
                            | ({"ids": pa.array([x.astype(np.int32) for _, x in found], pa.list_(pa.int32()))} if with_ids else {})
                        )
                    if rest:
                        raise ValueError(f"part {part} ends inside a frame")

    return arrow(listed, read, "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids)


def read_at(folder: str, part: int, which: list[int]) -> list[tuple[int | None, np.ndarray]]:
    """The records at these places of a part, by its index: what a shuffled reader does."""
    filesystem, root = fs.FileSystem.from_uri(folder)
    with filesystem.open_input_file(f"{root}/part-{part:06d}.idx") as index, filesystem.open_input_file(f"{root}/part-{part:06d}.rec") as source:
        out = []
        for i in which:
            at = struct.unpack("<Q", index.read_at(8, 8 * i))[0]
            n = struct.unpack("<Q", source.read_at(8, at))[0]
            out.append(unpack(parse(source.read_at(16 + n, at))[0][0]))
        return out
