"""Web archives with revisit records.

Pages are written once as numbered files of the shared folder, a file a scan task; payloads are never shuffled. Each file sends its
headers: the digests of payloads of ``least`` bytes or more, once each, with the largest page_id. Buckets of digests answer each file
which page is the original of its digests. Each task then writes its pages as a gzip member a record,
with fresh headers: a response with its payload, or a revisit without, that names the response. A hot payload is a header a file.

Null html is an empty payload. Pages without page_id are responses, as are rows that repeat an original's page_id.
Null urls give an empty target. An empty table makes a folder without archives. A payload of any length is one record, held whole by its
task. Columns other than page_id, url and html aren't read, whatever their names.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import uuid

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm.common import arrow, buckets, deal, packed, remove
from quillspark.llm.store import TextStore, by_bucket, dump, parse

HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"  # the pages have no date, and a retried task must write the same bytes


def record_id(page_id: int | None, salt: str = "") -> str:
    """Version 8 holds page_id itself; pages without one get a name-based id."""
    if page_id is None:
        return uuid.uuid5(uuid.NAMESPACE_URL, salt).urn
    bits = page_id % 2**64
    return uuid.UUID(int=(bits >> 62) << 64 | 8 << 76 | 2 << 62 | bits % 2**62).urn


def page_of(urn: str) -> int | None:
    value = uuid.UUID(urn)
    if value.version != 8:
        return None
    bits = (value.int >> 64 & 3) << 62 | value.int % 2**62
    return bits - 2**64 if bits >> 63 else bits


def record(page_id: int | None, url: str, html: bytes, sha1: str, refers_to: int | None) -> bytes:
    digest = base64.b32encode(bytes.fromhex(sha1)).decode()
    block = HTTP if refers_to is not None else HTTP + html
    head = {
        "WARC-Type": "response" if refers_to is None else "revisit",
        "WARC-Record-ID": f"<{record_id(page_id, f'{url} {sha1}')}>",
        "WARC-Date": DATE,
        "WARC-Target-URI": re.sub(r"[\r\n]", "", url),
        "WARC-Payload-Digest": f"sha1:{digest}",
        "WARC-Block-Digest": f"sha1:{base64.b32encode(hashlib.sha1(block).digest()).decode()}",
        "X-Payload-Length": str(len(html)),
        "Content-Type": "application/http; msgtype=response",
        "Content-Length": str(len(block)),
    }
    if refers_to is not None:
        head |= {"WARC-Profile": PROFILE, "WARC-Refers-To": f"<{record_id(refers_to)}>"}
    return "WARC/1.1\r\n".encode() + "".join(f"{k}: {v}\r\n" for k, v in head.items()).encode() + b"\r\n" + block + b"\r\n\r\n"


def read_archive(stream) -> iter:
    """Headers and block of each record; ValueError where a block's digest differs."""
    source = gzip.GzipFile(fileobj=stream)
    while line := source.readline():
        if line.strip() != b"WARC/1.1":
            raise ValueError("no record starts here")
        head = {}
        while (line := source.readline().strip()):
            k, _, v = line.decode().partition(":")
            head[k] = v.strip()
        block = source.read(int(head["Content-Length"]))
        if source.read(4) != b"\r\n\r\n" or f"sha1:{base64.b32encode(hashlib.sha1(block).digest()).decode()}" != head["WARC-Block-Digest"]:
            raise ValueError(f"{head['WARC-Record-ID']} is damaged")
        yield head, block


def sha1s(offsets: np.ndarray, data: np.ndarray) -> list[bytes]:
    view = memoryview(data)
    return [hashlib.sha1(view[a:b]).digest() for a, b in zip(offsets, offsets[1:], strict=False)]


def originals(store: TextStore, files: list[int], spark: SparkSession, least: int) -> DataFrame:
    """For each file (bucket) the digests that several pages have, with the original's page_id."""
    n = buckets(spark)

    def send(batches):
        for batch in batches:
            for file in batch.column(0).to_pylist():
                found: dict[bytes, tuple[int, int]] = {}
                for ids, null, offsets, data, _ in store.read(file):
                    for page, lacks, size, sha1 in zip(ids.tolist(), null.tolist(), np.diff(offsets).tolist(), sha1s(offsets, data), strict=True):
                        if size >= least and not lacks:
                            best, many = found.get(sha1, (page, 0))
                            found[sha1] = max(best, page), many + 1
                digest = np.frombuffer(b"".join(x + bytes(4) for x in found), np.uint64).reshape(-1, 3)
                page, many = np.array(list(found.values()), np.int64).reshape(-1, 2).T
                for bucket, own in by_bucket((digest[:, 0] % np.uint64(n)).astype(np.int64), n, [*digest.T, page, many]):
                    yield bucket, dump([*own, np.array([file], np.int32)])

    def answer(blobs):
        found = [parse(x) for x in blobs]
        if not found:
            return
        a, b, c, page, many = (np.concatenate([x[j] for x in found]) for j in range(5))
        file = np.concatenate([np.repeat(x[5], len(x[0])) for x in found])
        order = np.lexsort((page, c, b, a))
        new = np.append(True, (a[order][1:] != a[order][:-1]) | (b[order][1:] != b[order][:-1]) | (c[order][1:] != c[order][:-1]))
        heads = np.flatnonzero(new)
        sizes = np.diff(np.append(heads, len(order)))
        best, total = np.empty(len(a), np.int64), np.empty(len(a), np.int64)
        best[order] = np.repeat(page[order][heads + sizes - 1], sizes)
        total[order] = np.repeat(np.add.reduceat(many[order], heads), sizes)
        hit = total > 1
        rows = [(k, dump(own)) for k, own in by_bucket(file[hit], store.files, [x[hit] for x in (a, b, c, best)])]
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in rows], pa.int32()), pa.array([x for _, x in rows], pa.binary())], ["bucket", "blob"])

    return packed(store.listed(spark, files), send, answer, "bucket int, blob binary", n)


def write_archives(pages: DataFrame, folder: str, least: int = 1000) -> list[int]:
    """Writes archive-N.warc.gz below folder; the numbers N."""
    spark, store = pages.sparkSession, TextStore(f"{folder}/pages", rest=True)
    files = store.append(pages.select(F.col("page_id").cast("long").alias("doc_id"), F.col("html").alias("text"), F.coalesce("url", F.lit("")).alias("rest")))
    told = deal(originals(store, files, spark, least).unionByName(store.listed(spark, files)), max(1, store.files))

    def write(batches):
        answers: dict[int, list[list[np.ndarray]]] = {}
        for batch in batches:
            for file, blob in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                answers.setdefault(file, []).extend([parse(blob)] if blob else [])
        filesystem, root = fs.FileSystem.from_uri(folder)
        for file, found in answers.items():
            of: dict[bytes, int] = {}
            for *digest, best in found:
                raw = np.stack(digest, 1).tobytes()
                of |= {raw[24 * i : 24 * i + 20]: x for i, x in enumerate(best.tolist())}
            new = f"{root}/.{uuid.uuid4().hex}"
            with filesystem.open_output_stream(new, compression=None) as out:
                for (ids, null, offsets, data, _), urls in zip(store.read(file), store.rests(file), strict=True):
                    for i, (page, url, sha1) in enumerate(zip(ids.tolist(), urls.to_pylist(), sha1s(offsets, data), strict=True)):
                        html = data[offsets[i] : offsets[i + 1]].tobytes()
                        to = of.get(sha1) if len(html) >= least and not null[i] else None
                        out.write(gzip.compress(record(None if null[i] else page, url, html, sha1.hex(), to if to is not None and page < to else None), 5, mtime=0))
            filesystem.move(new, f"{root}/archive-{file:06d}.warc.gz")
            yield pa.RecordBatch.from_pydict({"part": pa.array([file], pa.int32())})

    done = sorted(r[0] for r in arrow(told, write, "part int").collect())  # one row an archive
    remove(f"{folder}/pages")
    return done


def read_archives(spark: SparkSession, folder: str, parts: list[int]) -> DataFrame:
    """page_id, url, payload_bytes, payload_digest, record_type, refers_to and the record's own payload of every record."""
    listed = spark.createDataFrame([(x,) for x in parts], "part int").repartitionByRange(max(1, len(parts)), "part")

    def rows(found):
        kinds = {"page_id": pa.int64(), "url": pa.string(), "payload_bytes": pa.int64(), "payload_digest": pa.string(), "record_type": pa.string(), "refers_to": pa.int64(), "payload": pa.binary()}
        return pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], t) for i, t in enumerate(kinds.values())], list(kinds))

    def read(batches):
        filesystem, root = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for part in batch.column(0).to_pylist():
                with filesystem.open_input_stream(f"{root}/archive-{part:06d}.warc.gz", compression=None) as stream:
                    found = []
                    for head, block in read_archive(stream):
                        html, digest = block.partition(b"\r\n\r\n")[2], base64.b32decode(head["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
                        if head["WARC-Type"] == "response" and hashlib.sha1(html).hexdigest() != digest:
                            raise ValueError(f"{head['WARC-Record-ID']} has another payload")
                        found.append((page_of(head["WARC-Record-ID"][1:-1]), head["WARC-Target-URI"], int(head["X-Payload-Length"]), digest, head["WARC-Type"], page_of(head["WARC-Refers-To"][1:-1]) if "WARC-Refers-To" in head else None, html))
                        if len(found) == 256:
                            yield rows(found)
                            found = []
                    yield rows(found)

    return arrow(listed, read, "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary")
