"""Substring deduplication by content-defined chunks.

A gear hash of the last 32 bytes marks cuts, so that an insertion moves only the cuts near it. Each file sends the digests
of its distinct chunks with their first document, once each; buckets of digests answer which of those come earlier in another
file. A chunk stays where it occurs first: smallest doc_id, then file, then place. Later occurrences go, also those in
the same document.

Chunks have ``least`` to ``most`` bytes and about ``least + 2^bits`` on average; a shorter rest joins the chunk before.
Cuts never split a character. Null texts are empty: no chunks. Rows with null doc_id come after all others; repeated rows
are copies. An empty table gives no rows. A text of any length is cut whole by its task. Columns other than doc_id and text aren't read,
whatever their names.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from quillspark.llm.common import Substrings, arrow, buckets, deal, packed
from quillspark.llm.store import TextStore, by_bucket, dump, joined, parse

_rng = np.random.Generator(np.random.PCG64(20240611))
GEAR = _rng.integers(0, 2**32, 256, np.uint64).astype(np.uint32)
SECOND = _rng.integers(0, 2**63, 256, np.uint64) * np.uint64(2) + np.uint64(1)


def marks(data: np.ndarray, bits: int) -> np.ndarray:
    """Where a chunk may end: the gear hash's high bits are zero and a character starts."""
    h = GEAR[data]
    for k in (1, 2, 4, 8, 16):
        h[k:] += h[:-k] << np.uint32(k)
    flags = (h >> np.uint32(32 - bits)) == 0
    flags[:-1] &= (data[1:] & 0xC0) != 0x80
    return np.flatnonzero(flags) + 1


def cuts(data: np.ndarray, offsets: np.ndarray, least: int, most: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts of the chunks, and how many before each text. Marks within 32 bytes of a text's start are not looked at."""
    found = marks(data, bits)
    ptr = np.searchsorted(found, offsets)
    starts, counts = [], [0]
    for i, (a, b) in enumerate(zip(offsets.tolist(), offsets[1:].tolist(), strict=False)):
        own = found[ptr[i] : ptr[i + 1]].tolist()
        at, k, end = a, 0, b - least
        if a < b:
            starts.append(a)
        while at + least <= end:
            k = bisect_left(own, at + least, k)
            stop = own[k] if k < len(own) and own[k] <= at + most else at + most
            while stop < b and data[stop] & 0xC0 == 0x80:
                stop += 1
            if stop > end:
                break
            starts.append(stop)
            at = stop
        counts.append(len(starts))
    return np.array(starts, np.int64), np.array(counts, np.int64)


def digests(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """96 bits: chunks of different texts agree in them by chance only, about once in 2^96 pairs."""
    size = (end - start).astype(np.uint64)
    return Substrings(data)(start, end) + size, (Substrings(data, SECOND)(start, end) >> np.uint64(32)).astype(np.uint32)


def chunked(store: TextStore, file: int, least: int, most: int, bits: int):
    for ids, null, offsets, data, _ in store.read(file):
        starts, ptr = cuts(data, offsets, least, most, bits)
        ends = np.append(starts[1:], offsets[-1])[: len(starts)]
        last = ptr[1:][np.diff(ptr) > 0] - 1
        ends[last] = offsets[1:][np.diff(ptr) > 0]
        yield ids, null, offsets, data, starts, ends, ptr, *digests(data, starts, ends)


def first_rows(a: np.ndarray, b: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of rows in order of place: the group of each row (equal a and b), and each group's first row by doc, then place."""
    order = np.lexsort((doc, b, a))
    new = np.ones(len(a), bool)
    new[1:] = (a[order][1:] != a[order][:-1]) | (b[order][1:] != b[order][:-1])
    group = np.empty(len(a), np.int64)
    group[order] = np.cumsum(new) - 1
    return group, order[new]


def deduplicate(docs: DataFrame, folder: str, least: int = 48, most: int = 256, bits: int = 5, with_text: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_chunks, n_removed_chunks, n_removed, n_spans and kept_sha256 of every document; with_text: kept, too."""
    spark, store = docs.sparkSession, TextStore(folder)
    files = store.append(docs)
    n = buckets(spark)

    def whole(file: int):
        a, b, doc = [], [], []
        for ids, _, _, _, _, _, ptr, x, y in chunked(store, file, least, most, bits):
            a.append(x)
            b.append(y)
            doc.append(np.repeat(ids, np.diff(ptr)))
        return tuple(np.concatenate(x) for x in (a, b, doc))

    def send(batches):
        for batch in batches:
            for file in batch.column(0).to_pylist():
                a, b, doc = whole(file)
                _, first = first_rows(a, b, doc)
                for bucket, own in by_bucket((a[first] % np.uint64(n)).astype(np.int64), n, [a[first], b[first], doc[first], np.arange(len(first), dtype=np.uint32)]):
                    yield bucket, dump([*own, np.full(len(own[0]), file, np.int32)])

    def answer(blobs):
        a, b, doc, group, file = joined(blobs, [np.uint64, np.uint32, np.int64, np.uint32, np.int32])
        order = np.lexsort((file, doc, b, a))
        later = np.zeros(len(a), bool)
        later[order[1:]] = (a[order][1:] == a[order][:-1]) & (b[order][1:] == b[order][:-1])
        rows = [(k, dump([np.sort(own[0])])) for k, own in by_bucket(file[later], store.files, [group[later]])]
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in rows], pa.int32()), pa.array([x for _, x in rows], pa.binary())], ["bucket", "blob"])

    answers = packed(store.listed(spark, files), send, answer, "bucket int, blob binary", n)
    answers = deal(answers.unionByName(store.listed(spark, files)), max(1, store.files))
    names = ["doc_id", "n_bytes", "n_chunks", "n_removed_chunks", "n_removed", "n_spans", "kept_sha256"] + ["kept"] * with_text
    types = [pa.int64()] * 6 + [pa.string()] + [pa.string()] * with_text

    def finish(batches):
        later: dict[int, list[np.ndarray]] = {}
        for batch in batches:
            for file, blob in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                later.setdefault(file, []).extend(parse(blob) if blob else [])
        for file, found in later.items():
            group, first = first_rows(*whole(file))
            keep = np.zeros(len(group), bool)
            keep[first] = True
            keep[first[np.concatenate(found)] if found else []] = False
            at = 0
            for ids, null, offsets, data, starts, ends, ptr, _, _ in chunked(store, file, least, most, bits):
                own = keep[at : at + len(starts)]
                at += len(starts)
                rows = []
                for i in range(len(ids)):
                    a, b = ptr[i], ptr[i + 1]
                    k, s, e = own[a:b], starts[a:b], ends[a:b]
                    kept = data[offsets[i] : offsets[i + 1]].tobytes() if k.all() else b"".join(data[x:y].tobytes() for x, y in zip(s[k], e[k], strict=True))
                    size = int(offsets[i + 1] - offsets[i])
                    rows.append((None if null[i] else int(ids[i]), size, len(k), int((~k).sum()), size - len(kept), int((~k & np.append(True, k[:-1])).sum()) if len(k) else 0, hashlib.sha256(kept).hexdigest(), kept.decode()))
                yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], t) for j, t in enumerate(types)], names)

    return arrow(answers, finish, ", ".join(f"{k} {'long' if t == pa.int64() else 'string'}" for k, t in zip(names, types, strict=True)))


