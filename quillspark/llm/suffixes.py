"""Suffix-array deduplication with a logarithmic family of indexes.

The suffixes that are indexed start at minimizers: of the places in a string of ``match`` bytes at which GRAM bytes fit, the one
whose bytes hash least. It depends on the string alone, so equal strings meet at equal suffixes, about one byte in 20 is
indexed, and nothing is missed. Of each suffix, a level holds its first bytes, fingerprints of what is right of its start, left of it and of its
whole surroundings (all strings about it), and its place: file, batch and byte. Levels are in lexical order, dealt to buckets by ranges.

A new batch's suffixes are sorted and merge-scanned against the levels. Surroundings that an older batch has are repeated, without
a look at the text. Otherwise a string about the suffix that another document has is wholly in
the right or the left half of what surrounds both: neighbours in the merged array that agree to the right (by ``match`` - half
bytes), or suffixes that agree to the left, may hold one. Only these stretches are fetched, by their places, and compared: in the
middle of a long match, surroundings agree whole, so only its ends are. A level keeps each surroundings once, so a hot passage is
one row, whatever its copies. Levels of equal size merge, bucket by bucket and without a shuffle; a row is rewritten once a doubling.
The last batch isn't inserted.

Batches come in ascending doc_id, so all that a level holds is of smaller doc_ids. Whole copies are found first, by 128-bit digests; only
the first of them is indexed. Strings are compared byte by byte after their hashes agree; whole surroundings by 64-bit hashes beside their prefixes.

Null texts are empty. Null doc_ids come after all others. Rows with equal doc_id don't remove each other's bytes. Texts
under ``match`` bytes keep all. Texts of any length are indexed in pieces; a task holds one whole. An empty table gives no rows. Columns
other than doc_id and text aren't read; ``cut`` returns them as they are, whatever their names.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark.llm.common import SLICE_BYTES, Substrings, arrow, buckets, deal, mix, release, remove, table
from quillspark.llm.store import LAST, TextStore, by_bucket, dump, joined, load, parse, save

GRAM, PLACE = 12, np.uint64(28)
PIECE = SLICE_BYTES - 1024
ALL = np.uint64(2**64 - 1)
RIGHT, LEFT = 0, 1


def windows_min(h: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` values in a row."""
    size = 1
    while 2 * size <= width:
        h = np.minimum(h[:-size], h[size:])
        size *= 2
    return np.minimum(h[: len(h) - (width - size)], h[width - size :]) if width > size else h


def suffixes(data: np.ndarray, offsets: np.ndarray, match: int):
    """Of each minimizer in order: place, text, first 8 and next 4 bytes as numbers in lexical order, fingerprints of right, left (0: too near the text's end) and surroundings."""
    width, half = match - GRAM + 1, (match - GRAM + 1) // 2
    last = -1
    for a in range(0, max(len(data) - match + 1, 0), PIECE):
        low, high = max(0, a - 2 * match), min(len(data), a + PIECE + 2 * match)
        own = data[low:high]
        hashed = Substrings(own)
        at = np.arange(len(own) - GRAM + 1)
        h = (hashed(at, at + GRAM) >> PLACE << PLACE) | at.astype(np.uint64)
        anchor = (windows_min(h, width) & np.uint64((1 << int(PLACE)) - 1)).astype(np.int64)
        inside = offsets[(offsets > low) & (offsets < high)] - low
        steps = np.zeros(len(anchor) + 1, np.int32)
        np.add.at(steps, np.clip(inside - match + 1, 0, len(anchor)), 1)
        np.add.at(steps, np.clip(inside, 0, len(anchor)), -1)
        valid = np.cumsum(steps[:-1]) == 0  # strings that don't cross texts
        valid[: a - low] = False
        valid[a - low + PIECE :] = False
        p = anchor[valid]
        p = p[np.append(True, p[1:] != p[:-1])] if len(p) else p
        p = p[p + low > last]
        if not len(p):
            continue
        last = int(p[-1]) + low
        text = np.searchsorted(offsets, p + low, "right") - 1
        start, end = np.maximum(offsets[text] - low, 0), np.minimum(offsets[text + 1] - low, len(own))
        chars = own[p[:, None] + np.arange(GRAM)]
        right, left = p + match - half, p - half
        r = np.where(right <= end, hashed(p, np.minimum(right, len(own))) >> np.uint64(32) | np.uint64(1), np.uint64(0))
        l = np.where(left >= start, hashed(np.maximum(left, 0), p + GRAM) >> np.uint64(32) | np.uint64(1), np.uint64(0))  # noqa: E741
        start, end = np.maximum(start, p - width + 1), np.minimum(end, p + match)
        f = mix(hashed(start, end) ^ ((p - start) << 8 | (end - p)).astype(np.uint64))
        yield p + low, text, chars[:, :8].copy().view(">u8").ravel().astype(np.uint64), chars[:, 8:].copy().view(">u4").ravel().astype(np.uint32), r.astype(np.uint32), l.astype(np.uint32), f


def stretch(p: np.ndarray, offsets: np.ndarray, side: np.ndarray, match: int) -> tuple[np.ndarray, np.ndarray]:
    """Start of the right or left half of what surrounds each place of a batch, and how many strings it has."""
    width, half = match - GRAM + 1, (match - GRAM + 1) // 2
    text = np.searchsorted(offsets, p, "right") - 1
    start = np.maximum(offsets[text], np.where(side == RIGHT, p - half, p - width + 1))
    end = np.minimum(offsets[text + 1], np.where(side == RIGHT, p + match, p + match - half))
    return start, np.maximum(end - start - match + 1, 0)


def originals(digests: list[bytes], ids: np.ndarray, least: dict[bytes, tuple[int, int]], at: int) -> None:
    """The first place and the least doc_id of each digest of a file."""
    for i, (digest, doc) in enumerate(zip(digests, ids.tolist(), strict=True)):
        place, best = least.get(digest, (at + i, doc))
        least[digest] = place, min(best, doc)


def digests_of(store: TextStore, file: int) -> dict[bytes, tuple[int, int]]:
    least: dict[bytes, tuple[int, int]] = {}
    at = 0
    for _, batch in store.batches(file, columns=[0, 2]):
        ids = batch.column(0).fill_null(LAST).to_numpy()
        originals(batch.column(1).to_pylist(), ids, least, at)
        at += len(ids)
    return least


def pairs_of(digests: list[bytes]) -> np.ndarray:
    """Both halves of each digest, in turn."""
    return np.frombuffer(b"".join(digests), np.uint64)


def batches_of(store: TextStore, file: int):
    """Each batch of a file with: which texts are the first copies in it, and the least doc_id of each text's copies."""
    least = digests_of(store, file)
    at = 0
    for ids, null, offsets, data, digests in store.read(file):
        found = [least[d] for d in digests]
        yield ids, null, offsets, data, digests, np.array([p == at + i for i, (p, _) in enumerate(found)], bool), np.array([b for _, b in found], np.int64)
        at += len(ids)


def index(store: TextStore, file: int, match: int, copies: set[bytes]) -> list[np.ndarray]:
    """hi, lo, right, left, surroundings and place of each distinct surroundings of a new file: the place is in the document with the least doc_id.

    Written beside: the other places of surroundings that recur in the file, with the first one and whether their document comes later;
    the least doc_id of each row's copies; the copies.
    """
    parts: list[list[np.ndarray]] = []
    best_of = []
    for number, (_, _, offsets, data, digests, original, best) in enumerate(batches_of(store, file)):
        best_of.append(best)
        take = original & np.array([d not in copies for d in digests], bool)
        for p, text, *rest in suffixes(data, offsets, match):
            own = take[text]
            parts.append([(number << 32) + p[own], best[text[own]], *[x[own] for x in rest]])
    kinds = [np.int64, np.int64, np.uint64, np.uint32, np.uint32, np.uint32, np.uint64]
    p, doc, hi, lo, r, l, f = (np.concatenate(x) for x in zip(*parts, strict=True)) if parts else [np.empty(0, k) for k in kinds]  # noqa: E741
    order = np.lexsort((p, doc, f))
    new = np.append(True, f[order][1:] != f[order][:-1])[: len(order)]
    first = order[new]
    of = first[np.cumsum(new) - 1] if len(order) else order
    again = ~new
    save(store.side("same", file), [p[order[again]], p[of[again]], (doc[order[again]] > doc[of[again]]).astype(np.uint8)])
    save(store.side("best", file), [np.concatenate(best_of) if best_of else np.empty(0, np.int64), np.array([len(x) for x in best_of], np.int64)])
    save(store.side("copies", file), [pairs_of(sorted(copies))])
    return [x[first] for x in (hi, lo, r, l, f, p)]


def fetched(store: TextStore, file: int, p: np.ndarray, side: np.ndarray, match: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """How many strings each half has, and its bytes; only the batches of a file that these places are in are read."""
    count, text = np.zeros(len(p), np.int64), [np.empty(0, np.uint8)] * len(p)
    order = np.argsort(p, kind="stable")
    number = p[order] >> 32
    which = np.unique(number)
    for k, (_, _, offsets, data, _) in zip(which.tolist(), store.read(file, which.tolist()), strict=True):
        rows = order[np.searchsorted(number, k) : np.searchsorted(number, k, "right")]
        start, n = stretch(p[rows] & 0xFFFFFFFF, offsets, side[rows], match)
        count[rows] = n
        for row, a, m in zip(rows.tolist(), start.tolist(), n.tolist(), strict=True):
            if m:
                text[row] = data[a : a + m + match - 1]
    return count, text


def earlier(doc: np.ndarray, count: np.ndarray, text: np.ndarray, match: int) -> np.ndarray:
    """Of each stretch in text, its strings (bit k: that at k) that some stretch of a smaller doc has, too."""
    n = len(doc)
    if not n:
        return np.empty(0, np.uint64)
    ends = np.cumsum(count + match - 1)
    starts = ends - count - match + 1
    first = np.cumsum(count) - count
    k = np.arange(int(count.sum())) - np.repeat(first, count)
    at = np.repeat(starts, count) + k
    h = np.empty(len(at), np.uint64)
    step = 1 << 14  # stretches at a time, for bounded tables of powers
    for a in range(0, n, step):
        b = min(n, a + step)
        x, y = first[a], first[b - 1] + count[b - 1]
        h[x:y] = Substrings(text[starts[a] : ends[b - 1]])(at[x:y] - starts[a], at[x:y] - starts[a] + match)
    docs = np.repeat(doc, count)
    order = np.argsort(h)
    hs = h[order]
    same = np.zeros(len(h), bool)
    same[1:] = hs[1:] == hs[:-1]
    pairs = np.flatnonzero(same)
    for a in range(0, len(pairs), 1 << 16):
        p = pairs[a : a + (1 << 16)]
        x, y = at[order[p]], at[order[p - 1]]
        span = np.arange(match)
        same[p] = (text[x[:, None] + span] == text[y[:, None] + span]).all(1)
    heads = np.flatnonzero(~same)
    best = np.minimum.reduceat(docs[order], heads)
    group = np.cumsum(~same) - 1
    flag = np.zeros(len(h), bool)
    flag[order] = docs[order] > best[group]
    return np.add.reduceat(flag.astype(np.uint64) << k.astype(np.uint64), first)


def rows_of(store: TextStore, match: int, file: int, whole: np.ndarray, place: np.ndarray, side: np.ndarray, bits: np.ndarray, names: list[str]):
    """The result of a file: places whose surroundings are repeated whole, and strings (bits) of halves that are."""
    other, first, later_doc = load(store.side("same", file))
    copies = load(store.side("copies", file))[0].tobytes()
    copies = {copies[i : i + 16] for i in range(0, len(copies), 16)}
    # places with the same surroundings fare as their first one, or are repeated whole
    gone = (later_doc > 0) | np.isin(first, whole)
    whole = np.sort(np.concatenate([whole, other[gone]]))
    other, first = other[~gone], first[~gone]
    order = np.argsort(place, kind="stable")
    place, side, bits = place[order], side[order], bits[order]
    low, high = np.searchsorted(place, first), np.searchsorted(place, first, "right")
    for k in (0, 1):  # two halves at most
        has = low + k < high
        at = (low + k)[has]
        place, side, bits = np.concatenate([place, other[has]]), np.concatenate([side, side[at]]), np.concatenate([bits, bits[at]])
    order = np.argsort(place, kind="stable")
    place, side, bits = place[order], side[order], bits[order]
    width, half = match - GRAM + 1, (match - GRAM + 1) // 2
    done: dict[bytes, tuple] = {}
    later: list[tuple] = []
    for number, ((ids, null, offsets, data, digests, original, best), rest) in enumerate(zip(batches_of(store, file), store.rests(file), strict=True)):
        edges = np.array([number << 32, (number + 1) << 32])
        cover = np.zeros(len(data) + 1, np.int32)
        a, b = np.searchsorted(whole, edges)
        p = whole[a:b] - edges[0]
        text = np.searchsorted(offsets, p, "right") - 1
        np.add.at(cover, np.maximum(offsets[text], p - width + 1), 1)
        np.add.at(cover, np.minimum(offsets[text + 1], p + match), -1)
        a, b = np.searchsorted(place, edges)
        start, _ = stretch(place[a:b] - edges[0], offsets, side[a:b], match)
        left = bits[a:b]
        for k in range(max(half, width - 1 - half) + 1):
            on = start[(left >> np.uint64(k)) & np.uint64(1) == 1] + k
            np.add.at(cover, on, 1)
            np.add.at(cover, on + match, -1)
        gone = np.cumsum(cover[:-1]) > 0
        rows, which = [], []
        for i in range(len(ids)):
            x, y = offsets[i], offsets[i + 1]
            if original[i]:
                flags = gone[x:y]
                kept = data[x:y][~flags].tobytes()
                spans = int((flags[1:] & ~flags[:-1]).sum() + flags[0]) if len(flags) else 0
                done[digests[i]] = (int(y - x), int(y - x) - len(kept), spans, hashlib.sha256(kept).hexdigest(), kept.decode(errors="ignore"))
            if (ids[i] > best[i] or digests[i] in copies) and y - x >= match:
                values = (int(y - x), int(y - x), 1, hashlib.sha256(b"").hexdigest(), "")
            elif digests[i] in done:
                values = done[digests[i]]
            else:
                later.append((None if null[i] else int(ids[i]), digests[i], rest.slice(i, 1)))
                continue
            rows.append((None if null[i] else int(ids[i]), *values))
            which.append(i)
        yield result(rows, rest.take(pa.array(which, pa.int64())), names)
    if later:
        yield result([(i, *done[d]) for i, d, _ in later], pa.concat_arrays([r for _, _, r in later]), names)


def result(rows: list[tuple], rest: pa.Array, names: list[str]) -> pa.RecordBatch:
    types = [pa.int64()] * 4 + [pa.string(), pa.string()]
    n = len(names) - ("rest" in names)
    return pa.RecordBatch.from_arrays([*[pa.array([r[j] for r in rows], types[j]) for j in range(n)], *[rest] * (len(names) - n)], names)


KINDS = [np.uint64, np.uint32, np.uint32, np.uint32, np.uint64, np.int64, np.int32]  # hi, lo, right, left, surroundings, place, file


def in_order(hi: np.ndarray, lo: np.ndarray, r: np.ndarray) -> np.ndarray:
    """Lexical, then by what is to the right; runs that are in order are merged, not sorted anew."""
    return np.lexsort(((lo.astype(np.uint64) << np.uint64(32)) | r, hi))


def shared(key: np.ndarray, order: np.ndarray, none: np.ndarray, fresh: np.ndarray) -> np.ndarray:
    """Which rows have a neighbour in this order with the same key, in a group with a fresh row."""
    out = np.zeros(len(key), bool)
    order = order[~none[order]]
    if not len(order):
        return out
    k = key[order]
    heads = np.flatnonzero(np.append(True, k[1:] != k[:-1]))
    sizes = np.diff(np.append(heads, len(order)))
    some = np.logical_or.reduceat(fresh[order], heads) & (sizes > 1)
    out[order] = np.repeat(some, sizes)
    return out


def rows_to(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows]), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.binary())], ["whole", "bucket", "blob"])


SCANNED = "whole boolean, bucket int, blob binary"


class SuffixFamily:
    """Levels of suffix arrays over the documents added so far. Batches must come in ascending doc_id; one doc_id's rows are in one batch."""

    def __init__(self, spark, folder: str, match: int = 50, rest: bool = False):
        if not 2 * GRAM < match <= GRAM + 62:
            raise ValueError("a half's strings are told in 64 bits, and hold a suffix's first bytes")
        self.spark, self.folder, self.match = spark, folder, match
        self.store, self.n = TextStore(folder, rest), buckets(spark)
        self.levels: list[tuple[int, str]] = []  # batches in it, name
        self.borders = np.empty(0, np.int64)  # none while there are no suffixes
        self.written = 0

    def _name(self) -> str:
        self.written += 1
        return f"level-{self.written}"

    def _ranges(self, files: list[int]) -> np.ndarray:
        """Borders of the buckets: quantiles of the first bytes of suffixes in the first batch of texts of each file."""
        store, match = self.store, self.match

        def sample(batches):
            for batch in batches:
                for file in batch.column(0).to_pylist():
                    _, _, offsets, data, _ = next(iter(store.read(file, [0])))
                    found = [x[2] for x in suffixes(data, offsets, match)]
                    yield pa.RecordBatch.from_arrays([pa.array((x[:: max(1, len(x) // 4096)] >> np.uint64(1)).astype(np.int64)) for x in ([np.concatenate(found)] if found else [np.empty(0, np.uint64)])], ["hi"])

        steps = [k / self.n for k in range(1, self.n)]
        if not files or not steps:
            return np.empty(0, np.int64)
        borders = arrow(store.listed(self.spark, files), sample, "hi long").agg(F.percentile_approx("hi", steps, min(100 * self.n, 1_000_000))).first()[0]  # as many as buckets
        return np.array(sorted(borders or []), np.int64)

    def add(self, docs: DataFrame, with_text: bool = False, last: bool = False) -> DataFrame:
        """Adds a batch of documents; doc_id, n_bytes, n_removed, n_spans and kept_sha256 of each, against all added so far. last: nothing is added after it."""
        spark, store, match, n = self.spark, self.store, self.match, self.n
        files = store.append(docs)
        if not len(self.borders):
            self.borders = self._ranges(files)
        borders, levels, name = self.borders, [x for _, x in self.levels], self._name()

        def send_digests(batches):
            for batch in batches:
                for file in batch.column(0).to_pylist():
                    found = digests_of(store, file)
                    digest, doc = pairs_of(list(found)).reshape(-1, 2), np.array([b for _, b in found.values()], np.int64)
                    for bucket, own in by_bucket((digest[:, 0] % np.uint64(n)).astype(np.int64), n, [digest[:, 0], digest[:, 1], doc]):
                        yield bucket, dump([*own, np.array([file, bucket], np.int32)])

        def find_copies(blobs):
            """For each file the digests that a smaller doc_id has; the others are kept for later batches."""
            if not blobs:
                return
            found = [parse(x) for x in blobs]
            a, b, doc = (np.concatenate([x[j] for x in found]) for j in range(3))
            file, bucket = np.concatenate([np.repeat(x[3][0], len(x[0])) for x in found]), int(found[0][3][1])
            old = [x for level in levels for x in [part(store, f"{level}-digests", bucket, [np.uint64] * 2)]]
            x, y = (np.concatenate([a, *[o[0] for o in old]]), np.concatenate([b, *[o[1] for o in old]]))
            docs_ = np.concatenate([doc, np.full(len(x) - len(a), -(2**63), np.int64)])
            order = np.lexsort((docs_, y, x))
            new = np.append(True, (x[order][1:] != x[order][:-1]) | (y[order][1:] != y[order][:-1]))
            heads = order[new][np.cumsum(new) - 1]
            later = np.zeros(len(x), bool)
            later[order] = docs_[order] > docs_[heads]
            if not last:
                keep = order[new]
                keep = keep[keep < len(a)]
                save(store.side(f"{name}-digests", bucket), [a[keep], b[keep]])
            hit = later[: len(a)]
            yield from rows_out((k, dump(own)) for k, own in by_bucket(file[hit], store.files, [a[hit], b[hit]]))

        def send(batches):
            told: dict[int, list[bytes]] = {}
            for batch in batches:
                for file, blob in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    told.setdefault(file, []).extend([blob] if blob else [])
            for file, blobs in told.items():
                raw = np.stack(joined(blobs, [np.uint64] * 2), 1).tobytes()
                hi, *rest = index(store, file, match, {raw[i : i + 16] for i in range(0, len(raw), 16)})
                order = in_order(hi, rest[0], rest[1])
                for bucket, own in by_bucket(np.searchsorted(borders, (hi[order] >> np.uint64(1)).astype(np.int64), "right"), n, [x[order] for x in (hi, *rest)]):
                    own[0] = np.diff(own[0], prepend=np.uint64(0))
                    yield bucket, dump([*own, np.array([file, bucket], np.int32)])

        def scan(blobs):
            """The merge-scan of a bucket; its new surroundings become the level's."""
            if not blobs:
                return
            found = [parse(x) for x in blobs]
            for x in found:
                x[0] = np.cumsum(x[0], dtype=np.uint64)
            new = [np.concatenate([x[j] for x in found]) for j in range(6)] + [np.concatenate([np.repeat(x[6][0], len(x[0])) for x in found])]
            bucket = int(found[0][6][1])
            del found
            old = [np.concatenate(x) for x in zip(*[part(store, level, bucket, KINDS) for level in levels], [np.empty(0, k) for k in KINDS], strict=True)]
            rows = []
            whole = np.isin(new[4], old[4])
            rows += [(True, k, dump([np.sort(own[0])])) for k, own in by_bucket(new[6][whole], store.files, [new[5][whole]])]
            new = [x[~whole] for x in new]
            hi, lo, r, l, f, p, file = (np.concatenate(x) for x in zip(old, new, strict=True))  # noqa: E741
            fresh = np.arange(len(hi)) >= len(old[0])
            order = in_order(hi, lo, r)
            right = mix(hi ^ mix((lo.astype(np.uint64) << np.uint64(32)) | r))
            left = mix(~hi ^ mix((lo.astype(np.uint64) << np.uint64(32)) | l))
            on_right = shared(right, order, r == 0, fresh)
            on_left = shared(left, np.argsort(left, kind="stable"), l == 0, fresh)
            once = np.zeros(len(hi), bool)
            once[np.unique(f, return_index=True)[1]] = True  # one row of each surroundings lends its text
            hit = on_right | on_left
            flags = on_right.astype(np.uint8) | on_left.astype(np.uint8) << 1 | once.astype(np.uint8) << 2
            rows += [(False, k, dump(own)) for k, own in by_bucket(file[hit], store.files, [x[hit] for x in (p, f, right, left, flags)])]
            if not last:
                keep = order[(fresh & once)[order]]
                save(store.side(name, bucket), [x[keep] for x in (hi, lo, r, l, f, p, file)])
            yield rows_to(rows)

        self.scanned = f"{self.folder}/{name}-scan"
        answers = packed_rows(deal(received(packed_rows(store.listed(spark, files), send_digests), find_copies, "bucket int, blob binary", n).unionByName(store.listed(spark, files)), max(1, store.files)), send)
        received(answers, scan, SCANNED, n).write.option("compression", "none").parquet(self.scanned)
        del answers
        release(spark)
        scanned = spark.read.schema(SCANNED).parquet(self.scanned)
        fresh_files = set(files)

        def ship(batches):
            wanted: dict[int, list[list[np.ndarray]]] = {}
            for batch in batches:
                for file, blob in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    wanted.setdefault(file, []).append(parse(blob))
            for file, found in wanted.items():
                p, f, right, left, flags = (np.concatenate(x) for x in zip(*found, strict=True))
                if file in fresh_files:
                    best, sizes = load(store.side("best", file))
                    starts = np.cumsum(sizes) - sizes
                    doc = np.empty(len(p), np.int64)
                    for number, (_, batch) in zip(np.unique(p >> 32).tolist(), store.batches(file, np.unique(p >> 32).tolist()), strict=True):
                        rows = p >> 32 == number
                        where = np.frombuffer(batch.column(1).buffers()[1], np.int64)[batch.column(1).offset : batch.column(1).offset + batch.num_rows + 1]
                        doc[rows] = best[starts[number] + np.searchsorted(where - where[0], p[rows] & 0xFFFFFFFF, "right") - 1]
                else:
                    doc = np.full(len(p), -(2**63), np.int64)
                each = [np.flatnonzero(flags & 1), np.flatnonzero(flags & 2)]
                row, side = np.concatenate(each), np.repeat(np.array([RIGHT, LEFT], np.uint8), [len(x) for x in each])
                to = (np.where(side == RIGHT, right[row], left[row]) % np.uint64(n)).astype(np.int64)
                lends = np.flatnonzero(flags[row] & 4)
                count, text = np.zeros(len(row), np.int64), [np.empty(0, np.uint8)] * len(row)
                some, texts = fetched(store, file, p[row[lends]], side[lends], match)
                count[lends] = some
                for i, x in zip(lends.tolist(), texts, strict=True):
                    text[i] = x
                for bucket, (i,) in by_bucket(to, n, [np.arange(len(row))]):
                    yield bucket, dump([f[row[i]], doc[row[i]], p[row[i]], side[i], count[i].astype(np.uint8), np.concatenate([text[j] for j in i.tolist()]), np.array([file], np.int32)])

        def compare(blobs):
            if not blobs:
                return
            found = [parse(x) for x in blobs]
            f, doc, p, side, count, text = (np.concatenate([x[j] for x in found]) for j in range(6))
            file = np.concatenate([np.repeat(x[6][0], len(x[0])) for x in found])
            _, kind = np.unique(f ^ (side.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), return_inverse=True)
            least = np.full(int(kind.max()) + 1, 2**63 - 1, np.int64)
            np.minimum.at(least, kind, doc)
            lends = np.flatnonzero(count)
            bits = np.zeros(len(least), np.uint64)
            bits[kind[lends]] = earlier(least[kind[lends]], count[lends].astype(np.int64), text, match)
            own = np.where(doc > least[kind], ALL, bits[kind])
            whole = doc > least[kind]
            fresh = np.isin(file, list(fresh_files))
            rows = [(True, k, dump([np.unique(x[0])])) for k, x in by_bucket(file[fresh & whole], store.files, [p[fresh & whole]])]
            some = fresh & ~whole & (own > 0)
            rows += [(False, k, dump(x)) for k, x in by_bucket(file[some], store.files, [p[some], side[some], own[some]])]
            yield rows_to(rows)

        hits = scanned.filter("not whole").select("bucket", "blob")
        answers = received(packed_rows(deal(hits, max(1, store.files)), ship), compare, SCANNED, n)
        answers = answers.unionByName(scanned.filter("whole")).unionByName(store.listed(spark, files).withColumn("whole", F.lit(True)))
        answers = deal(answers, max(1, store.files))
        names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"] + ["kept", "rest"] * with_text

        def finish(batches):
            told: dict[int, tuple[list, list]] = {}
            for batch in batches:
                for whole, file, blob in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    own = told.setdefault(file, ([], []))
                    if blob:
                        own[0 if whole else 1].append(blob)
            for file, (whole, some) in told.items():
                (places,) = joined(whole, [np.int64])
                yield from rows_of(store, match, file, np.unique(places), *joined(some, [np.int64, np.uint8, np.uint64]), names)

        if not last:
            self._insert(name)
        schema = T.StructType([T.StructField(x, T.StringType() if x in ("kept_sha256", "kept") else T.LongType()) for x in names if x != "rest"])
        return arrow(answers, finish, schema.add(docs.schema["rest"]) if with_text else schema)

    def _insert(self, name: str) -> None:
        """The new level; the last two merge while they hold as many batches: each bucket's files by one task, in lexical order."""
        self.levels.append((1, name))
        store, n = self.store, self.n
        while len(self.levels) > 1 and self.levels[-1][0] == self.levels[-2][0]:
            (a, x), (b, y), to = self.levels.pop(), self.levels.pop(), self._name()

            def merge(batches, x=x, y=y, to=to):
                for batch in batches:
                    for bucket in batch.column(0).to_pylist():
                        own = [np.concatenate(z) for z in zip(part(store, y, bucket, KINDS), part(store, x, bucket, KINDS), strict=True)]
                        order = in_order(*own[:3])
                        save(store.side(to, bucket), [z[order] for z in own])
                        save(store.side(f"{to}-digests", bucket), [np.concatenate(z) for z in zip(*[part(store, f"{k}-digests", bucket, [np.uint64] * 2) for k in (y, x)], strict=True)])
                        yield pa.RecordBatch.from_arrays([pa.array([len(order)], pa.int64())], ["n"])

            every = deal(self.spark.range(n).selectExpr("int(id) as bucket"), n)
            arrow(every, merge, "n long").agg(F.sum("n")).collect()
            self.levels.append((a + b, to))
            store.drop([f"{k}{kind}" for k in (x, y) for kind in ("", "-digests")], n)


def part(store: TextStore, name: str, bucket: int, kinds: list) -> list[np.ndarray]:
    """A level's arrays in a bucket; buckets without rows have no file."""
    try:
        return load(store.side(name, bucket))
    except FileNotFoundError:
        return [np.empty(0, k) for k in kinds]


def rows_out(found):
    for bucket, blob in found:
        yield pa.RecordBatch.from_arrays([pa.array([bucket], pa.int32()), pa.array([blob], pa.binary())], ["bucket", "blob"])


def packed_rows(df: DataFrame, send) -> DataFrame:
    """The rows (bucket, blob) that send yields."""
    return arrow(df, lambda batches: rows_out(send(batches)), "bucket int, blob binary")


def received(df: DataFrame, receive, schema: str, n: int) -> DataFrame:
    return arrow(deal(df, n), lambda batches: receive([x for batch in batches for x in batch.column(1).to_pylist()]), schema)


def deduplicate(docs: DataFrame, folder: str, match: int = 50, batches: int = 4, with_text: bool = False) -> DataFrame:
    """Adds docs to a new family in ranges of doc_id, so that every smaller doc_id is there before; the rows of all.

    The rows are written; texts and levels go once they are.
    """
    spark, family = docs.sparkSession, SuffixFamily(docs.sparkSession, f"{folder}/family", match, with_text)
    docs = docs.select(F.col("doc_id").cast("long"), "text", *(["rest"] if with_text else []))
    steps = [k / batches for k in range(1, batches)]
    bounds = sorted(set(docs.agg(F.percentile_approx("doc_id", steps, 10_000)).first()[0] or [])) if steps else []
    edges = [None, *bounds, None]
    out = None
    for number, (low, high) in enumerate(zip(edges, edges[1:], strict=False)):
        keep = F.lit(True)
        if low is not None:
            keep = keep & ((F.col("doc_id") > low) | F.col("doc_id").isNull())
        if high is not None:
            keep = keep & (F.col("doc_id") <= high)
        rows = table(family.add(docs.filter(keep), with_text, last=number == len(bounds)), f"{folder}/rows-{number}")  # levels that later batches add don't concern them
        remove(family.scanned)
        release(spark)
        out = rows if out is None else out.unionByName(rows)
    remove(f"{folder}/family")
    return out


def cut(docs: DataFrame, folder: str, match: int = 50, batches: int = 4) -> DataFrame:
    """docs with the repeated bytes cut out of text, and n_chars, if there is one, counted anew; rows that lose their whole text go.

    The bytes of a character that was cut in two go as well. Other columns stay as they are.
    """
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    kept = deduplicate(docs.select("doc_id", "text", F.struct(*others or [F.lit(1).alias("none")]).alias("rest")), folder, match, batches, with_text=True)
    rows = kept.filter("n_removed < n_bytes or n_bytes = 0")
    own = {c: x.cast(docs.schema[c].dataType) for c, x in {"doc_id": F.col("doc_id"), "text": F.col("kept"), "n_chars": F.length("kept")}.items() if c in docs.columns}
    return rows.select(*[own.get(c, F.col("rest").getField(c) if c in others else None).alias(c) for c in docs.columns])
