"""Both substring operators against brute force."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from quillspark.llm import chunks, suffixes
from quillspark.llm.common import work_dir

from .helpers import awkward, documents, empty, prose


def brute_suffixes(rows, match):
    first = {}
    for doc, text in rows:
        b = (text or "").encode()
        for i in range(len(b) - match + 1):
            s = b[i : i + match]
            d = float("inf") if doc is None else doc
            first[s] = min(d, first.get(s, d))
    out = Counter()
    for doc, text in rows:
        b = (text or "").encode()
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - match + 1):
            if first[b[i : i + match]] < (float("inf") if doc is None else doc):
                gone[i : i + match] = True
        kept = bytes(np.frombuffer(b, np.uint8)[~gone])
        spans = int((gone & ~np.append(False, gone[:-1])).sum()) if len(b) else 0
        out[doc, len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()] += 1
    return out


def spliced(seed, n=60):
    """Documents that share passages of all lengths about 50, some with shared neighbours, some periodic."""
    rng = random.Random(seed)
    pool = [prose(seed * 100 + i, 40) for i in range(6)] + ["ab" * 60, "z" * 130]
    texts = []
    for _ in range(n):
        parts = []
        for _ in range(rng.randint(1, 6)):
            source = rng.choice(pool)
            a = rng.randrange(len(source))
            parts.append(source[a : a + rng.randint(30, 90)] if rng.random() < 0.7 else prose(rng.randrange(10**6), 5))
        texts.append("".join(parts))
    return texts + texts[:5] + [t[1:] for t in texts[5:8]] + [None, "", "é" * 40, "é" * 40]


@pytest.mark.parametrize("batches", [1, 2, 3, 5, 8])
def test_suffixes_against_brute_force(spark, batches):
    docs = documents(spark, spliced(batches))
    got = Counter(map(tuple, suffixes.deduplicate(docs, work_dir(spark, "t7"), batches=batches).collect()))
    assert got == brute_suffixes(docs.select("doc_id", "text").collect(), 50)


def test_suffixes_of_odd_tables(spark):
    for docs in (awkward(spark), empty(spark)):
        got = Counter(map(tuple, suffixes.deduplicate(docs, work_dir(spark, "t7")).collect()))
        assert got == brute_suffixes(docs.select("doc_id", "text").collect(), 50)


def test_suffixes_of_the_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = Counter(map(tuple, suffixes.deduplicate(docs, work_dir(spark, "t7")).collect()))
    assert got == brute_suffixes(docs.select("doc_id", "text").collect(), 50)


def test_levels_grow_by_doubling(spark):
    family = suffixes.SuffixFamily(spark, work_dir(spark, "t7"))
    sizes = []
    for i in range(4):
        family.add(documents(spark, [prose(i, 30), "shared " * 20], first=10 * i)).count()
        sizes.append([n for n, _ in family.levels])
    assert sizes == [[1], [2], [2, 1], [4]]


def test_levels_keep_lexical_order_and_one_row_of_each_surroundings(spark):
    family = suffixes.SuffixFamily(spark, work_dir(spark, "t7"))
    passage = prose(5, 60)
    for i in range(3):
        family.add(documents(spark, [prose(10 * i + j, 40) + passage for j in range(6)], first=10 * i)).count()
    every = []
    for _, name in family.levels:
        for bucket in range(family.n):
            hi, lo, r, _, f, p, file = suffixes.part(family.store, name, bucket, suffixes.KINDS)
            assert list(zip(hi, lo, r, strict=True)) == sorted(zip(hi, lo, r, strict=True))
            every += f.tolist()
            for x, y, place, at in zip(hi.tolist(), lo.tolist(), p.tolist(), file.tolist(), strict=True):
                _, _, _, data, _ = next(family.store.read(at, [place >> 32]))
                own = bytes(data[place & 0xFFFFFFFF :][:12])
                assert (x, y) == (int.from_bytes(own[:8], "big"), int.from_bytes(own[8:], "big"))
    assert len(every) == len(set(every)) > 0


def test_only_batches_with_wanted_places_are_read(spark, monkeypatch):
    store = suffixes.TextStore(work_dir(spark, "t7"))
    files = store.append(documents(spark, [prose(i, 60000) for i in range(8)]).coalesce(1))
    assert len(list(store.batches(files[0]))) > 1
    seen, plain = [], type(store).batches

    def batches(self, file, which=None, columns=None):
        for number, batch in plain(self, file, which, columns):
            seen.append(number)
            yield number, batch

    monkeypatch.setattr(type(store), "batches", batches)
    count, text = suffixes.fetched(store, files[0], np.array([(1 << 32) + 500]), np.array([suffixes.RIGHT], np.uint8), 50)
    assert seen == [1] and count[0] == 20 and len(text[0]) == 69


def test_long_texts_are_indexed_in_pieces(monkeypatch):
    rows = [t.encode() for t in spliced(3, 80) if t]
    data, offsets = np.frombuffer(b"".join(rows), np.uint8), np.cumsum([0, *map(len, rows)])
    whole = [np.concatenate(x) for x in zip(*suffixes.suffixes(data, offsets, 50), strict=True)]
    monkeypatch.setattr(suffixes, "PIECE", 97)
    for a, b in zip(whole, zip(*suffixes.suffixes(data, offsets, 50), strict=True), strict=True):
        assert np.array_equal(a, np.concatenate(b))


def test_cut_keeps_other_columns_as_they_are(spark):
    rows = [(1, prose(1, 60), 7, "2024-05-06 07:08:09.123456", "x"), (2, "new words " + prose(1, 60), 8, "1999-01-01 00:00:00.000001", None), (3, prose(1, 60), 9, None, "z")]
    docs = spark.createDataFrame(rows, "doc_id int, text string, n_chars int, at string, rest string").selectExpr("doc_id", "text", "n_chars", "timestamp(at) as at", "rest", "named_struct('kept', array(1.5d), 'day', date(at)) as kept")
    got = suffixes.cut(docs, work_dir(spark, "t7"))
    assert got.dtypes == docs.dtypes
    want = {r.doc_id: r for r in docs.collect()}
    found = {r.doc_id: r for r in got.collect()}
    assert set(found) == {1, 2} and all((r.at, r.rest, r.kept) == (want[i].at, want[i].rest, want[i].kept) and r.n_chars == len(r.text) for i, r in found.items())


def brute_chunks(rows, least=48, most=256, bits=5):
    def cut(b):
        h, out, at = 0, [], 0
        marks = set()
        for i, x in enumerate(b):
            h = ((h << 1) + int(chunks.GEAR[x])) & 0xFFFFFFFF
            if h >> (32 - bits) == 0 and (i + 1 == len(b) or b[i + 1] & 0xC0 != 0x80):
                marks.add(i + 1)
        while at < len(b):
            stop = next((p for p in range(at + least, at + most) if p in marks), at + most)
            while stop < len(b) and b[stop] & 0xC0 == 0x80:
                stop += 1
            if stop > len(b) - least:
                stop = len(b)
            out.append(b[at:stop])
            at = stop
        return out

    found = sorted(((d is None, d or 0, i), cut((t or "").encode())) for i, (d, t) in enumerate(rows))
    seen, out = set(), Counter()
    for (null, doc, _), own in found:
        keep = []
        for x in own:
            keep.append(x not in seen)
            seen.add(x)
        kept = b"".join(x for x, k in zip(own, keep, strict=True) if k)
        size = sum(map(len, own))
        out[None if null else doc, size, len(own), keep.count(False), size - len(kept), sum(not k and (i == 0 or keep[i - 1]) for i, k in enumerate(keep)), hashlib.sha256(kept).hexdigest()] += 1
    return out


@pytest.mark.parametrize("kind", ["spliced", "empty", "table"])
def test_chunks_against_brute_force(spark, sf, kind):
    docs = {"spliced": lambda s: documents(s, spliced(8) + [prose(1, 500), prose(1, 500)[7:]]), "empty": empty, "table": lambda s: s.read.parquet(f"{sf}/documents.parquet")}[kind](spark)
    got = Counter(map(tuple, chunks.deduplicate(docs, work_dir(spark, "t9")).collect()))
    assert got == brute_chunks(docs.select("doc_id", "text").collect())


def test_chunks_resist_insertions_and_odd_rows(spark):
    base = prose(77, 800)
    rows = {r.doc_id: r for r in chunks.deduplicate(documents(spark, [base, base[:2000] + "inserted words " + base[2000:]]), work_dir(spark, "t9"), with_text=True).collect()}
    assert rows[0].n_removed == 0 and rows[0].kept == base and rows[1].n_removed > 0.9 * rows[1].n_bytes and "inserted" in rows[1].kept
    assert chunks.deduplicate(awkward(spark), work_dir(spark, "t9")).count() == awkward(spark).count()
