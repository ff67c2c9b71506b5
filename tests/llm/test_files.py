"""Token records, web archives, shards and packing against plain recomputation."""

import gzip
import hashlib
import random
import struct
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow.parquet as pq
import pytest
from tokenizers import Tokenizer

from quillspark.llm import packing, queries, records, shards, tokens, warc
from quillspark.llm.common import work_dir

from .helpers import DOCS, awkward, documents, empty, prose


def ids_of(name, texts, end):
    t = Tokenizer.from_file(queries.tokenizer(name))
    return [np.array([*t.encode(x or "", add_special_tokens=False).ids, end], "<u4") for x in texts]


def slow_crc32c(data):
    crc = 0xFFFFFFFF
    for b in data:
        crc ^= b
        for _ in range(8):
            crc = crc >> 1 ^ (0x82F63B78 if crc & 1 else 0)
    return crc ^ 0xFFFFFFFF


def test_crc32c():
    assert records.crc32c([b"123456789"])[0] == 0xE3069283
    many = [bytes(range(256)) * k + b"abcd" for k in (0, 1, 2, 3, 7)] + [b"abcd", b"x" * 64, b"x" * 65]
    assert records.crc32c(many).tolist() == [slow_crc32c(x) for x in many]


@pytest.mark.parametrize(("name", "drops_space"), [("word_bpe_49k.json", True), ("byte_bpe_50k.json", False)])
def test_ids_are_the_librarys_own(name, drops_space):
    rng = random.Random(1)
    alphabet = [*"abzABZ 019.,'!-_\n\t\r\x0b\x0c\0\x1c\x1f\x85\xa0", "  ", "'s", "'ll", "'T", "İ", "ı", "é", "É", "ß", "ǅ", "ɏ", "ɐ", "²", "½", "ª", "µ", "\u0301", "\u0307", "–", "’", "…", "\u2009", "\u200b", "€", "😀", "👍🏽", "Σ", "ς", "\u212a", "한", "中", "<|endoftext|>", "<|startoftext|>", "<|", "VERİ.", "İ-", "ﬁ", "\u2028", "\u0345", "12", "🇩"]
    texts = ["".join(rng.choices(alphabet, k=rng.randint(0, 30))) for _ in range(20000)] + ["", "a<|startoftext|>b x", "a<|endoftext|>b", "word " * 3000]
    encoder, library = tokens.Encoder(queries.tokenizer(name), drops_space, most=3000), Tokenizer.from_file(queries.tokenizer(name))
    for i in range(0, len(texts), 500):
        want = [np.array(x.ids, "<u4").tobytes() for x in library.encode_batch(texts[i : i + 500], add_special_tokens=False)]
        assert encoder.encode(texts[i : i + 500]) == want


@pytest.mark.parametrize(("name", "drops_space"), [("word_bpe_49k.json", True), ("byte_bpe_50k.json", False)])
def test_every_character_in_contexts(name, drops_space):
    """Every code point up to U+052F and of the blocks that the pattern allows or borders on, in twelve contexts."""
    points = [*range(0x530), *range(0x1E00, 0x2100), *range(0x2190, 0x2200), *range(0x2C60, 0x2C80), *range(0xA720, 0xA800), *range(0x1F2F0, 0x1F710), 0xFB01, 0xFF21]
    contexts = ["%s", "a%s", "%sa", "a%sb", "A%sB", " %s", "%s ", "a %s b", "%s%s", "1%s2", "don't%s", "%s's\n"]
    encoder, library = tokens.Encoder(queries.tokenizer(name), drops_space), Tokenizer.from_file(queries.tokenizer(name))
    texts = [x.replace("%s", chr(i)) for i in points for x in contexts]
    for i in range(0, len(texts), 2000):
        own, want = encoder.encode(texts[i : i + 2000]), library.encode_batch(texts[i : i + 2000], add_special_tokens=False)
        wrong = [t for t, a, b in zip(texts[i : i + 2000], own, want, strict=True) if a != np.array(b.ids, "<u4").tobytes()]
        assert not wrong, wrong[:20]


def test_frames_round_trip_and_damage():
    bodies = [records.payload(5, np.array([1, 2, 3], "<u4").tobytes(), 2), records.payload(None, b"", 4)]
    joined = b"".join(records.frames(bodies))
    assert records.parse(joined) == (bodies, len(joined))
    assert records.parse(joined[:-1])[0] == bodies[:1]
    with pytest.raises(ValueError):
        records.parse(joined[:20] + b"\xff" + joined[21:])


@pytest.mark.parametrize("kind", ["awkward", "empty", "table"])
def test_token_records(spark, sf, kind):
    docs = {"awkward": awkward, "empty": empty, "table": lambda s: s.read.parquet(f"{sf}/documents.parquet")}[kind](spark)
    folder = work_dir(spark, "t1")
    parts = records.write_records(docs, folder, queries.tokenizer("word_bpe_49k.json"), 1)
    got = sorted(map(tuple, records.read_records(spark, folder, parts).select("start", "doc_id", "n_tokens", "ids_crc32").collect()))
    rows = sorted(docs.select("doc_id", "text").collect(), key=lambda r: (r[0] is not None, r[0] or 0, zlib.crc32((r[1] or "").encode())))
    want, start = [], 0
    for row, ids in zip(rows, ids_of("word_bpe_49k.json", [r[1] for r in rows], 1), strict=True):
        want.append((start, row[0], len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert got == want
    if parts:
        part, n, _ = parts[-1]
        doc_id, ids = records.read_at(folder, part, [n - 1])[0]
        assert (doc_id, len(ids)) == (want[-1][1], want[-1][2])


def test_ids_of_four_bytes():
    wide = np.array([70000, 3], "<u4")
    assert records.unpack(records.payload(5, wide.tobytes(), 4))[1].tolist() == [70000, 3]
    with pytest.raises(ValueError):
        records.payload(5, wide.tobytes(), 2)


def test_page_ids_survive():
    for x in (0, 1, 2**62, 2**63 - 1, -1, -(2**63)):
        assert warc.page_of(warc.record_id(x)) == x
    assert warc.page_of(warc.record_id(None, "a")) is None


def test_archives(spark):
    big, other = "<p>" + "é" * 600, "<b>" + "z" * 1000
    rows = [(1, "u1", big), (2, "u2", big), (3, None, big), (4, "u", "small"), (5, "u", "small"), (6, "u\r\nx", None), (7, "u", other), (7, "u", other), (None, "u", big), (8, "", ""), (-3, "u", other)]
    pages = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, sha1 string")
    folder = work_dir(spark, "t2")
    got = warc.read_archives(spark, folder, warc.write_archives(pages, folder)).collect()
    best = defaultdict(lambda: None)
    for page_id, _, html in rows:
        if page_id is not None and len((html or "").encode()) >= 1000:
            best[html] = max(page_id, best[html] or page_id)
    want = Counter()
    for page_id, _, html in rows:
        b, to = (html or "").encode(), best[html]
        to = to if to is not None and page_id is not None and page_id != to else None
        want[page_id, len(b), hashlib.sha1(b).hexdigest(), "response" if to is None else "revisit", to, b if to is None else b""] += 1
    assert Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to, bytes(r.payload)) for r in got) == want
    many = spark.range(400).selectExpr("id as page_id", "'u' as url", f"if(id % 3 = 0, '{big}', concat('{other}', id % 5)) as html").repartition(7)
    folder = work_dir(spark, "t2")
    kinds = Counter((r.record_type, r.refers_to) for r in warc.read_archives(spark, folder, warc.write_archives(many, folder)).collect())
    assert kinds[("response", None)] == 6 and kinds[("revisit", 399)] == 133 and sum(kinds.values()) == 400
    empty_folder = work_dir(spark, "t2")
    assert warc.read_archives(spark, empty_folder, warc.write_archives(pages.limit(0), empty_folder)).count() == 0


def test_archives_of_the_table(spark, sf):
    pages, folder = spark.read.parquet(f"{sf}/pages.parquet"), work_dir(spark, "t2")
    rows = pages.select("page_id", "html").collect()
    best = {}
    for page, html in rows:
        best[html] = max(page, best.get(html, page))
    want = Counter()
    for page, html in rows:
        b = (html or "").encode()
        to = best[html] if len(b) >= 1000 and best[html] != page else None
        want[page, len(b), hashlib.sha1(b).hexdigest(), "response" if to is None else "revisit", to] += 1
    got = warc.read_archives(spark, folder, warc.write_archives(pages, folder)).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    assert Counter(map(tuple, got.collect())) == want


def test_hilbert_is_a_curve(spark):
    from pyspark.sql import functions as F

    for n, bits in ((2, 3), (3, 2), (4, 2)):
        side = 2**bits
        points = spark.range(side**n).select(*[F.expr(f"(id div {side**i}) % {side}").alias(f"c{i}") for i in range(n)])
        walk = sorted((r[-1], r[:-1]) for r in map(tuple, points.select("*", shards.hilbert([F.col(f"c{i}") for i in range(n)], bits)).collect()))
        assert [x for x, _ in walk] == list(range(side**n))
        assert all(sum(abs(a - b) for a, b in zip(p, q, strict=True)) == 1 for (_, p), (_, q) in zip(walk, walk[1:], strict=False))


@pytest.mark.parametrize("kind", ["awkward", "empty", "table"])
def test_shards(spark, sf, kind):
    docs = {"awkward": awkward, "empty": empty, "table": lambda s: s.read.parquet(f"{sf}/documents.parquet")}[kind](spark)
    rows = shards.hilbert_shards(docs, ["lang", "source", "n_chars", "doc_id"], work_dir(spark, "t5")).collect()
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in rows) == Counter((r.doc_id, len((r.text or "").encode()) + 1, zlib.crc32((r.text or "").encode())) for r in docs.collect())
    slots = defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
    assert all(sorted(x) == list(range(len(x))) for x in slots.values()) and set(slots) <= set(range(16))
    if rows:
        counts = [len(slots[k]) for k in range(16)]
        assert max(counts) - min(counts) <= 1
        curves = [[r.curve for r in rows if r.shard == k] for k in range(16)]
        curves = [x for x in curves if x]
        assert all(max(a) <= min(b) for a, b in zip(curves, curves[1:], strict=False))


def test_plan_is_whole_and_tight():
    rng = np.random.default_rng(3)
    for capacity in (30, 100):
        for _ in range(40):
            lengths = rng.integers(1, capacity + 1, rng.integers(1, 300))
            counts = Counter(map(int, lengths))
            found, patterns = Counter(), packing.plan(counts, capacity)
            for many, pattern in patterns:
                assert 0 < sum(a * b for a, b in pattern) <= capacity and many > 0
                assert sum(b for a, b in pattern if 3 * a > capacity) <= 2
                for a, b in pattern:
                    found[a] += many * b
            assert found == counts
            bound = max(-(-int(lengths.sum()) // capacity), int((lengths > capacity / 2).sum()))
            assert sum(m for m, _ in patterns) <= 11 / 9 * bound + 2


@pytest.mark.parametrize("kind", ["awkward", "empty", "table"])
def test_packing(spark, sf, kind):
    docs = {"awkward": awkward, "empty": empty, "table": lambda s: s.read.parquet(f"{sf}/documents.parquet")}[kind](spark)
    found = packing.pieces(docs, queries.tokenizer("byte_bpe_50k.json"), 0, 2048)
    rows = packing.pack(found, work_dir(spark, "t6"), 2048).collect()
    texts = docs.select("doc_id", "text").collect()
    want = Counter()
    for row, ids in zip(texts, ids_of("byte_bpe_50k.json", [r[1] for r in texts], 0), strict=True):
        first = len(ids) % 2048 or 2048
        for k, (a, b) in enumerate(zip([0, *range(first, len(ids), 2048)], range(first, len(ids) + 1, 2048), strict=True)):
            want[row[0], k, a, b - a, zlib.crc32(ids[a:b].tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    bins = defaultdict(list)
    for r in rows:
        bins[r.sequence_id].append((r.offset, r.length))
    for own in bins.values():
        end = 0
        for offset, length in sorted(own):
            assert offset == end
            end += length
        assert end <= 2048
    if rows:
        assert len(bins) <= 1.1 * sum(r.length for r in rows) / 2048 + 2


def test_packing_keeps_ids(spark):
    docs = documents(spark, [prose(5, 900), "short"])
    found = packing.pieces(docs, queries.tokenizer("byte_bpe_50k.json"), 0, 256, keep_ids=True)
    for r in packing.pack(found, work_dir(spark, "t6"), 256).collect():
        assert len(r.ids) == r.length and zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32


def test_archive_is_plain_warc(spark):
    data = warc.record(1, "http://a", b"<p>", hashlib.sha1(b"<p>").hexdigest(), None)
    assert data.startswith(b"WARC/1.1\r\nWARC-Type: response\r\n") and data.endswith(b"<p>\r\n\r\n")
    assert struct.pack("<Q", 3) and gzip.decompress(gzip.compress(data)) == data


def test_a_box_is_in_few_files(spark):
    rng = random.Random(8)
    rows = [(i, prose(i, 5), rng.choice(["de", "en", "fr", "it"]), f"https://example.org/source/{rng.randrange(40):02d}", rng.randrange(10_000), 0, 0, 0) for i in range(4000)]
    docs = spark.createDataFrame(rows, DOCS)
    assert shards.common(docs, ["lang", "source", "n_chars"]) == {"lang": 0, "source": len("https://example.org/source/")}
    folder = work_dir(spark, "t5")
    shards.hilbert_shards(docs, ["lang", "source", "n_chars"], folder)
    files = [pq.ParquetFile(p.removeprefix("file:").replace("%3A", ":")).metadata for p in spark.read.parquet(f"{folder}/shards").inputFiles()]

    def reach(meta, column):
        at = next(i for i in range(meta.num_columns) if meta.schema.column(i).path == column)
        found = [meta.row_group(g).column(at).statistics for g in range(meta.num_row_groups)]
        return min(x.min for x in found), max(x.max for x in found)

    def read(box):  # by what statistics can't rule out
        return sum(m.num_rows for m in files if all(reach(m, c)[0] <= high and low <= reach(m, c)[1] for c, (low, high) in box.items())) / len(rows)

    one = "https://example.org/source/07"
    assert read({"lang": ("de", "de"), "n_chars": (0, 2500)}) <= 0.35
    assert read({"source": (one, one)}) <= 0.6 and read({"lang": ("it", "it"), "source": (one, one), "n_chars": (9000, 9999)}) <= 0.2


def test_shards_hold_whole_rows(spark):
    rows = [(i % 40 if i % 5 else None, prose(i % 50, 30), "en", f"src{i % 3}", i, 7, 3, i) for i in range(160)] + [(None, None, None, None, None, 1, 1, 1), (9, "twice", "de", "s", 5, 7, 7, 7), (9, "twice", "de", "s", 5, 7, 7, 7), (9, "other", "de", "s", 5, 7, 7, 7)]
    docs = spark.createDataFrame(rows, DOCS).repartition(3)
    folder = work_dir(spark, "t5")
    placed = shards.hilbert_shards(docs, ["lang", "source", "n_chars", "doc_id"], folder)
    files = spark.read.parquet(f"{folder}/shards")
    assert Counter(map(tuple, files.select(*docs.columns).collect())) == Counter(rows)
    assert len([x for x in files.inputFiles() if "shard_=" in x]) >= 16
    want = Counter((r.doc_id, len((r.text or "").encode()) + 1, zlib.crc32((r.text or "").encode()), r.curve, r.shard_, r.slot) for r in files.collect())
    assert Counter(map(tuple, placed.collect())) == want
    assert len({(r.shard_, r.slot) for r in files.collect()}) == len(rows)
