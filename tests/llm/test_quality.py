"""The two quality operators: counts against brute force, held-out accuracy, awkward rows."""

import re
import zlib
from collections import Counter

import numpy as np
import pytest

from quillspark.llm import quality, rules
from quillspark.llm.common import work_dir

from .helpers import awkward, documents, empty, prose, regular

WORD = re.compile("[^\x20\x09-\x0d]+")


def base(text):
    text = text or ""
    own = WORD.findall(text)
    windows = Counter(tuple(own[i : i + 5]) for i in range(len(own) - 4))
    covered = {j for i in range(len(own) - 4) if windows[tuple(own[i : i + 5])] > 1 for j in range(i, i + 5)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    failed = len(own) < 10 or 100 * len(covered) > 20 * len(own)
    return len(own), sum(map(len, own)), len(re.findall("[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered), failed


def odd_texts():
    again = "one two three four five six\n"
    return [None, "", "\n", "\n\n a", again * 3, again * 2 + again.strip(), "a b c d e a b c d e f", prose(1, 40) + "\n\n" + prose(1, 40), "x\ny\nx\n\nx", "[#] *é* <|>", "a\rb\x0bc\x85d", "z" * 5000, prose(9, 20000), again.strip(), "\nq\nq", "\n".join(regular()), "\n".join(regular(11)) + "\n" + regular(11)[0], " ".join([*regular(), "b c d e"] * 2)]


@pytest.mark.parametrize("kind", ["odd", "awkward", "empty", "table"])
def test_base_counts(spark, sf, kind):
    docs = {"odd": lambda s: documents(s, odd_texts()), "awkward": awkward, "empty": empty, "table": lambda s: s.read.parquet(f"{sf}/documents.parquet")}[kind](spark)
    got = Counter(tuple(r)[:-2] + (r.kept,) for r in rules.judge(docs, None).collect())
    assert got == Counter((r.doc_id, *(b := base(r.text)), not b[-1]) for r in docs.collect())


def labelled(sf, spark):
    return spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")


def test_rules_judge_held_out_rows(spark):
    docs, labels = labelled("/root/testdata/sf0.01", spark)
    verdicts = {r.doc_id: r for r in rules.judge(docs, rules.train(docs, labels)).collect()}
    rows = [(r.quality, verdicts[r.doc_id]) for r in labels.collect() if zlib.crc32(str(r.doc_id).encode()) % 3 == 1]
    assert np.mean([v.kept for q, v in rows if q == 0]) < 0.1
    assert np.mean([v.score >= 0.5 for q, v in rows if q == 1]) > 0.97


def test_classifier_on_held_out_rows(spark):
    docs, labels = labelled("/root/testdata/sf0.01", spark)
    scores = {r.doc_id: r for r in quality.classify(docs, labels, work_dir(spark, "t3")).collect()}
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in scores.values())
    rows = [(r.quality, scores[r.doc_id].predicted) for r in labels.collect() if scores[r.doc_id].held_out]
    assert len(scores) == docs.count() and np.mean([q == p for q, p in rows]) > 0.97


def plain_triples(text):
    out = []
    for a, b, c in zip(text, text[1:], text[2:], strict=False):
        x = sum(int.from_bytes(ch.encode(), "little") * k for ch, k in zip((a, b, c), (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D), strict=True)) & 0xFFFFFFFF
        x = (x ^ (x >> 15)) * 0x2C1B3C6D & 0xFFFFFFFF
        out.append((x >> (32 - rules.BITS)) + (2 << rules.BITS))
    return out


def test_rules_scores_are_those_of_their_ngrams(spark):
    """Each text's score from its own n-grams alone: words and pairs by the hash of their bytes, triples of characters."""
    from quillspark.llm.common import Substrings, grams, words

    docs, labels = labelled("/root/testdata/sf0.01", spark)
    model = rules.train(docs, labels)
    rows = docs.limit(150).unionByName(awkward(spark).select(docs.columns))
    got = Counter((r.doc_id, None if r.score is None else round(r.score, 9), r.kept) for r in rules.judge(rows, model).collect())
    want = Counter()
    for r in rows.collect():
        data = np.frombuffer((r.text or "").encode(), np.uint8)
        starts, ends, first = words(data, np.array([0, len(data)]))
        hashes = Substrings(data)(starts, ends) + (ends - starts).astype(np.uint64)
        pairs, _ = grams(hashes, first, 2)
        raw = model.bias
        for cells in ([int(x) >> (64 - rules.BITS) for x in hashes], [(int(x) >> (64 - rules.BITS)) + (1 << rules.BITS) for x in pairs], plain_triples(r.text or "")):
            raw += sum(float(model.weights[c]) for c in cells) / max(len(cells), 1)
        p = 1 / (1 + np.exp(-np.clip(model.slope * raw + model.shift, -40, 40)))
        want[r.doc_id, round(float(p), 9), bool(not base(r.text)[-1] and p >= 0.5)] += 1
    assert got == want


def test_classifier_scores_by_plain_recomputation(spark):
    """Normal equations, solution, pooled curve and scores from all rows at once."""
    docs, labels = labelled("/root/testdata/sf0.01", spark)
    got = {r.doc_id: r.score for r in quality.classify(docs, labels, work_dir(spark, "t3")).collect()}
    texts = {r.doc_id: (r.text or "").encode() for r in docs.collect()}
    x = {d: quality.statistics(np.frombuffer(t, np.uint8), np.array([0, len(t)]))[0] for d, t in texts.items()}
    fold = {0: [], 2: []}
    for r in labels.collect():
        rest = zlib.crc32(str(r.doc_id).encode()) % 3
        if rest in fold and r.doc_id in x and r.quality in (0, 1):
            fold[rest].append((x[r.doc_id], r.quality))
    a, y = np.array([v for v, _ in fold[0]]), np.array([q for _, q in fold[0]], float)
    model = quality.Model(a.mean(0), a.std(0))
    z = model.lift(a)
    model.weights = np.linalg.lstsq(np.vstack([z, 0.1 * np.eye(z.shape[1])]), np.concatenate([y, np.zeros(z.shape[1])]), rcond=None)[0]
    raw, q = model.raw(np.array([v for v, _ in fold[2]])), np.array([k for _, k in fold[2]], float)
    at = np.clip((raw + 0.5) / 2 * quality.BINS, 0, quality.BINS - 1).astype(int)
    bins = np.unique(at)
    ones, n = np.array([q[at == b].sum() for b in bins]), np.array([(at == b).sum() for b in bins], float)
    best = np.array([max(min(ones[i : j + 1].sum() / n[i : j + 1].sum() for j in range(k, len(bins))) for i in range(k + 1)) for k in range(len(bins))])
    heights = sorted(set(np.round(best, 12)))
    centre = [np.average((bins[np.isclose(best, h)] + 0.5) / quality.BINS * 2 - 0.5, weights=n[np.isclose(best, h)]) for h in heights]
    for d, own in x.items():
        assert abs(np.interp(model.raw(own[None])[0], centre, heights) - got[d]) < 1e-4


def test_pool_is_the_monotone_least_squares_fit():
    rng = np.random.default_rng(5)
    n = rng.integers(1, 9, 60)
    ones = rng.binomial(n, np.linspace(0.1, 0.9, 60))
    x, y = quality.pool(np.arange(60.0), ones.astype(float), n.astype(float))
    assert (np.diff(y) > 0).all()
    best = [max(min(ones[i : j + 1].sum() / n[i : j + 1].sum() for j in range(k, 60)) for i in range(k + 1)) for k in range(60)]
    assert np.allclose(sorted(set(np.round(best, 9))), np.round(y, 9))


@pytest.mark.parametrize("labels", [[], [(0, 1, 0)], [(0, 1, 0), (1, 0, 0), (2, None, 0), (None, 1, 0), (0, 1, 0), (99, 0, 1)]])
def test_odd_labels(spark, labels):
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    for docs in (awkward(spark), empty(spark)):
        n = docs.count()
        scored = quality.classify(docs, known, work_dir(spark, "t3")).collect()
        assert len(scored) == n and all(0 <= r.score <= 1 for r in scored)
        assert rules.judge(docs, rules.train(docs, known)).count() == n
