"""The similarity join against all pairs."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from quillspark.llm import graph, jaccard
from quillspark.llm.common import work_dir

from .helpers import DOCS, awkward, documents, empty, prose, regular

WORD = re.compile("[^\x20\x09-\x0d]+")


def shingles(text, k):
    own = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(own)} if 0 < len(own) < k else {tuple(own[i : i + k]) for i in range(len(own) - k + 1)}


def brute(rows, k=3, percent=90):
    sets = [shingles(t, k) for _, t in rows]
    forest = graph.Forest(len(rows))
    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                forest.join(i, j)
    least = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            least[forest.find(i)] = min(doc, least.get(forest.find(i), doc))
    return Counter((doc, len(sets[i]), least.get(forest.find(i)) if sets[i] else doc) for i, (doc, _) in enumerate(rows))


def near(seed, n=120):
    """Chains and stars of edited copies about the threshold, of all sizes."""
    rng = random.Random(seed)
    out = [prose(seed * 1000 + i, rng.choice([1, 2, 3, 4, 8, 15, 30, 60, 140, 400])) for i in range(12)]
    while len(out) < n:
        own = rng.choice(out).split()
        for _ in range(rng.randint(0, max(1, len(own) // 50 + 1))):
            at = rng.randrange(len(own))
            own[at : at + rng.randint(0, 1)] = [rng.choice(["new", "other", f"w{rng.randrange(99)}"])]
        out.append(" ".join(own) if own else "x")
    return out + [x.upper() for x in out[:9]] + [None, "", " \n"]


@pytest.mark.parametrize(("seed", "k", "percent"), [(1, 3, 90), (2, 3, 90), (3, 5, 80), (4, 1, 50)])
def test_components_against_all_pairs(spark, seed, k, percent):
    docs = documents(spark, near(seed))
    got = Counter(map(tuple, jaccard.component_table(docs, work_dir(spark, "t8"), k, percent).collect()))
    assert got == brute(docs.select("doc_id", "text").collect(), k, percent)


def test_regular_words_do_not_collide(spark):
    one, two = regular()
    docs = documents(spark, [one, two, one.upper(), f"x {one} y z", f"x {two} y z", regular(11)[0], regular(11)[1]])
    got = Counter(map(tuple, jaccard.component_table(docs, work_dir(spark, "t8")).collect()))
    assert got == brute(docs.select("doc_id", "text").collect()) and len({c for _, _, c in got}) == 6


def test_large_families_are_cut_into_tiles(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "TILE", 8)
    docs = documents(spark, near(7, 160))
    got = Counter(map(tuple, jaccard.component_table(docs, work_dir(spark, "t8")).collect()))
    assert got == brute(docs.select("doc_id", "text").collect())


@pytest.mark.parametrize("kind", ["awkward", "empty", "table"])
def test_tables(spark, sf, kind):
    docs = {"awkward": awkward, "empty": empty, "table": lambda s: s.read.parquet(f"{sf}/documents.parquet")}[kind](spark)
    got = Counter(map(tuple, jaccard.component_table(docs, work_dir(spark, "t8")).collect()))
    assert got == brute(docs.select("doc_id", "text").collect())


def test_parts_meet_whenever_sets_are_linked():
    rng = np.random.default_rng(1)
    for _ in range(300):
        percent = int(rng.choice([80, 90]))
        n = int(rng.integers(1, 400))
        a = np.unique(rng.integers(0, 2**64, n, np.uint64, endpoint=False))
        b = np.unique(np.concatenate([a[rng.random(len(a)) > 0.06], rng.integers(0, 2**64, int(rng.integers(0, n // 20 + 1)), np.uint64)]))
        if len(b) and jaccard.linked(a, b, percent):
            mine, other = dict(jaccard.parts(a, percent)), dict(jaccard.parts(b, percent))
            assert any(len(np.intersect1d(mine[k], other[k])) for k in mine.keys() & other.keys())
            differ = int(np.bitwise_count(jaccard.bitmap(a) ^ jaccard.bitmap(b)).sum())
            assert differ <= len(np.setxor1d(a, b))


@pytest.mark.parametrize("percent", [80, 90])
def test_bitmaps_hold_for_large_sets(percent):
    rng = np.random.default_rng(3)
    common = rng.integers(0, 2**64, 700, np.uint64)
    sets = [np.unique(np.concatenate([common, rng.integers(0, 2**64, 1300, np.uint64)])) for _ in range(200)]
    sets += [np.unique(np.concatenate([sets[i][20:], rng.integers(0, 2**64, 20, np.uint64)])) for i in range(10)]
    tested: list[int] = []
    edges = jaccard.tile_links(sets, np.zeros(len(sets), np.int64), percent, tested=tested)
    assert sorted((min(x), max(x)) for x in edges) == [(i, 200 + i) for i in range(10)]
    assert sum(tested) <= 12  # of 21,945 pairs


def test_labels_are_not_compared_again():
    sets = [np.arange(i, i + 100, dtype=np.uint64) << np.uint64(40) for i in (0, 1, 2, 3)]
    edges = jaccard.tile_links(sets, np.zeros(4, np.int64), 90, np.array([7, 7, 7, 9]))
    assert len(edges) == 1 and 3 in edges[0]


def test_columns_with_the_operators_names(spark):
    a, b = prose(1, 300), prose(7, 200)
    docs = spark.createDataFrame([(1, a, 1, "x", True), (2, a, 2, "y", False), (3, b, 3, "z", True)], "doc_id long, text string, id_kept long, md5_kept string, stays boolean")
    assert sorted(map(tuple, jaccard.one_of_each(docs, work_dir(spark, "t8")).collect())) == [(1, a, 1, "x", True), (3, b, 3, "z", True)]


def test_one_of_each(spark):
    docs = documents(spark, near(5))
    kept = jaccard.one_of_each(docs, work_dir(spark, "t8"))
    found = brute(docs.select("doc_id", "text").collect(), 5, 80)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(d for d, n, c in found if n == 0 or d == c)
    assert jaccard.one_of_each(empty(spark), work_dir(spark, "t8")).count() == 0


def test_components_of_a_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (7, 7)], "a long, b long")
    assert dict(map(tuple, graph.components(edges, work_dir(spark, "g")).collect())) == {**dict.fromkeys(range(41), 0), 100: 100, 101: 100}


def test_one_row_of_each_component(spark):
    a, b, c, d = prose(1, 300), prose(7, 200), prose(9, 150), prose(11, 90)
    near = a.replace("a", "b", 2)
    rows = [(1, a), (1, a), (1, near), (2, near), (None, a), (3, b), (3, b), (4, a), (4, c), (None, d), (None, d), (None, "  "), (None, None), (5, ""), (5, "")]
    docs = spark.createDataFrame([(i, t, "en", f"src{k}", None, 7, 7, 7) for k, (i, t) in enumerate(rows)], DOCS).repartition(3)
    got = jaccard.one_of_each(docs, work_dir(spark, "t8"))
    kept = Counter((r.doc_id, r.text) for r in got.collect())
    of_a = {k: v for k, v in kept.items() if k[1] in (a, near)}
    assert list(of_a.values()) == [1] and {k[0] for k in of_a} == {1}
    assert {k: v for k, v in kept.items() if k not in of_a} == {(3, b): 1, (4, c): 1, (None, d): 1, (None, "  "): 1, (None, None): 1, (5, ""): 2}
    assert got.columns == docs.columns
