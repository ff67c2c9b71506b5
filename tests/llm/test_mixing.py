"""The mix against plain Python: targets, keys, running sums and copies."""

import math
import re
from collections import Counter

import pytest
import xxhash
from pyspark.sql import functions as F

from quillspark.llm import mixing
from quillspark.llm.common import work_dir

from .helpers import awkward, documents, empty, prose

WORD = re.compile("[^\x20\x09-\x0d]+")


def goals(sizes, weights=(3, 1, 2), share=1.5, most=2.0):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    target, left, budget = {}, set(order), share * sum(sizes.values())
    while left:
        total = sum(weight[s] for s in left)
        over = {s for s in left if budget * weight[s] / total >= most * sizes[s]}
        if not over:
            return target | {s: budget * weight[s] / total for s in left}
        target |= {s: most * sizes[s] for s in over}
        budget -= sum(most * sizes[s] for s in over)
        left -= over
    return target


def draw(seed, doc_id, text):
    h = xxhash.xxh64_intdigest(seed.to_bytes(4, "little"), 42)
    if doc_id is not None:
        h = xxhash.xxh64_intdigest(doc_id.to_bytes(8, "little", signed=True), h)
    return h if text is None else xxhash.xxh64_intdigest(text.encode(), h)


def quality(text):
    own = WORD.findall(text)
    seen = Counter(tuple(own[i : i + 5]) for i in range(len(own) - 4))
    again = {j for i in range(len(own) - 4) if seen[tuple(own[i : i + 5])] > 1 for j in range(i, i + 5)}
    return max(0.05, 1 - len(again) / max(1, len(own))) * max(0.05, 1 - len(re.findall("[#*$%&|<>]", text)) / max(1, sum(map(len, own))))


def plain(rows, seed=1, **how):
    """rows: doc_id, source, text."""
    sizes = Counter()
    for _, source, text in rows:
        sizes[source] += len(WORD.findall(text or ""))
    target, out = goals(sizes, **how), []
    for source, size in sizes.items():
        wanted = math.floor(target[source] + 0.5)
        epochs = wanted // size if size else 0
        left = wanted - epochs * size
        own = sorted(((-math.log(((draw(seed, i, t) >> 11) + 0.5) / 2**53) / quality(t or ""), i, len(WORD.findall(t or ""))) for i, s, t in rows if s == source), key=lambda x: x[0])
        for _, i, n in own:
            out.append((i, source, n, size, epochs * n + max(0, min(n, left))))
            left -= n
    return target, Counter(out)


def several(spark):
    """A source with most rows, small ones, one without words, and rows that are equal."""
    texts = [prose(i, 5 + i % 40) + " #" * (i % 3) for i in range(150)] + [prose(1, 30)] * 20 + ["a b c d e f g h"] * 30
    rows = [(i % 170, "big" if i % 3 else ["é", "Z", "a", None, ""][i // 3 % 5], t) for i, t in enumerate(texts)] + [(500, "none", None), (501, "none", " "), (None, "a", "x y"), (None, "a", "x y"), (502, "once", prose(3, 700))]
    return spark.createDataFrame(rows, "doc_id long, source string, text string").withColumns({"row_": F.lit(1), "copy": F.lit(2), "Row": F.lit(3)}).repartition(5)


CASES = {"several": several, "awkward": awkward, "table": lambda s: s.read.parquet("/root/testdata/sf0.001/documents.parquet")}


@pytest.mark.parametrize("kind", CASES)
def test_mix(spark, kind):
    docs = CASES[kind](spark)
    got = mixing.mix(docs.select("doc_id", "source", "text"), work_dir(spark, "t12")).collect()
    target, want = plain([(r.doc_id, r.source, r.text) for r in docs.select("doc_id", "source", "text").collect()])
    assert Counter((r.doc_id, r.source, r.size, r.source_size, r.taken) for r in got) == want
    assert all(r.target == pytest.approx(target[r.source]) and r.taken <= 2 * r.size for r in got)
    for source, goal in target.items():
        assert abs(sum(r.taken for r in got if r.source == source) - goal) <= 0.5
    again = mixing.mix(docs.select("doc_id", "source", "text").repartition(2), work_dir(spark, "t12")).collect()
    assert Counter(r[1:] for r in again) == Counter(r[1:] for r in got)


def test_targets_are_shared_again(spark):
    for sizes in ({"a": 10, "b": 100, "c": 1000, "d": 10**6}, {"a": 5, "b": 0, None: 5}, {"a": 0}, {chr(97 + i): 3**i for i in range(15)}):
        order = sorted(sizes, key=lambda s: (s is None, s or ""))
        df = spark.createDataFrame([(s, float((3, 1, 2)[i % 3]), sizes[s]) for i, s in enumerate(order)], "source string, weight double, source_size long")
        got = {r.source: r.target for r in mixing.targets(df, 1.5 * sum(sizes.values()), 2.0).collect()}
        assert got == pytest.approx(goals(sizes))


def test_copies_are_what_was_planned(spark):
    docs = several(spark)
    got = mixing.mixed(docs, work_dir(spark, "t12")).collect()
    texts = {(r.doc_id, r.source, r.text) for r in docs.collect()}
    taken = Counter()
    assert list(got[0].asDict()) == ["doc_id", "source", "text", "row_", "copy", "Row", "copy_"]
    for r in got:
        assert r.text and any(t.startswith(r.text) for i, s, t in texts if (i, s) == (r.doc_id, r.source) and t)
        taken[r.doc_id, r.source] += len(WORD.findall(r.text))
    want = Counter()
    for (i, source, _, _, n), times in plain([(r.doc_id, r.source, r.text) for r in docs.collect()])[1].items():
        want[i, source] += n * times
    assert taken == +want


def test_better_documents_come_first(spark):
    """Of documents of one size, those whose words repeat are drawn less often than others."""
    rows = [(i, "s", prose(i, 40) if i % 2 else " ".join([prose(i, 8)] * 5)) for i in range(600)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, source string, text string"), work_dir(spark, "t12"), share=0.3).collect()
    once = [sum(r.taken for r in got if r.doc_id % 2 == k) for k in (0, 1)]
    assert sum(once) == 0.3 * 24000 and once[1] > 5 * once[0] > 0


def test_empty(spark):
    assert mixing.mix(empty(spark), work_dir(spark, "t12")).count() == 0
    assert mixing.mixed(empty(spark), work_dir(spark, "t12")).count() == 0
    assert mixing.mix(documents(spark, [None, "", " "]), work_dir(spark, "t12")).filter("taken = 0 and target = 0").count() == 3
