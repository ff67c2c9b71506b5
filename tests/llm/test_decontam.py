"""Decontamination against all windows."""

import random
import re
from collections import Counter

import pytest

from quillspark.llm import decontam
from quillspark.llm.common import work_dir

from .helpers import awkward, documents, empty, prose

WORD = re.compile(r"[^\W_]+")


def shingles(own, k):
    return Counter(tuple(own[i : i + k]) for i in range(len(own) - k + 1))


def brute(docs, items, percent=80):
    out = {}
    for item, text in items:
        own = WORD.findall((text or "").lower())
        if not own:
            continue
        k, n = min(5, len(own)), len(own)
        want = shingles(own, k)
        for doc, text in docs:
            words = WORD.findall((text or "").lower())
            if not set(want) & set(shingles(words, k)):
                continue
            for s in range(len(words) - n + 1):
                c = sum((want & shingles(words[s : s + n], k)).values())
                if 100 * c >= percent * (2 * (n - k + 1) - c):
                    out[doc, item] = max(out.get((doc, item), (0, 0, 0)), (c / (2 * (n - k + 1) - c), -s, n))
    return {k: (v[0], -v[1], v[2]) for k, v in out.items()}


def found(docs, items, spark):
    rows = decontam.contaminated(docs, items, work_dir(spark, "t4")).collect()
    out = {(r.doc_id, r.item_id): (r.similarity, r.start_word, r.n_words) for r in rows}
    assert len(out) == len(rows)
    return out


def planted(seed):
    rng = random.Random(seed)
    items = [prose(seed * 50 + i, n) for i, n in enumerate([1, 2, 4, 5, 6, 9, 13, 14, 25, 40, 40, 60, 100, 130])] + ["again " * 12, "", None, "..."]
    texts = []
    for _ in range(60):
        own = prose(rng.randrange(10**6), rng.randint(0, 60)).split()
        item = (rng.choice(items) or "x").split()
        for _ in range(rng.randint(0, 3)):  # words changed, lost or added
            at = rng.randrange(len(item)) if item else 0
            item[at : at + rng.randint(0, 1)] = ["changed"] * rng.randint(0, 1)
        at = rng.randint(0, len(own))
        own[at:at] = item
        texts.append(rng.choice([" ", ", ", "\n"]).join(own).title() if rng.random() < 0.3 else " ".join(own))
    return items, [*texts, None, "", "again " * 40, items[9] + " and " + items[9]]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_against_all_windows(spark, monkeypatch, seed):
    if seed == 3:
        monkeypatch.setattr(decontam, "ITEMS", 4)
    items, texts = planted(seed)
    docs = documents(spark, texts)
    known = spark.createDataFrame([(i, t, 1) for i, t in enumerate(items)], "item_id long, text string, n int")
    want = brute(docs.select("doc_id", "text").collect(), list(enumerate(items)))
    got = found(docs, known, spark)
    assert {k: v[:2] for k, v in got.items()} == {k: v[:2] for k, v in want.items()} and len(want) > 20
    kept = decontam.clean(docs, known, work_dir(spark, "t4"))
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(range(len(texts))) - {d for d, _ in want}) and kept.columns == docs.columns


def test_table(spark, sf):
    docs, items = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet")
    want = brute(docs.select("doc_id", "text").collect(), items.select("item_id", "text").collect())
    assert {k: v[:2] for k, v in found(docs, items, spark).items()} == {k: v[:2] for k, v in want.items()} and want


def test_odd_tables(spark):
    items = spark.createDataFrame([(1, prose(1, 300)[:200]), (1, prose(1, 300)[:200]), (None, prose(4, 120)[:90])], "item_id long, text string")
    got = found(awkward(spark), items, spark)
    assert {d for d, i in got if i == 1} == {0, 1, 2, 9} - ({2} if (2, 1) not in got else set()) and (12, None) in got
    assert found(empty(spark), items, spark) == {} and found(awkward(spark), items.limit(0), spark) == {}


def test_recall_of_the_index_alone(spark):
    """Of all windows that are similar enough, those that fingerprints and blocks find, before anything is verified."""
    rng, items = random.Random(9), {i: prose(900 + i, n) for i, n in enumerate([30, 30, 30, 45, 45, 60, 60, 90, 90, 140])}
    texts = []
    for i in range(120):
        own = items[i % 10].split()
        for _ in range(max(1, round(len(own) * rng.uniform(0, 0.02)))):
            own[rng.randrange(len(own))] = f"w{rng.randrange(10**6)}"
        texts.append(" ".join([*prose(5000 + i, 30).split(), *own, *prose(7000 + i, 30).split()]))
    known = spark.createDataFrame(list(items.items()), "item_id long, text string")
    folder = work_dir(spark, "t4")
    rows = decontam.table(decontam.items(known, 5, 80), f"{folder}/items")
    long, short = decontam.anchors(rows)
    found = decontam.hits(documents(spark, texts), long.select("anchor").distinct())
    runs = decontam.stretches(found.join(long, "anchor"), f"{folder}/near")
    got = {(r.doc_id, r.item_id, r.start) for r in decontam.nearby(decontam.windows(runs), rows).join(rows.select("item", "item_id"), "item").collect()}
    want = set()
    for d, text in enumerate(texts):
        words = WORD.findall(text.lower())
        for i, item in items.items():
            own = item.split()
            k, n, shared = 5, len(own), shingles(own, 5)
            if len(set(words) & set(own)) > n // 2:
                for s in range(len(words) - n + 1):
                    c = sum((shared & shingles(words[s : s + n], k)).values())
                    if 100 * c >= 80 * (2 * (n - k + 1) - c):
                        want.add((d, i, s))
    assert len(want) > 300 and len(want & got) / len(want) >= 0.99


def test_long_items(spark):
    item = prose(31, 5000).split()
    changed = item[:]
    for at in range(40, 5000, 160):
        changed[at] = "changed"
    texts = [" ".join([*prose(32, 500).split(), *changed, *prose(33, 100).split()]), " ".join(item[600:]), " ".join(item[2500:] * 2), prose(34, 9000)]
    docs, known = documents(spark, texts), spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")
    rows = docs.select("doc_id", "text").collect()
    got = found(docs, known, spark)
    assert set(got) == {(0, 1), (1, 1)} and got[0, 1][1:] == (500, 5000) and got[1, 1] == brute_short(rows, [(1, " ".join(item))])[1, 1]


def test_columns_with_the_operators_names(spark):
    item = prose(1, 40)
    items = spark.createDataFrame([(1, item)], "item_id long, text string")
    docs = spark.createDataFrame([(1, item, 1, "a"), (2, prose(2, 50), 2, "b")], "doc_id long, text string, found int, _found string")
    assert list(map(tuple, decontam.clean(docs, items, work_dir(spark, "t4")).collect())) == [(2, prose(2, 50), 2, "b")]


def test_plan_has_no_python(spark, sf):
    docs, items = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet")
    plan = decontam.contaminated(docs, items, work_dir(spark, "t4"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_rows_are_judged_by_their_own_text(spark):
    item, other = prose(1, 40), prose(2, 60)
    items = spark.createDataFrame([(1, item)], "item_id long, text string")
    rows = [(None, item), (None, other), (None, None), (7, f"{other} {item}"), (7, other), (7, other), (8, item)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = decontam.clean(docs, items, work_dir(spark, "t4"))
    assert Counter(map(tuple, kept.collect())) == {(None, other): 1, (None, None): 1, (7, other): 2}


def brute_short(docs, items, percent=80):
    """Documents with fewer words than an item, as one window."""
    out = {}
    for item, text in items:
        own = WORD.findall((text or "").lower())
        k = min(5, len(own))
        for doc, text in docs:
            words = WORD.findall((text or "").lower())
            if own and len(words) < len(own):
                want, have = shingles(own, k), shingles(words, k)
                c, total = sum((want & have).values()), sum((want | have).values())
                if 100 * c >= percent * total:
                    out[doc, item] = (c / total, 0, len(words))
    return out


def test_documents_shorter_than_an_item(spark):
    rng = random.Random(5)
    items = [prose(700 + i, n) for i, n in enumerate([1, 4, 5, 8, 9, 10, 13, 14, 24, 25, 40, 60, 100, 130])] + ["again " * 12]
    texts = []
    for item in items:
        own = item.split()
        for cut in (1, 2, len(own) // 10, len(own) // 6, len(own) // 4):
            texts += [" ".join(own[cut:]), " ".join(own[: len(own) - cut]), " ".join(own[cut // 2 : len(own) - (cut + 1) // 2])]
            at = rng.randrange(len(own))
            texts.append(" ".join([*own[:at], *own[at + cut :]]))
    docs = documents(spark, [*texts, None, ""])
    known = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    rows, known_rows = docs.select("doc_id", "text").collect(), list(enumerate(items))
    want = brute(rows, known_rows) | brute_short(rows, known_rows)
    assert found(docs, known, spark) == want and len(brute_short(rows, known_rows)) > 80
    kept = decontam.clean(docs, known, work_dir(spark, "t4"))
    dirty = {(texts + [None, ""])[d] for d, _ in want}
    assert sorted(r.doc_id for r in kept.collect()) == [i for i, t in enumerate([*texts, None, ""]) if t not in dirty]
