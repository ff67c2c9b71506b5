"""Hard negatives against all pairs in plain Python."""

import math
import random
from collections import Counter
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

from quillspark.llm import negatives, queries
from quillspark.llm.common import work_dir

SCHEMA = "id long, label int, vector array<float>, norm string, row int, file int"


def whole(v):
    return [math.floor(256 * x) for x in v]


def plain(rows, every, positives=5, negatives=10, low=30, high=90):
    rows = [(i, label, whole(v)) for i, label, v in rows if label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    place = lambda x: (-x[0], x[1] is None, x[1] or 0)
    out = []
    for a, (i, label, v) in enumerate(rows):
        if i is None or i % every:
            continue
        scores = [(sum(x * y for x, y in zip(v, w, strict=False)), j, other == label) for b, (j, other, w) in enumerate(rows) if a != b]
        for score, j, _ in sorted((x for x in scores if x[2]), key=place)[:positives]:
            fit = [x for x in scores if not x[2] and low * score <= 100 * x[0] <= high * score]
            out += [(i, j, r, n, score, s) for r, (s, n, _) in enumerate(sorted(fit, key=place)[:negatives], 1)]
    return Counter(out)


def vectors(n, norms, seed=1):
    """Of a few directions; norms: how many sizes the vectors have."""
    rng = random.Random(seed)
    centres = [[rng.gauss(0, 1) for _ in range(6)] for _ in range(3)]
    rows = []
    for i in range(n):
        size = 0.2 * (1 + rng.randrange(norms)) ** 2
        rows.append((i, rng.randrange(3), [size * (x + rng.gauss(0, 0.4)) for x in rng.choice(centres)]))
    return rows


def odd():
    rows = vectors(60, 3)
    rows += [(0, 1, None), (5, None, [1.0] * 6), (10, 1, [1.0, None]), (20, 1, [math.nan] * 6), (30, 2, [math.inf] + [0.0] * 5), (40, 1, []), (50, 0, [0.0] * 6), (None, 1, [1.0] * 6), (None, 2, [0.5] * 6)]
    rows += [(0, 1, [0.5] * 6), (0, 2, [0.5] * 6), (70, 1, [0.5] * 3), rows[7], rows[7], rows[10], (-20, 1, [-0.5] * 6), (80, 2, [-1e-9] * 6)]
    return rows


CASES = {"one_norm": lambda: [(i, y, [x / (sum(z * z for z in v) ** 0.5) for x in v]) for i, y, v in vectors(150, 1)], "norms": lambda: vectors(200, 9), "odd": odd, "one_label": lambda: [(i, 1, v) for i, _, v in vectors(30, 2)], "empty": list, "equal": lambda: [(i, i % 2, [0.5] * 4) for i in range(60)]}


@pytest.mark.parametrize("kind", CASES)
def test_all_pairs(spark, monkeypatch, kind):
    monkeypatch.setattr(negatives, "FILE", 12)
    monkeypatch.setattr(negatives, "BLOCK", 3)
    rows = spark.createDataFrame([(*r, "x", 1, 2) for r in CASES[kind]()], SCHEMA)
    stored = [(r.id, r.label, r.vector) for r in rows.collect()]  # as floats
    got = Counter(map(tuple, negatives.mine(rows, 10, work_dir(spark, "t11")).collect()))
    assert got == plain(stored, 10) and (got or kind in ("one_label", "empty", "equal"))


def test_norms_prune(spark, monkeypatch):
    """Of vectors of many norms, most buckets are never multiplied, and results stay whole. Run here, not in workers, to count."""
    rows = spark.createDataFrame([(*r, "x", 1, 2) for r in vectors(400, 20, seed=4)], SCHEMA).select("id", "label", "vector")
    stored, folder = [tuple(r) for r in rows.collect()], work_dir(spark, "t11")
    own = negatives.table(negatives.scaled(rows, 256.0).withColumn("row", F.monotonically_increasing_id()), f"{folder}/rows")
    wants = F.array(F.struct(F.lit(0).alias("number"), F.lit(negatives.LOW).cast("long").alias("low"), F.lit(negatives.HIGH).cast("long").alias("high")))
    names = lambda df, to, n: [r.file for r in negatives.filed(df, f"{folder}/{to}", n).orderBy(F.desc("top")).collect()]
    files, blocks = names(own.withColumn("wants", F.lit(None).cast(negatives.WANTS)), "files", 10), names(own.filter("id % 20 = 0").withColumn("wants", wants), "blocks", 2)
    monkeypatch.setattr(negatives, "BUCKET", 5)
    calls, scores = [], negatives.Rows.scores
    monkeypatch.setattr(negatives.Rows, "scores", lambda self, *a: calls.append(len(a[0])) or scores(self, *a))
    got = []
    for block in blocks:
        search = negatives.Search(negatives.Rows(block), True, 5)
        for file in files:
            search.scan(negatives.Rows(file))
        got += [(r["anchor_id"], r["id"], r["score"]) for r in search.found().to_pylist()]
    quantised, want = {i: (label, whole(v)) for i, label, v in stored}, []
    for i in range(0, 400, 20):
        near = sorted((-sum(x * y for x, y in zip(quantised[i][1], v, strict=True)), j) for j, (label, v) in quantised.items() if j != i and label == quantised[i][0])
        want += [(i, j, -s) for s, j in near[:5]]
    assert sorted(got) == sorted(want) and sum(calls) < 0.5 * 20 * 80


def test_large_numbers(spark):
    """Scores beyond 2**53 are exact; rows whose scores aren't longs take no part."""
    rows = [(i, i % 2, [2.0**21 + 256 * i, 3.0 + i]) for i in range(40)] + [(100, 1, [2.0**24, 0.0]), (200, 0, [3e38, 1.0])]
    docs = spark.createDataFrame([(*r, "x", 1, 2) for r in rows], SCHEMA)
    got = Counter(map(tuple, negatives.mine(docs, 10, work_dir(spark, "t11"), low=0, high=100).collect()))
    assert got == plain(rows[:40], 10, low=0, high=100) and got


def test_query_and_sql(spark, sf):
    con = duckdb.connect()
    for p in Path(sf).iterdir():
        con.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    want = con.sql(queries.oracle_sql()["op11_hard_negatives"])
    got = queries.op11_hard_negatives(spark, sf)
    assert got.columns == list(want.columns)
    assert Counter(map(tuple, got.collect())) == Counter(want.fetchall())
