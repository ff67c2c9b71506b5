"""Intervals of trees against a walk in plain Python."""

import random

from pyspark.sql import functions as F

from quillspark.operators import tour


def walk(rows, late=()):
    """uuid -> (place, last, depth), by a stack."""
    known, kids, out = {u for u, _, _ in rows}, {}, {}
    for u, p, n in rows:
        kids.setdefault(p if p in known else None, []).append((u in late, n is not None, (n or "").lower(), u))
    stack, done = [(x[-1], 0) for x in sorted(kids.get(None, []), reverse=True)], []
    while stack:
        u, depth = stack.pop()
        out[u] = [len(done), len(done), depth]
        done.append(u)
        stack += [(x[-1], depth + 1) for x in sorted(kids.get(u, []), reverse=True)]
    parent = {u: p for u, p, _ in rows}
    for u in reversed(done):
        if parent[u] in out:
            out[parent[u]][1] = max(out[parent[u]][1], out[u][1])
    return {u: tuple(x) for u, x in out.items()}


def got(tree):
    return {r.uuid: (r.place, r["last"], r.depth) for r in tree.collect()}


def test_random_trees(spark, tmp_path):
    rng = random.Random(3)
    rows = [(f"u{i}", rng.choice([None, "nowhere", "trash"]) if rng.random() < 0.1 or not i else f"u{rng.randrange(i)}" if rng.random() < 0.6 else "u0", rng.choice(["a", "B", "b", "", None])) for i in range(300)]
    late = {u for u, p, _ in rows if p == "trash"}
    ring = [("x1", "x2", "a"), ("x2", "x1", "a"), ("x3", "x1", "a"), (None, None, "a")]
    tree = tour.intervals(spark.createDataFrame(rows + ring, "uuid string, parent string, name string"), tmp_path.as_uri(), tops_last=F.col("parent") == "trash")
    want = walk(rows, late)
    assert got(tree) == want and len(want) == 300
    roots = ["u0", "u5", "u7", "u250", "none"]
    found = {r.uuid for r in tour.below(tree, spark.createDataFrame([(r,) for r in roots], "uuid string")).collect()}
    assert found == {u for u, (at, *_) in want.items() if any(want[r][0] <= at <= want[r][1] for r in roots if r in want)}


def test_a_chain_of_ten_thousand(spark, tmp_path):
    rows = spark.range(10_000).select(F.concat(F.lit("n"), "id").alias("uuid"), F.when(F.col("id") > 0, F.concat(F.lit("n"), F.col("id") - 1)).alias("parent"), F.lit("x").alias("name"))
    tree = tour.intervals(rows, tmp_path.as_uri())
    assert tree.filter("uuid <> concat('n', place) or last <> 9999 or depth <> place").count() == 0 and tree.count() == 10_000


def test_no_rows(spark, tmp_path):
    tree = tour.intervals(spark.createDataFrame([], "uuid string, parent string, name string"), tmp_path.as_uri())
    assert tree.collect() == [] and tour.below(tree, tree).collect() == []
