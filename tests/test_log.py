"""Logs of changes against dictionaries, and counts kept up with changes against counts taken anew."""

import random
from collections import Counter
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from quillspark.operators.pending import Pending
from quillspark.sources.log import ChangeLog

SCHEMA = "k string, n bigint"


def put(spark, log, rows, batch):
    log.put(spark.createDataFrame(rows, "k string, n bigint, at_ms bigint, out boolean"), batch, F.col("at_ms"), gone=F.col("out"))


def held(df):
    return {r.k: r.n for r in df.collect()}


def test_last_row_of_each_key(spark, tmp_path):
    rng, want = random.Random(1), {}
    log = ChangeLog(spark, tmp_path.as_uri(), ["k"], SCHEMA, buckets=8)
    assert held(log.view()) == {} and log.of(spark.createDataFrame([("a",)], "k string")).count() == 0
    for batch in range(5):
        rows = [(rng.choice([*"abcdefgh", None]), rng.randrange(100), at, rng.random() < 0.3) for at in range(6)]
        rows = rows if batch != 3 else []
        for again in range(2 if batch == 1 else 1):  # a batch that is written again replaces itself
            put(spark, log, rows, batch)
        for k, n, _, out in rows:
            want[k] = None if out else n
        want = {k: n for k, n in want.items() if n is not None}
        assert held(log.view()) == want
        if batch == 2:
            before = dict(want)
            log.compact(batch)
            assert [p.name for p in tmp_path.iterdir() if p.is_dir()] == ["at=5"]
    assert held(log.view(before=3)) == before
    assert held(log.of(spark.createDataFrame([("a",), (None,), ("zz",)], "k string"))) == {k: v for k, v in want.items() if k in ("a", None)}


def test_a_batch_writes_its_own_rows_and_reads_its_own_buckets(spark, tmp_path):
    log = ChangeLog(spark, tmp_path.as_uri(), ["k"], SCHEMA, buckets=16)
    put(spark, log, [(f"k{i}", i, 0, False) for i in range(1000)], 0)
    put(spark, log, [("k5", -5, 0, False), ("k6", -6, 0, False)], 1)
    assert spark.read.parquet(str(tmp_path / "at=2")).count() == 2
    found = log.of(spark.createDataFrame([("k5",)], "k string"))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan or "PartitionFilters: [bucket" in plan
    assert held(found) == {"k5": -5}
    with pytest.raises(ValueError, match="key"):
        ChangeLog(spark, tmp_path.as_uri(), ["other"], SCHEMA)


def test_a_batch_that_was_stopped_is_not_seen(spark, tmp_path):
    log = ChangeLog(spark, tmp_path.as_uri(), ["k"], SCHEMA, buckets=4)
    put(spark, log, [("a", 1, 0, False)], 0)
    put(spark, log, [("a", 2, 0, False)], 1)
    Path(tmp_path, "at=2", "_SUCCESS").unlink()
    assert held(log.view()) == {"a": 1}
    put(spark, log, [("a", 3, 0, False)], 1)
    assert held(log.view()) == {"a": 3}


def test_counts_kept_up_are_those_taken_anew(spark, tmp_path):
    rng, own = random.Random(2), Pending(spark, tmp_path.as_uri(), buckets=4)
    page, sync = {}, {}
    for batch in range(4):
        pages = [(f"p{rng.randrange(6)}", f"n{rng.randrange(2)}", rng.choice(["x", "y", None]), True, at) for at in range(5)] if batch != 2 else []
        syncs = [(f"p{rng.randrange(6)}", rng.choice("xy"), rng.randrange(50), 100 * batch + i) for i in range(4)]
        args = spark.createDataFrame(pages, "page_uuid string, notebook_uuid string, text_hash string, meant boolean, updated_ms bigint"), spark.createDataFrame(syncs, "page_uuid string, content_hash string, synced_ms bigint, id bigint")
        own.apply(*args, batch)
        if batch == 1:
            own.apply(*args, batch)  # run again after a stop
            own.compact(batch)
        for p, n, h, _, _ in pages:
            page[p] = (n, h)
        for p, h, ms, i in syncs:
            sync[p] = max(sync.get(p, (-1, -1, "")), (ms, i, h))
        state = lambda p, h: "NEVER_SYNCED" if p not in sync else "UP_TO_DATE" if sync[p][2] == h else "STALE"
        want = Counter((n, state(p, h)) for p, (n, h) in page.items() if h)
        assert {(r.notebook_uuid, r.state): r.pages for r in own.counts().collect()} == dict(want)
        assert {r.page_uuid for r in own.plan().collect()} == {p for p, (_, h) in page.items() if h and state(p, h) != "UP_TO_DATE"}
