"""Keyed state of streams against the same rows in one table, over restarts."""

import random
from datetime import datetime, timedelta

import pytest

from quillspark.streaming import files, spaced

START = datetime(2024, 1, 1)


def plain(rows, gap, strict=False):
    """rows: key, second, tie."""
    out, last = set(), {}
    for k, at, tie in sorted(rows, key=lambda r: r[1:]):
        if k not in last or (at - last[k] > gap if strict else at - last[k] >= gap):
            last[k] = at
            out.add((k, at, tie))
    return out


def write(spark, path, rows):
    spark.createDataFrame([(k, START + timedelta(seconds=s), t) for k, s, t in rows], "k string, ts timestamp, tie long").coalesce(1).write.mode("append").parquet(str(path))


def step(spark, tmp_path, **how):
    """Starts the query anew from its checkpoint, and ends it when all files are read."""
    stream = spark.readStream.schema("k string, ts timestamp, tie long").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out = spaced.spaced(stream, ["k"], "ts", "tie", **how)
    out.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination(120)
    return {(r.k, int((r.ts - START).total_seconds()), r.tie) for r in spark.read.schema(out.schema).parquet(str(tmp_path / "out")).collect()}


@pytest.mark.parametrize("strict", [False, True])
def test_any_order_of_batches(spark, tmp_path, strict):
    rng = random.Random(strict)
    rows = [(rng.choice(["a", "a", "a", "b", "c", None]), rng.randrange(300), i) for i in range(120)]
    rng.shuffle(rows)
    for i in range(0, 120, 40):
        write(spark, tmp_path / "in", rows[i : i + 40])
        got = step(spark, tmp_path, gap_us=10_000_000, strict=strict, late="10 minutes")
    assert got == set()  # all are within the watermark
    write(spark, tmp_path / "in", [("end", 5000, 999)])
    assert step(spark, tmp_path, gap_us=10_000_000, strict=strict, late="10 minutes") == plain(rows, 10, strict)


def test_state_is_empty_after_quiet(spark, tmp_path):
    write(spark, tmp_path / "in", [("a", 0, 1), ("a", 3, 2), ("b", 1, 3)])
    step(spark, tmp_path, gap_us=5_000_000, late="1 second")
    write(spark, tmp_path / "in", [("z", 40, 4)])
    assert step(spark, tmp_path, gap_us=5_000_000, late="1 second") == {("a", 0, 1), ("b", 1, 3)}
    load = lambda name: {r[0].k for r in spark.read.format("statestore").option("path", str(tmp_path / "state")).option("stateVarName", name).load().select("key").collect()}
    assert load("last") == {"a", "b"}
    write(spark, tmp_path / "in", [("z", 400, 5)])
    step(spark, tmp_path, gap_us=5_000_000, late="1 second")
    write(spark, tmp_path / "in", [("z", 401, 6)])
    step(spark, tmp_path, gap_us=5_000_000, late="1 second")
    assert load("last") <= {"z"}


def test_late_rows_are_dropped(spark, tmp_path):
    write(spark, tmp_path / "in", [("a", 1000, 1)])
    step(spark, tmp_path, gap_us=5_000_000, late="10 seconds")
    write(spark, tmp_path / "in", [("a", 500, 2), ("a", 995, 3), ("a", 2000, 4)])
    step(spark, tmp_path, gap_us=5_000_000, late="10 seconds")
    write(spark, tmp_path / "in", [("b", 9000, 5)])
    assert step(spark, tmp_path, gap_us=5_000_000, late="10 seconds") == {("a", 995, 3), ("a", 1000, 1), ("a", 2000, 4)}


def test_changes_stored_by_a_stream_are_those_of_the_table(spark, sf):
    from quillspark.plans import streams

    got = {r.id for r in streams.g1_dedup_stream(spark, sf).collect()}
    from quillspark.plans import notes

    assert got == {r.id for r in notes.g1_dedup(spark, sf).collect()} and got
    assert files.passing([], None, None) == ([], None)
