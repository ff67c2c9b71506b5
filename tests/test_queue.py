"""The queue: order, batches, and a stop in the middle of one."""

import random

import pytest
from pyspark.sql import functions as F

from quillspark.operators import queue
from quillspark.sources import sink, targets


def test_batches_in_order_and_a_stop(spark, tmp_path):
    rows = [(i, random.Random(i).randrange(5)) for i in range(47)]
    own = queue.admit(spark.createDataFrame(rows, "id long, at long"), ["at", "id"], tmp_path.as_uri())
    want = [i for i, _ in sorted(rows, key=lambda r: (r[1], r[0]))]
    assert [(r.id, r.place, r.batch) for r in own.orderBy("place").collect()] == [(x, n, n // 10) for n, x in enumerate(want)]
    got, root = [], (tmp_path / "sent").as_uri()

    def handle(batch, number):
        items = batch.select(F.col("id").cast("string").alias("content_hash"))
        sink.deliver(items, targets.MockTarget(), root, f"batch-{number}")
        if number == 2 and not any(n == 2 for n, _ in got):
            got.append((2, []))
            raise ConnectionError("stopped after it sent")
        got.append((number, [r.id for r in batch.collect()]))

    assert queue.drain(own, tmp_path.as_uri(), handle, most=1) == 1
    with pytest.raises(ConnectionError):
        queue.drain(own, tmp_path.as_uri(), handle)
    assert queue.drain(own, tmp_path.as_uri(), handle) == 3
    assert queue.drain(own, tmp_path.as_uri(), handle) == 0
    assert [x for _, ids in got for x in ids] == want and [n for n, _ in got] == [0, 1, 2, 2, 3, 4]
    assert sink.results(spark, root).count() == 47
    lines = [x for p in (tmp_path / "sent").rglob("*.json") for x in p.read_text().splitlines()]
    assert len(lines) == 47  # nothing was sent twice


def test_no_rows(spark, tmp_path):
    own = queue.admit(spark.createDataFrame([], "id long"), ["id"], tmp_path.as_uri())
    assert own.collect() == [] and queue.drain(own, tmp_path.as_uri(), lambda *_: None) == 0
