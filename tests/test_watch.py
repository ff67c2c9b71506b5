"""Scans of a folder: each kind of change, a stop between the changes and the log, and the stream of changes."""

import shutil

from quillspark.sources.watch import Watch


def seen(own, number):
    short = lambda p: p and p.rsplit("/", 1)[-1]
    return {(r.kind, short(r.path), short(r.old_path)) for r in own.changes(number).collect()}


def test_changes_of_a_folder(spark, tmp_path):
    top, state = tmp_path / "in", (tmp_path / "state").as_uri()
    (top / "a").mkdir(parents=True)
    for name, content in (("1", b"one"), ("2", b"two"), ("3", b"three"), ("4", b"same"), ("5", b"same"), ("6", b"six"), ("9", b"")):
        (top / "a" / f"{name}.rm").write_bytes(content)
    (top / "a" / "1.txt").write_bytes(b"other")
    own = Watch(spark, top.as_uri(), state, buckets=4)
    assert own.scan() == 0
    assert seen(own, 0) == {("created", f"{i}.rm", None) for i in range(1, 7)}
    (top / "b").mkdir()
    (top / "a/1.rm").rename(top / "b/7.rm")
    (top / "a/2.rm").write_bytes(b"two and more")
    (top / "a/3.rm").unlink()
    (top / "a/4.rm").rename(top / "b/4.rm")
    (top / "a/5.rm").rename(top / "b/5.rm")  # two equal files: which is which can't be told
    (top / "b/8.rm").write_bytes(b"eight")
    own = Watch(spark, top.as_uri(), state, buckets=4)  # as after a restart
    assert own.scan() == 1
    want = {("renamed", "7.rm", "1.rm"), ("modified", "2.rm", None), ("deleted", "3.rm", None), ("created", "8.rm", None)}
    assert seen(own, 1) == want | {(k, f"{i}.rm", None) for k in ("deleted", "created") for i in (4, 5)}
    shutil.rmtree(tmp_path / "state/known/at=2")  # stopped before the log: the changes that were written hold
    (top / "b/8.rm").unlink()
    assert own.scan() == 1 and ("created", "8.rm", None) in seen(own, 1)
    assert own.scan() == 2 and seen(own, 2) == {("deleted", "8.rm", None)}
    assert own.scan() == 3 and seen(own, 3) == set()
    assert {r.path.rsplit("/in/", 1)[1] for r in own.known.view().collect()} == {"a/2.rm", "a/6.rm", "b/4.rm", "b/5.rm", "b/7.rm"}
    out = tmp_path / "out"
    own.stream().writeStream.format("parquet").option("path", str(out)).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start().awaitTermination(120)
    assert spark.read.parquet(str(out)).count() == 6 + 8 + 1


def test_a_file_that_comes_back_where_another_was(spark, tmp_path):
    top = tmp_path / "in"
    top.mkdir()
    (top / "x.rm").write_bytes(b"x")
    (top / "y.rm").write_bytes(b"yy")
    own = Watch(spark, top.as_uri(), (tmp_path / "state").as_uri(), buckets=2)
    own.scan()
    (top / "x.rm").rename(top / "z.rm")
    (top / "y.rm").rename(top / "x.rm")
    own.scan()
    assert seen(own, 1) == {("created", "z.rm", None), ("modified", "x.rm", None), ("deleted", "y.rm", None)}
    assert {r.path.rsplit("/", 1)[1] for r in own.known.view().collect()} == {"x.rm", "z.rm"}
