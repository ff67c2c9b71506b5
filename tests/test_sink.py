"""The sink: what is sent, and what is sent again after a failure."""

import json
from collections import Counter
from dataclasses import dataclass
from pathlib import Path

import pytest

from quillspark.sources import sink, targets


@dataclass
class Service(targets.Target):
    """Keeps a line of each item that it gets; fails once at an item if it is told to."""

    where: str
    breaks_at: str | None = None
    tells: bool = False
    name: str = "service"

    def check_duplicate(self, content_hash):
        return "known" if self.tells and content_hash in Path(self.where, "got").read_text().split() else None

    def sync(self, content_hash, item):
        broken = Path(self.where, "broken")
        if content_hash == self.breaks_at and not broken.exists():
            broken.touch()
            raise ConnectionError("gone")
        with Path(self.where, "got").open("a") as f:
            f.write(f"{content_hash}\n")
        return "success", f"x-{content_hash}", None

    def got(self):
        return Counter(Path(self.where, "got").read_text().split())


@pytest.fixture
def where(tmp_path):
    (tmp_path / "got").touch()
    return tmp_path


def rows(spark, names):
    return spark.createDataFrame([(n, i) for i, n in enumerate(names)], "content_hash string, content int")


@pytest.mark.parametrize(("tells", "batch"), [(False, 1), (True, 7)])
def test_a_job_that_fails_half_way_sends_nothing_twice(spark, where, tells, batch):
    names = [f"h{i}" for i in range(60)]
    service = Service(str(where), breaks_at="h31", tells=tells)
    how = {"folder": (where / "out").as_uri(), "job": "a", "rate": targets.Rate(per_minute=10**9, batch=batch)}
    with pytest.raises(Exception, match="gone"):
        sink.deliver(rows(spark, names), service, **how)
    before = service.got()
    assert before and not (where / "out/a/_committed").exists()
    got = sink.deliver(rows(spark, names), service, **how)
    assert service.got() == Counter(names)
    assert {r.content_hash for r in got.collect()} == set(names) and got.count() == 60
    assert json.loads((where / "out/a/_committed").read_text())["sent"] < 60
    sink.deliver(rows(spark, [*names, "late"]), service, **how)  # committed: nothing is sent, not even what is new
    assert service.got() == Counter(names)
    sink.deliver(rows(spark, [*names, "late", None, "late"]), service, **how | {"job": "b"})
    assert service.got() == Counter([*names, "late"])


def test_failed_items_are_sent_by_the_next_job(spark, where):
    names = [f"h{i}" for i in range(200)]
    root, bad = (where / "out").as_uri(), targets.MockTarget(fail_rate=0.2)
    first = {r.content_hash: r.status for r in sink.deliver(rows(spark, names), bad, root, "1").collect()}
    failed = {k for k, v in first.items() if v == "failed"}
    assert 0 < len(failed) < 200
    assert {r.content_hash for r in sink.deliver(rows(spark, names), targets.MockTarget(), root, "2").collect()} == failed
    assert {r.status for r in sink.results(spark, root).collect()} == {"success"}
    assert sink.deliver(rows(spark, []), bad, root, "3").count() == 0


def test_a_stream_that_stops_in_a_batch(spark, where):
    for i in range(3):
        rows(spark, [f"s{i}-{j}" for j in range(5)] + ["often"]).coalesce(1).write.mode("append").parquet(str(where / "in"))
    service = Service(str(where), breaks_at="s1-3")

    def run():
        stream = spark.readStream.schema("content_hash string, content int").option("maxFilesPerTrigger", 1).parquet(str(where / "in"))
        sink.deliver_stream(stream, service, (where / "out").as_uri(), str(where / "state"), rate=targets.Rate(per_minute=10**9, batch=1)).awaitTermination(120)

    with pytest.raises(Exception, match="gone"):
        run()
    run()
    assert service.got() == Counter([f"s{i}-{j}" for i in range(3) for j in range(5)] + ["often"])
