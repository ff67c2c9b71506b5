"""What a review of the third round found."""

import hashlib
import random
from collections import Counter
from datetime import datetime, timedelta
from pathlib import Path

import duckdb
import numpy as np
import pandas as pd
import pytest

from quillspark.operators import windows
from quillspark.plans import devices, registry
from quillspark.sources import drawing, listing, notebooks, watch
from quillspark.streaming import files, spaced

START = datetime(2024, 1, 1)


def against(spark, sf_dir, name):
    """Rows of the query and of its SQL."""
    con = duckdb.connect()
    for p in Path(sf_dir).iterdir():
        con.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}{'/*.parquet' if p.is_dir() else ''}'")
    got, want = registry.queries()[name](spark, sf_dir), con.sql(registry.oracle_sql()[name])
    order = sorted(got.columns)
    assert order == sorted(want.columns)
    rows = lambda columns, all_: Counter(tuple(dict(zip(columns, r, strict=True))[c] for c in order) for r in all_)
    return rows(got.columns, map(tuple, got.collect())), rows(want.columns, want.fetchall())


def test_plan_counts_with_odd_texts(spark, tmp_path):
    texts = [None, "", "Call Anna about the report", "!!", "Buy milk"]
    rows = [(i, texts[i % 5 if i % 3 else 2], "en", "web", 1) for i in range(2000)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    got, want = against(spark, str(tmp_path), "t3_plan_counts")
    assert got == want and len(got) == 2


def test_lock_over_many_years(spark, tmp_path):
    """Twenty-three years of notebooks, in any order: none of the changes is late."""
    rows = [(c, t, "user", f"text {c} {t}") for c in range(1, 100_000, 2501) for t in range(4)]
    random.Random(1).shuffle(rows)
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    got, want = against(spark, str(tmp_path), "r3_lock")
    assert got == want and len(got) > 50


def test_bursts_end_at_the_quiet_time(spark):
    rows = [("a", START + timedelta(seconds=s)) for s in (0, 29, 59, 60, 90, 200)] + [("a", START + timedelta(seconds=229, microseconds=999_999))]
    got = files.debounced(spark.createDataFrame(rows, "k string, ts timestamp"), "k", quiet_seconds=30).collect()
    assert sorted((r.first - START).total_seconds() for r in got) == [0, 59, 90, 200] and sorted(r.n for r in got) == [1, 2, 2, 2]


@pytest.mark.parametrize("strict", [False, True])
def test_sessions_decide_as_keyed_state_does(spark, tmp_path, strict):
    rng = random.Random(strict)
    rows = [(rng.choice(["a", "a", "a", "b", "c", None]), rng.randrange(400), i) for i in range(150)]
    own = spark.createDataFrame([(k, START + timedelta(seconds=s), t) for k, s, t in rows], "k string, ts timestamp, tie long")
    got = spaced.replayed(spark, own, "ts", lambda stream, late: spaced.apart(stream, ["k"], "ts", "tie", 10_000_000, strict, late), 10_000_000)
    want, last = set(), {}
    for k, at, tie in sorted(rows, key=lambda r: r[1:]):
        if k not in last or at - last[k] >= 10 + strict:  # whole seconds
            last[k] = at
            want.add((k, at, tie))
    assert {(r.k, int((r.ts - START).total_seconds()), r.tie) for r in got.collect()} == want
    assert spaced.replayed(spark, own.limit(0), "ts", lambda stream, late: spaced.apart(stream, ["k"], "ts", "tie", 10_000_000, strict, late), 10_000_000).count() == 0


def test_listing_is_that_of_spark_with_few_tasks(spark, tmp_path):
    top = tmp_path / "a device"
    for i in range(300):
        (top / f"nb-{i}" / "deep er").mkdir(parents=True)
        (top / f"nb-{i}" / "x y.rm").write_bytes(b"x" * (i + 1))
        (top / f"nb-{i}" / "deep er" / f"{i}.rm").write_bytes(b"" if i % 2 else b"y")
    for name in ("_hidden.rm", ".hidden.rm", "other.txt"):
        (top / name).write_bytes(b"z")
    want = spark.read.format("binaryFile").option("pathGlobFilter", "*.rm").option("recursiveFileLookup", "true").load(str(top)).collect()
    spark.sparkContext.setJobGroup("listing", "listing")
    got = {}
    for root in (str(top), top.as_uri()):
        listed = listing.listing(spark, root, "*.rm")
        got[root] = {(r.path, r.length, r.content) for r in listing.read(listed, root).collect()}
    tracker, jobs = spark.sparkContext.statusTracker(), spark.sparkContext.statusTracker().getJobIdsForGroup("listing")
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    n = sum(tracker.getStageInfo(s).numTasks for j in jobs for s in tracker.getJobInfo(j).stageIds)
    assert all(x == {(r.path, r.length, bytes(r.content)) for r in want} for x in got.values()) and len(want) == 450 and n < 300
    assert {r.path.rsplit("/", 1)[1] for r in listing.listing(spark, str(top), deep=False).collect()} == {"other.txt"}


def test_kinds_are_read_once_for_all_batches(spark, sf, monkeypatch):
    """Routing joins each micro-batch with a written table, not with a scan of the folder."""
    seen, own = [], files.route
    monkeypatch.setattr(files, "route", lambda events, kinds, *rest: seen.append(kinds.inputFiles()) or own(events, kinds, *rest))
    got, want = against(spark, sf, "r4_routing")
    assert got == want and seen and all(p.endswith(".parquet") and "/kinds-" in p for p in seen[0])


def test_todos_are_joined_without_their_texts(spark, sf):
    plan = registry.queries()["c10_todos_enriched"](spark, sf)._jdf.queryExecution().optimizedPlan().toString().splitlines()
    joins = [i for i, line in enumerate(plan) if "Join" in line]
    assert joins and not any("sha2" in line for line in plan[: joins[0] + 1])


def test_pieces_far_from_the_threshold_are_not_scored(monkeypatch):
    rng, real, scored = random.Random(4), windows.Needle.common, []
    monkeypatch.setattr(windows.Needle, "common", lambda self, known, start, size, each=False: scored.append(0 if each else len(start)) or real(self, known, start, size, each))
    words = ["".join(rng.choices("etaoinshr", k=rng.randint(2, 8))) for _ in range(150)]
    cases = [(" ".join(rng.choices(words, k=12)).replace("e", "c"), " ".join(rng.choices(words, k=120))) for _ in range(25)]
    found = {}
    for apart in (1, 6):
        scored.clear()
        monkeypatch.setattr(windows, "APART", apart)
        found[apart] = [windows.best(n, t, 65) for n, t in cases], sum(scored)
    assert found[1][0] == found[6][0] and found[6][1] - sum(b.verified for b in found[6][0]) < 0.6 * (found[1][1] - sum(b.verified for b in found[1][0]))


def test_folders_are_written_by_all_tasks(spark, sf):
    """Pages are few bytes and many files: Spark would join them into one task."""
    spark.sparkContext.setJobGroup("seeding", "seeding")
    root = devices.seeded(spark, sf)
    tracker = spark.sparkContext.statusTracker()
    most = max(tracker.getStageInfo(s).numTasks for j in tracker.getJobIdsForGroup("seeding") for s in tracker.getJobInfo(j).stageIds if tracker.getStageInfo(s))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    pages = {(r.conv_id, r.turn) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn").collect()}
    names = [r.path.rsplit("/", 1)[1] for r in listing.listing(spark, root, "*.rm", "*.pagedata").collect()]
    assert most == listing.tasks(spark)
    assert Counter(names) == Counter([f"pg-{c}-{t}.rm" for c, t in pages] + [f"nb-{c}.pagedata" for c in {c for c, _ in pages}])


def test_many_folders_are_listed_in_a_batch_and_a_large_one_in_several(tmp_path, monkeypatch):
    for i in range(50):
        (tmp_path / f"nb-{i}").mkdir()
        (tmp_path / f"nb-{i}" / "a.rm").write_bytes(b"x")
    folders = pd.DataFrame({"path": [f"/nb-{i}" for i in range(50)]})
    (whole,) = listing.entries([folders[:20], folders[20:]], str(tmp_path), ("*.rm",))
    assert sorted(whole["path"]) == sorted(f"/nb-{i}/a.rm" for i in range(50)) and not whole["folder"].any()
    monkeypatch.setattr(listing, "ENTRY_ROWS", 20)
    assert [len(b) for b in listing.entries([pd.DataFrame({"path": [""]})], str(tmp_path), ("*.rm",))] == [20, 20, 10]
    assert not list(listing.entries([folders[:0]], str(tmp_path), ("*.rm",)))


@pytest.mark.parametrize("name", ["s6_kinds", "s2_notebooks", "x10_page_hashes", "x10_short_pages", "f27_legacy_sentences"])
def test_a_folder_is_listed_once(spark, sf, monkeypatch, name):
    seen, own = [], notebooks.listing
    monkeypatch.setattr(notebooks, "listing", lambda *a, **b: seen.append(a) or own(*a, **b))
    got, want = against(spark, sf, name)
    assert got == want and len(seen) == 1


def test_sidecars_below_have_no_kind(spark, tmp_path):
    (tmp_path / "below").mkdir()
    for at in ("a", "below/b"):
        (tmp_path / f"{at}.metadata").write_text('{"type": "DocumentType"}')
        (tmp_path / f"{at}.content").write_text('{"fileType": "pdf"}')
    (tmp_path / "c.metadata").write_text("{}")
    for root in (str(tmp_path), tmp_path.as_uri(), f"{tmp_path.as_uri()}/"):
        assert set(map(tuple, notebooks.kinds(spark, root).collect())) == {("a", "pdf"), ("c", "folder")}
        assert {r.uuid for r in notebooks.notebooks(spark, root).collect()} == {"a", "b"}


def test_scans_hash_files_without_a_join(spark, tmp_path):
    for i in range(20):
        (tmp_path / f"{i} é.rm").write_bytes(b"x" * i)
    files = spark.createDataFrame([(f"file:{tmp_path}/{i} é.rm", i, None if i % 2 else i) for i in range(1, 21)], "path string, length long, old_length long")
    found = watch.with_digest(files)
    assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert {(r.length, r.old_length, r.hash) for r in found.collect()} == {(i, None if i % 2 else i, hashlib.sha256(b"x" * i).hexdigest() if i < 20 else None) for i in range(1, 21)}


@pytest.mark.parametrize("name", ["x10_page_hashes", "x10_short_pages", "s6_kinds", "f27_legacy_sentences"])
def test_contents_of_files_are_not_broadcast(spark, sf, name):
    """Spark takes contents for as small as the listing that names their files."""
    found = registry.queries()[name](spark, sf)
    plan = found._jdf.queryExecution().executedPlan().toString().splitlines()
    for i, line in enumerate(plan):
        if "BroadcastExchange" in line:
            deep, below = line.index("BroadcastExchange"), []
            for x in plan[i + 1 :]:
                at = next((k for k, c in enumerate(x) if c.isalpha()), len(x))
                if at <= deep:
                    break
                below.append(x)
            assert not any("MapInPandas" in x for x in below)


def test_a_root_is_listed_by_one_task(spark, tmp_path):
    """Empty tasks cost as much as full ones of a small folder."""
    (tmp_path / "nb").mkdir()
    (tmp_path / "nb" / "a.rm").write_bytes(b"x")
    spark.sparkContext.setJobGroup("listing", "listing")
    found = listing.listing(spark, str(tmp_path), "*.rm")
    tracker = spark.sparkContext.statusTracker()
    counts = [tracker.getStageInfo(s).numTasks for j in sorted(tracker.getJobIdsForGroup("listing")) for s in tracker.getJobInfo(j).stageIds if tracker.getStageInfo(s)]
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert counts[0] == 1 and counts.count(listing.tasks(spark)) == 1
    assert [r.path for r in found.collect()] == [f"file:{tmp_path}/nb/a.rm"]


def test_strokes_of_many_pages_are_drawn_at_once(spark, monkeypatch):
    """The width here is the number of polylines that are computed together."""
    pages = [devices.page_file(c, t, "user", "x") for c in range(6) for t in range(5)] + [b"junk"]
    files = spark.createDataFrame([(f"{i}.rm", x) for i, x in enumerate(pages)], "path string, content binary").coalesce(1)
    assert {r.path: r.svg for r in drawing.with_svg(files, 702, 936).collect()} == {f"{i}.rm": drawing.svg(x, 702, 936) for i, x in enumerate(pages)}
    monkeypatch.setitem(drawing.STYLES, "ballpoint", drawing.Pen(5, width=lambda p, b: np.full(len(p.x), float(len(p.x)))))
    found = "".join(r.svg for r in drawing.with_svg(files).collect())
    assert found.count("stroke-width:18.000") == 18 and found.count("stroke-width:5.573") == 6


def test_strokes_drawn_together_are_as_alone():
    rng = np.random.default_rng(6)
    strokes = [(pen, k % 5, 2.0, rng.random((n, 6)) * 20) for k, (pen, n) in enumerate((p, n) for n in (1, 2, 0, 7, 61) for p in drawing.STYLES)]
    alone = [drawing.drawn([s])[0] for s in strokes]
    for got, want in zip(drawing.drawn(strokes), alone, strict=True):
        assert [x[0] for x in got] == [x[0] for x in want] and [x[3:] for x in got] == [x[3:] for x in want]
        assert np.allclose([x[1:3] for x in got], [x[1:3] for x in want], rtol=1e-12)
