"""Tables that change, trees, sinks, sources and matching against plain Python."""

import json
import re
import sqlite3
import struct
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark.functions import dates
from quillspark.operators import blocks, matching, paths, todos
from quillspark.plans import notes
from quillspark.plans.changes import LINES
from quillspark.shared import base, folder
from quillspark.sources import drawing, remote, targets
from quillspark.sources.tables import VersionedTable
from quillspark.streaming import files


def test_tree_with_cycles_and_lost_parents(spark):
    nodes = [("a", None, "A"), ("b", "a", "B"), ("c", "b", "C"), ("t", "trash", "T"), ("u", "t", "U"), ("x", "y", "X"), ("y", "x", "Y"), ("z", "x", "Z"), ("l", "nowhere", "L")]
    nodes += [(f"n{i}", f"n{i - 1}" if i else None, f"N{i}") for i in range(150)]
    got = {r.uuid: r.path for r in paths.lineage(spark.createDataFrame(nodes, "uuid string, parent string, name string"), folder(spark, "tree")).select("uuid", paths.path().alias("path")).collect()}
    assert got["c"] == "A/B/C" and got["u"] == "🗑️ Trash/T/U" and got["l"] == "📁 L" and not {"x", "y", "z"} & set(got)
    assert got["n149"] == "/".join(f"N{i}" for i in range(150)) and len(got) == 156
    assert paths.lineage(spark.createDataFrame([], "uuid string, parent string, name string"), folder(spark, "tree")).count() == 0


def test_path_parts(spark):
    rows = [("Work/ Notes /My: Book?", "n"), ("/a//b/", "n"), ("solo", ' .x/"y". '), (None, "..."), ("", "\x01\x02"), ("a/" + "b" * 300, "n")]
    got = spark.createDataFrame(rows, "p string, n string").select(paths.tags(F.col("p")), paths.output_path(F.col("p"), F.col("n"))).collect()
    assert [r[0] for r in got] == [["Work", "Notes"], ["a"], [], [], [], ["a"]]
    assert [r[1] for r in got] == ["Work/Notes/My_ Book_.md", "a/b.md", "x__y_.md", "untitled.md", "untitled.md", "a/" + "b" * 255 + ".md"]


def test_versions(spark):
    t = VersionedTable(spark, folder(spark, "t"), ["k"], "k int, v string")
    make = lambda *rows: spark.createDataFrame(list(rows), "k int, v string")
    rows = lambda: sorted(map(tuple, t.read().collect()), key=str)
    assert t.version() == 0 and rows() == []
    t.insert_or_ignore(make((1, "a"), (1, "b"), (None, "n")), F.col("v"))
    t.insert_or_ignore(make((1, "c"), (2, "d"), (None, "m")), F.col("v"))
    assert rows() == [(1, "a"), (2, "d"), (None, "n")]
    t.upsert(make((2, "e"), (2, "f"), (None, "o")), F.col("v"))
    assert rows() == [(1, "a"), (2, "f"), (None, "o")]
    t.update(F.col("k") == 1, v=F.lit("z"))
    t.replace_partition(make((1, "p"), (1, "q")), ["k"])
    t.delete(F.col("k") > 1)
    assert rows() == [(1, "p"), (1, "q"), (None, "o")]
    t.cascade(spark.createDataFrame([(9,)], "id int"), "k", "id")
    assert rows() == [(None, "o")] and t.version() == 7


def test_sync_sends_each_content_once(spark):
    items = spark.createDataFrame([(f"h{i % 50}", i) for i in range(200)] + [(None, 7)], "content_hash string, n int")
    mock = targets.MockTarget(fail_rate=0.3)
    first = targets.sync(items, mock).collect()
    assert len(first) == 50 and 0 < sum(r.status == "failed" for r in first) < 50
    done = spark.createDataFrame([tuple(r) for r in first], targets.RESULTS)
    again = targets.sync(items, mock, done).collect()
    assert {r.content_hash for r in again} == {r.content_hash for r in first if r.status == "failed"} and all(r.status == "failed" for r in again)
    assert targets.sync(items, targets.MockTarget(name="other"), done).count() == 50
    assert mock.update("mock_1", {})[0] == "success" and mock.delete("x")[0] == "failed" and mock.info()["connected"]
    assert targets.Rate().pause(1) == 60 / 235 and [len(x) for x in targets.batches(iter([{}] * 120), 50)] == [50, 50, 20]


def test_pages_and_settings(tmp_path, spark, monkeypatch):
    found = {None: {"results": [1, 2], "has_more": True, "next_cursor": "b"}, "b": {"results": [3], "has_more": False}}
    assert list(remote.follow(found.__getitem__)) == [1, 2, 3]
    (tmp_path / "a-0.json").write_text(json.dumps({"results": [{"id": "1", "title": "x"}], "has_more": True, "next_cursor": "a-1.json"}))
    (tmp_path / "a-1.json").write_text(json.dumps({"results": [{"id": "2"}], "has_more": False}))
    spark.dataSource.register(remote.PagedLists)
    assert sorted(map(tuple, spark.read.format("paged_lists").option("path", tmp_path.as_uri()).load().collect())) == [("a", 0, "1", "x"), ("a", 1, "2", None)]
    con = sqlite3.connect(tmp_path / "x.db")
    con.execute("create table t (a int, b text)")
    con.execute("insert into t values (1, 'é'), (2, null)")
    con.commit()
    con.close()
    (tmp_path / "y.db").write_bytes(b"no database")
    assert sorted(map(tuple, remote.sqlite_table(spark, f"{tmp_path.as_uri()}/*.db", "select a, b from t", "a long, b string").collect())) == [(1, "é"), (2, None)]
    monkeypatch.setenv("QUILL_KEY", "secret")
    c = remote.Config({"device": {"sync_directory": ""}, "a": {"b": 1, "c": 2}}, {"a": {"b": 5}, "device": {"source_directory": "/old"}}, {"QUILL_KEY": "api.key"})
    assert (c.get("a.b"), c.get("a.c"), c.get("api.key"), c.get("device.sync_directory"), c.get("x.y", 3)) == (5, 2, "secret", "/old", 3)


def test_layout_and_blanks(spark):
    books = spark.createDataFrame([("nb-123456789", "Book", "A/Book", "2024-05-01", "A"), ("e", "Empty", None, None, "")], "notebook_uuid string, name string, full_path string, modified string, tags string")
    pages = spark.createDataFrame([("nb-123456789", i) for i in range(1, 6)], "notebook_uuid string, page_number int")
    rows = sorted(blocks.layout(books, pages, most=2).collect())
    assert [(r.kind, r.content) for r in rows if r.notebook_uuid == "e"] == [("heading", "📓 Empty"), ("paragraph", "Total pages: 0 | UUID: e..."), ("divider", "")]
    own = [(r.kind, r.content) for r in rows if r.notebook_uuid != "e"]
    assert [k for k, _ in own] == ["heading", "paragraph", "callout", "divider", "toggle", "toggle"] and own[4][1] == "📄 Page 5"
    assert own[1][1] == "Total pages: 5 | UUID: nb-12345... | Path: A/Book | Modified: 2024-05-01 | Tags: A | Showing latest 2 pages (truncated)"
    tree = [("n", "📄 Page 12 (x)", [("paragraph", "fine"), ("paragraph", "a completely empty page, twice"), ("paragraph", "This appears to be a blank")]), ("n", "other", [("paragraph", "completely empty page")]), ("n", "📄 Page 3", []), (None, None, None)]
    got = blocks.blank_pages(spark.createDataFrame(tree, "notebook string, title string, children array<struct<type: string, text: string>>")).collect()
    assert list(map(tuple, got)) == [("n", 12, "a completely empty page, twice")]


def test_two_stages(spark):
    book = "It rained all day. The quick brown fox jumps over the lazy dog near the old mill! Then it slept. " + "Filler sentences go on and on here. " * 30
    highlights = spark.createDataFrame([(1, "b", 1, "qnick brovn fox junps over the lazy dog"), (2, "b", 0, "unknown page"), (3, "p", 1, "It rained all day"), (4, "b", 1, None)], "id int, book string, page_number int, text string")
    pages = spark.createDataFrame([("b", 1, "The quick brovvn fox jumps over the lazy dog near the old mill! Then it slept."), ("b", 10, "The end."), ("p", 2, "It rained all day. Then not.")], "book string, page_number int, text string")
    got = {r.id: r for r in matching.two_stage(highlights, pages, spark.createDataFrame([("b", book)], "book string, text string"), "book").collect()}
    assert got[1].text.startswith("The quick brown fox") and got[1].corrected and got[1].original_text.startswith("qnick")
    assert not got[2].corrected and got[2].text == "unknown page" and got[2].confidence is None
    assert got[3].corrected and got[3].confidence == 1.0 and not got[4].corrected
    stored = spark.createDataFrame([(1, "b", 1, "qnick brovn fox junps over the lazy dog near", None), (2, "b", None, "x", None)], "id int, book string, page_number int, original_text string, corrected_text string")
    assert [r.id for r in matching.rematch(stored, spark.createDataFrame([("b", book)], "book string, text string"), "book").collect()] in ([1], [])


def test_dates_in_order(spark):
    got = spark.createDataFrame([("5-6-2024 and Date: 7.8.2023, again 5/6/2024",), (None,), ("none",)], "t string").select(dates.page_dates(F.col("t"))).collect()
    assert [r[0] for r in got] == [["07-08-2023", "05-06-2024", "05-06-2020", "07-08-2020"], None, []]


def test_bursts(spark):
    at = datetime(2024, 1, 1)
    rows = [("a", at + timedelta(seconds=s)) for s in (0, 10, 39, 200)] + [("b", at)]
    got = files.debounced(spark.createDataFrame(rows, "k string, ts timestamp"), "k", quiet_seconds=30)
    assert sorted((r.k, (r.last - r["first"]).seconds, r.n) for r in got.collect()) == [("a", 0, 1), ("a", 39, 3), ("b", 0, 1)]


def test_todo_counts(spark):
    planned = spark.createDataFrame([(1, "insert"), (2, "skip"), (3, "skip")], "id int, action string")
    assert dict(map(tuple, todos.plan_counts(planned).collect())) == {"insert": 1, "skip": 2}


def line_kinds(text):
    out = []
    for line in (x.strip() for x in text.split("\n")):
        if not line:
            continue
        for kind, pattern in (("heading", "^#"), ("divider", "^---+$"), ("checkbox", r"^-\s*\[[ xX]\]\s+.+$"), ("bullet", r"^[-*]\s+.+$"), ("numbered", r"^\d+\.\s+.+$"), ("paragraph", "")):
            if re.search(pattern, line):
                out.append(kind)
                break
    return out[:100] or ["paragraph"]


def test_blocks_of_the_table(spark, sf):
    from quillspark.plans import more

    texts = {r.page: r.text for r in notes.pages(spark, sf).collect()}
    got = {r.page: r for r in more.k2_block_structs(spark, sf).collect()}
    assert LINES and set(got) == set(texts) and all(got[k].types.split(",") == line_kinds(t) == line_kinds(t)[: got[k].n] for k, t in texts.items())


def test_drawing():
    n = 7
    points = drawing.Points(np.arange(7.0), np.zeros(n), np.full(n, 50.0), np.full(n, 1.0), np.full(n, 4.0), np.full(n, 0.5))
    lines = drawing.polylines("marker", 1, 2.0, points)
    assert [len(x[3]) for x in lines] == [3, 4, 2] and {x[0] for x in lines} == {"rgb(125,125,125)"}
    first = 0.9 * (4 - 0.4)
    assert np.allclose([x[1] for x in lines], [first, first + 0.1 * first, first + 0.1 * (first + 0.1 * first)])
    assert np.allclose([x[1] for x in drawing.polylines("ballpoint", 0, 2.0, points)], 0.5 + 0.5 + 4 - 0.5)
    pencil = drawing.polylines("pencil", 0, 2.0, points)
    assert np.allclose(pencil[0][1], 0.7 * ((0.8 * 2 + 0.25) * 4 - 0.25 - 0.6)) and np.isclose(pencil[0][2], 0.5 - 50 / 350 - 0.1)
    assert drawing.polylines("highlighter", 3, 9.0, points)[0][:3] == ("rgb(251,247,25)", 15.0, 0.3)
    assert drawing.svg(None).count("polyline") == drawing.svg(b"junk").count("polyline") == 0
    assert 'points="20.000,10.000' in drawing.svg(_page([(20.0, 10.0)])) and 'points="20.000,20.000' in drawing.svg(_page([(20.0, 10.0)]), 1404, 3744).replace("40.000,", "20.000,")


def _page(places):
    head = b"reMarkable .lines file, version=5".ljust(43) + struct.pack("<II", 1, 1) + struct.pack("<IIIffI", 4, 0, 0, 2.0, 0.0, len(places))
    return head + b"".join(struct.pack("<6f", x, y, 0, 0, 2, 0.5) for x, y in places)


def test_shared_folder_must_be_named_on_a_cluster(monkeypatch):
    class Context:
        master = "spark://host:7077"

    class Session:
        sparkContext = Context()

        class conf:
            get = staticmethod(lambda key, default=None: default)

    with pytest.raises(ValueError):
        base(Session())
