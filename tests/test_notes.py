"""Operators that are more than SQL against plain Python, and against small folders of files."""

import hashlib
import io
import json
import random
import re
import struct
import zipfile
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from quillspark.functions import dates, fingerprints
from quillspark.operators import blocks, matching, todos
from quillspark.plans import notes
from quillspark.sources import exports, notebooks, strokes
from quillspark.streaming import files


def column(spark, values, f):
    return [r[0] for r in spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, text string").orderBy("i").select(f(F.col("text"))).collect()]


def test_page_dates(spark):
    texts = ["**Date: 28-8-2025** 1-1-2020", "x 21/08/2025", "[1-2-30]", "1-2-31", "32-1-2025", "1-2/2024", None, "", "Date: 3.4.2025", "40-1-2025 then 5-6-2024"]
    assert column(spark, texts, dates.page_date) == ["28-08-2025", "21-08-2025", "01-02-2030", "01-02-1931", None, None, None, None, "03-04-2025", "05-06-2024"]


def test_calendar_dates(spark):
    got = column(spark, ["**Date: 16-8-2025**", "31-2-2025 or 1/3/2025", None, "none"], dates.calendar_date)
    assert [str(x) if x else None for x in got] == ["2025-08-16", "2025-03-01", None, None]


def test_todo_lines(spark):
    lines = ["- [ ] buy milk", "-[x] done it", "- [✓] ticked", "☐ open one", "☑ closed one", "□ square", "↳ - [ ] below", "- ↳ deep", "- [ ] ab", "plain", "", "  - [X] upper  "]
    rows = todos.todo_lines(spark.createDataFrame([(1, "\n".join(lines)), (2, None), (3, "")], "id int, text string")).orderBy("line").collect()
    assert [(r.todo, r.completed) for r in rows] == [("buy milk", False), ("done it", True), ("ticked", True), ("open one", False), ("closed one", True), ("square", False), ("upper", True)]
    assert not any(r.completed for r in todos.todo_lines(spark.createDataFrame([(1, "- [x] done it")], "id int, text string"), parity=True).collect())


def test_todo_plan(spark):
    schema = "id long, page int, text string, confidence double, box struct<x: double, y: double, width: double, height: double>"
    old = spark.createDataFrame([(1, 1, "call the bank", 0.5, None), (2, 1, "modem report for the board today", 0.9, (0.0, 0.0, 2.0, 2.0)), (3, 2, "call the bank", 0.5, None)], schema)
    new = spark.createDataFrame([(10, 1, "Call  the bank", 0.7, None), (11, 1, "modern report for the board today", 0.2, (1.0, 0.0, 2.0, 2.0)), (12, 3, "call the bank", 0.9, None), (13, 1, None, 0.9, None), (14, 1, "modern report", 0.1, None)], schema)
    got = {r.id: (r.action, r.existing_id) for r in todos.plan(new, old, ["page"]).collect()}
    assert got == {10: ("update", 1), 11: ("update", 2), 12: ("insert", None), 13: ("insert", None), 14: ("insert", None)}
    assert todos.explained("modern", "modem") and not todos.explained("abc", "xyz")


def slow_subsequence(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = row
        row = [0]
        for j, y in enumerate(b):
            row.append(last[j] + 1 if x == y else max(last[j + 1], row[j]))
    return row[-1]


@pytest.mark.parametrize(("a", "b"), [("kitten", "sitting"), ("", "x"), ("aaaa", "aa"), ("the quick fox", "teh quikc fox"), ("é€", "€é€")])
def test_common_subsequence(a, b):
    assert matching.common_subsequence(a, b) == slow_subsequence(a, b)


def test_match():
    text = "It rained. The quick brown fox jumps over the lazy dog! Then it slept."
    assert matching.match("quick brown fox", text, 65) == (100, "quick brown fox")
    score, found = matching.match("qnick brovn fox junps over", text, 65)
    assert score >= 65 and found == "The quick brown fox jumps over the lazy dog!"
    assert matching.match("unrelated words entirely here", text, 80)[1] is None
    assert matching.match(None, text, 65) == matching.match("x", None, 65) == (0, None)
    assert matching.partial_ratio("brown", "the brown fox") == 100


def test_contained(spark):
    docs = spark.createDataFrame([(1, "One  two three Four five six"), (2, "xone two three four fivex"), (3, None), (4, "short"), (5, "one two three four five one two three four five")], "doc_id int, text string")
    items = spark.createDataFrame([(1, "one two three four five"), (2, "short"), (3, None), (4, ""), (5, "two three")], "item_id int, text string")
    got = sorted(tuple(r) for r in matching.contained(items, docs, "item_id", "doc_id").collect())
    assert got == [(1, 1, 1), (1, 5, 5), (2, 1, 2), (2, 5, 6), (4, 2, 1), (5, 1, 1), (5, 5, 5)]


@pytest.mark.parametrize("sent", [0, 1 << 20])
def test_contained_is_all_pairs(spark, monkeypatch, sent):
    monkeypatch.setattr(matching, "SENT_BYTES", sent)
    rng = random.Random(3)
    own = ["".join(rng.choices("abé", k=rng.randint(1, 5))) for _ in range(12)]
    texts = [(i, "  ".join(rng.choices(own, k=rng.randint(1, 30)))) for i in range(40)] + [(40, None), (41, " \n"), (42, "😀 b")]
    items = [(i, t[a : a + rng.randint(1, 25)]) for i, t in ((k, rng.choice(texts[:40])[1]) for k in range(150)) for a in [rng.randrange(len(t))]] + [(200, None), (201, " "), (202, "zz"), (203, "😀")]
    norm = lambda x: " ".join((x or "").split()).lower()
    want = {(i, j, norm(t).index(norm(x)) + 1) for i, t in texts for j, x in items if norm(x) and norm(x) in norm(t)}
    got = matching.contained(spark.createDataFrame(items, "item_id int, text string"), spark.createDataFrame(texts, "doc_id int, text string"), "item_id", "doc_id")
    rows = [tuple(r) for r in got.collect()]
    assert len(rows) == len(want) and set(rows) == want
    assert "NestedLoop" not in got._jdf.queryExecution().toString() and "Cartesian" not in got._jdf.queryExecution().toString()
    assert matching.contained(spark.createDataFrame([], "item_id int, text string"), spark.createDataFrame(texts, "doc_id int, text string"), "item_id", "doc_id").count() == 0


def test_page_search_finds_passages(spark, sf):
    rows = notes.m6_page_search(spark, sf).collect()
    assert rows and all(r.score >= 65 for r in rows)
    at_home = sum(r.page - 1 == int(r.id.split("-")[2]) for r in rows)
    assert at_home >= 0.85 * len(rows)


def test_blocks(spark):
    text = "# Top\n\n#### Deep\n---\n- [x] did\n- [ ] todo\n* star\n- dash\n3. third\n   → note\nplain"
    rows = blocks.blocks(spark.createDataFrame([(1, text), (2, None), (3, " \n\n"), (4, "\n".join(["x"] * 150))], "page int, text string"), "page").orderBy("page", "block").collect()
    got = [(r.kind, r.level, r.content, r.checked) for r in rows if r.page == 1]
    assert got == [("heading", 1, "Top", None), ("heading", 3, "Deep", None), ("divider", None, "", None), ("checkbox", None, "did", True), ("checkbox", None, "todo", False), ("bullet", None, "star", None), ("bullet", None, "dash", None), ("numbered", None, "third", None), ("paragraph", None, "→ note", None), ("paragraph", None, "plain", None)]
    assert [r.content for r in rows if r.page in (2, 3)] == ["(No content to display)"] * 2
    assert sum(r.page == 4 for r in rows) == 100
    run = spark.createDataFrame([("a **b c** *d* e",)], "t string").select(blocks.rich_text(F.col("t"))).first()[0]
    assert [(x.text, x.bold, x.italic) for x in run] == [("a ", False, False), ("b c", True, False), (" ", False, False), ("d", False, True), (" e", False, False)]


def test_record_hashes(spark):
    row = spark.createDataFrame([(" Tïtle 😀 ", None, "a\n\"b\"", 3, 0.7)], "t string, a string, x string, n int, c double")
    got = row.select(fingerprints.notebook_hash(*map(F.col, ("t", "a", "x", "n"))), fingerprints.page_hash(F.lit("nb"), F.col("n"), F.col("x"), F.col("c")), fingerprints.todo_hash(F.col("x"), F.lit("nb"), F.lit("12")), fingerprints.highlight_hash(F.col("x"), F.col("a"), F.lit("f"), F.lit("1"))).first()
    records = [
        {"title": "Tïtle 😀", "author": "", "text_content": 'a\n"b"', "page_count": 3, "type": "notebook"},
        {"notebook_uuid": "nb", "page_number": 3, "text": 'a\n"b"', "confidence": 0.7, "type": "page_text"},
        {"text": 'a\n"b"', "notebook_uuid": "nb", "page_number": "12", "type": "todo"},
        {"text": 'a\n"b"', "corrected_text": "", "source_file": "f", "page_number": "1", "type": "highlight"},
    ]
    assert list(got) == [hashlib.sha256(json.dumps(r, sort_keys=True).encode()).hexdigest() for r in records]


@pytest.fixture(scope="module")
def device(tmp_path_factory):
    d = tmp_path_factory.mktemp("device")
    put = lambda name, x: (d / name).write_text(x if isinstance(x, str) else json.dumps(x))
    put("a.metadata", {"visibleName": "A", "parent": "", "type": "DocumentType", "deleted": True})
    put("b.metadata", {"visibleName": "B", "parent": "f", "type": "DocumentType"})
    put("f.metadata", {"visibleName": "F", "type": "CollectionType"})
    put("z.metadata", "{broken")
    put("a.content", {"fileType": "", "formatVersion": 1, "pages": ["p1", "p2"], "documentMetadata": {"authors": ["X", "Y"], "publisher": " P ", "publicationDate": "2024-03-01T10:00:00Z"}})
    put("b.content", {"fileType": "pdf", "formatVersion": 2, "cPages": {"pages": [{"id": "q1", "redir": {"value": 4}}, {"id": "q2", "deleted": {"value": 1}}]}, "documentMetadata": {"authors": "Z", "publicationDate": "spring"}})
    put("a.pagedata", "Blank  Lines\nGrid")
    put("allow.txt", "# comment\n\n A \n")
    (d / "a").mkdir()
    head = b"reMarkable .lines file, version=5".ljust(43)
    page = head + struct.pack("<I", 1) + struct.pack("<I", 1) + struct.pack("<IIIffI", 17, 1, 0, 2.0, 0.0, 2) + struct.pack("<6f", 1, 2, 0, 0, 1, 0.5) * 2
    (d / "a" / "p1.rm").write_bytes(page + b"some readable words here\0" * 2)
    (d / "a" / "p2.rm").write_bytes(page[:90])
    return str(d)


def test_sources(spark, device):
    rows = {r.uuid: r for r in notebooks.sidecars(spark, device).collect()}
    assert set(rows) == {"a", "b", "f"} and rows["a"].deleted and rows["a"].parent is None and rows["b"].parent == "f"
    assert {r.uuid for r in notebooks.notebooks(spark, device, exclude=["B"]).collect()} == {"a"}
    assert sorted(tuple(r) for r in notebooks.pages(spark, device).collect()) == [("a", 1, "p1"), ("a", 2, "p2"), ("b", 1, "q1")]
    assert dict(map(tuple, notebooks.page_counts(spark, device).collect())) == {"a": 2, "b": 1}
    assert [tuple(r) for r in notebooks.page_map(spark, device).collect()] == [("b", "q1", 4)]
    assert dict(map(tuple, notebooks.kinds(spark, device).collect())) == {"a": "notebook", "b": "pdf", "f": "folder"}
    assert {r.uuid: tuple(r)[1:] for r in notebooks.metadata(spark, device).collect()} == {"a": ("X, Y", "P", "2024-03-01"), "b": ("Z", None, "spring")}
    assert notebooks.templates(spark, device).first().templates == ["Blank", "Lines", "Grid"]
    assert [r.page_uuid for r in notebooks.strokes(spark, device).collect()] == ["p1"]
    assert {r.run for r in notebooks.printable_runs(spark, device).collect()} >= {"some readable words here"}
    assert [r.line for r in notebooks.allowed(spark, f"{device}/allow.txt").collect()] == ["A"]


def test_strokes(spark, device):
    rows = strokes.read_strokes(notebooks.files(spark, device, "*.rm")).collect()
    assert [(r.pen, r.colour, r.width, list(r.xs), list(r.pressures)) for r in rows] == [("fineliner", 1, 2.0, [1.0, 1.0], [0.5, 0.5])]
    assert strokes.parse(None) == strokes.parse(b"x" * 60) == []
    assert strokes.polyline([1.0], [2.0]).endswith('points="1.000,2.000"/>')


def test_books():
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        z.writestr("a.xhtml", "<p>One  two<script>no</script></p>\n<p>three</p>")
        z.writestr("img/pic.png", b"0" * 20000)
        z.writestr("c.opf", '<meta name="cover" content="i1"/><item id="i1" href="img/pic.png"/>')
    assert strokes.epub_text(buffer.getvalue()) == "One two three"
    assert strokes.epub_cover(buffer.getvalue()) == "img/pic.png"
    assert strokes.epub_text(b"no zip") is None and strokes.html_text(None) == ""


def test_exports(spark, tmp_path):
    pages = spark.createDataFrame([("n", 2, "b"), ("n", 1, "a"), ("m", 1, None)], "notebook_uuid string, page_number int, text string")
    exports.page_texts(pages, str(tmp_path / "t"))
    text = "".join(p.read_text() for p in sorted((tmp_path / "t" / "notebook_uuid=n").glob("part*")))
    assert re.sub(r"\s+", " ", text) == "## Page 1 a ## Page 2 b "
    exports.export(pages, str(tmp_path / "c"), "csv")
    assert spark.read.option("header", True).csv(str(tmp_path / "c")).count() == 3


def stored(rows, gap):
    last, out = {}, []
    for key, t, i in sorted(rows, key=lambda r: (r[1], r[2])):
        if None in key or key not in last or t - last[key] > gap:
            last[key] = t
            out.append(i)
    return sorted(out)


def test_stored_changes(spark, sf):
    rows = [((k,), t * 100, t) for t in range(40) for k in ["a"]] + [((None,), 5, 100), ((None,), 6, 101), (("b",), 7, 102)]
    df = spark.createDataFrame([(k[0], t, i) for k, t, i in rows], "k string, t long, i long")
    got = sorted(r.i for r in files.stored_changes(df, ["k"], "t", "i", 300).collect())
    assert got == stored(rows, 300)


def test_cooldown_stream(spark, tmp_path):
    start = datetime(2024, 1, 1)
    events = [("a", 0), ("a", 3), ("a", 5), ("b", 1), ("a", 9), ("a", 10)]
    spark.createDataFrame([(k, start + timedelta(seconds=s)) for k, s in events], "path string, ts timestamp").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = files.cooldown(spark.readStream.schema("path string, ts timestamp").parquet(str(tmp_path / "in")), "path")
    query = stream.writeStream.format("memory").queryName("passed").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination(60)
    got = sorted((r.path, int((r.ts - start).total_seconds())) for r in spark.table("passed").collect())
    assert got == [("a", 0), ("a", 5), ("a", 10), ("b", 1)]


def test_routing_and_catch_up(spark, tmp_path):
    spark.createDataFrame([("x",), ("y",)], "uuid string").coalesce(1).write.parquet(str(tmp_path / "in"))
    kinds = spark.createDataFrame([("x", "notebook"), ("y", "pdf")], "uuid string, document_type string")
    seen = []
    to = {"notebook": lambda df: seen.append(("n", [r.uuid for r in df.collect()])), "pdf|epub": lambda df: seen.append(("b", [r.uuid for r in df.collect()]))}
    files.route(spark.readStream.schema("uuid string").parquet(str(tmp_path / "in")), kinds, "uuid", to, str(tmp_path / "c")).awaitTermination(60)
    assert seen == [("n", ["x"]), ("b", ["y"])]
    assert files.catch_up(kinds, cap=1).count() == 0 and files.catch_up(kinds, cap=1, force=True).count() == files.catch_up(kinds, cap=2).count() == 2
