"""Queries of the operators that are more than SQL, over the given tables, and their SQL for the oracle where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.functions import dates, fingerprints
from quillspark.operators import blocks, matching, todos
from quillspark.plans.adapters import run, with_domain
from quillspark.plans.changes import LINES
from quillspark.sources import exports, strokes
from quillspark.streaming import files

PAGES = f"SELECT conv_id, turn, {LINES} AS text FROM conversations"
NORM = "trim(lower(regexp_replace({}, '[ \\t\\n\\r]+', ' ', 'g')))"


def _own(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    return run(spark, sf_dir, with_domain(sql))


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _own(spark, sf_dir, f"SELECT concat(conv_id, '-', turn) AS page, text FROM ({PAGES}) p")


def f12_page_dates(spark, sf_dir):
    return _own(spark, sf_dir, PAGES).select("conv_id", "turn", dates.page_date(F.col("text")).alias("page_date"))


def f15_calendar_dates(spark, sf_dir):
    return _own(spark, sf_dir, PAGES).select("conv_id", "turn", F.date_format(dates.calendar_date(F.col("text")), "yyyy-MM-dd").alias("day"))


def t1_todo_lines(spark, sf_dir):
    return todos.todo_lines(_own(spark, sf_dir, PAGES)).select("conv_id", "turn", "line", "todo", "completed")


def t2_todo_dates(spark, sf_dir):
    return todos.todo_lines(_own(spark, sf_dir, PAGES)).groupBy("page_date").agg(F.count("*").alias("n"))


def t4_todo_list(spark, sf_dir):
    return exports.todo_list(_own(spark, sf_dir, "SELECT id, text, completed FROM d_todo"))


def f24_word_jaccard(spark, sf_dir):
    pairs = _own(spark, sf_dir, "SELECT a.id, a.original_text AS x, b.original_text AS y FROM d_highlight a JOIN d_highlight b ON b.id = a.id + 1")
    one, two = (F.array_distinct(F.filter(F.split(F.lower(c), "[ \\n\\t\\r]+"), lambda w: w != "")) for c in ("x", "y"))
    return pairs.select("id", F.round(F.size(F.array_intersect(one, two)) / F.size(F.array_union(one, two)), 9).alias("jaccard"))


def n3_todo_plan(spark, sf_dir):
    """Sentences of documents as todos, eight documents side by side in a notebook, new ones (odd ids) misread: each has several stored ones on its page."""
    docs = _own(spark, sf_dir, "SELECT doc_id AS id, concat('nb-', doc_id - doc_id % 8) AS nb, text FROM documents")
    own = docs.select("id", "nb", F.posexplode(F.split("text", r"[.!?\n]+")).alias("page", "text")).withColumn("text", F.trim("text")).filter("text <> ''")
    box = F.struct((F.col("id") % 100).cast("double").alias("x"), F.lit(1.0).alias("y"), F.lit(9.0).alias("width"), F.lit(9.0).alias("height"))
    own = own.withColumn("box", box).withColumn("confidence", (F.col("page") % 10) / 10).withColumn("number", F.col("id") * 100_000 + F.col("page"))
    new, old = (own.filter(F.col("id") % 2 == k).withColumn("id", F.col("number")).drop("number") for k in (1, 0))
    return todos.plan(new.withColumn("text", F.replace("text", F.lit("rn"), F.lit("m"))), old, ["nb", "page"])


def m1_exact_containment(spark, sf_dir):
    docs, items = _own(spark, sf_dir, "SELECT doc_id, text FROM documents"), _own(spark, sf_dir, "SELECT item_id, text FROM benchmark")
    return matching.contained(items, docs, "item_id", "doc_id")


def sentences(spark: SparkSession, sf_dir: str, page_number: str = "page_number") -> DataFrame:
    """Every sentence of every page as a highlight, misread: each e is a c."""
    own = _own(spark, sf_dir, f"SELECT page_uuid, notebook_uuid, {page_number} AS page_number, text FROM d_page")
    each = own.select("page_uuid", "notebook_uuid", "page_number", F.posexplode(F.split("text", r"[.!?\n]+")).alias("at", "text")).withColumn("text", F.trim("text")).filter("text <> ''")
    return each.select(F.concat_ws("-", "page_uuid", "at").alias("id"), "notebook_uuid", "page_number", F.replace("text", F.lit("e"), F.lit("c")).alias("text"))


def m6_page_search(spark, sf_dir):
    """All sentences, misread, looked for around the page after their own."""
    found = matching.page_search(sentences(spark, sf_dir, "page_number + 1"), _own(spark, sf_dir, "SELECT notebook_uuid, page_number, text FROM d_page"), "notebook_uuid")
    return found.select("id", "page", "score", F.md5("found").alias("found"), "start", "end", "windows", "verified")


def k1_blocks(spark, sf_dir):
    return blocks.blocks(pages(spark, sf_dir), "page")


def k3_rich_text(spark, sf_dir):
    own = _own(spark, sf_dir, "SELECT item_id, concat('a **', replace(replace(text, '*', ''), '. ', '** b *'), '* c') AS text FROM benchmark")
    return own.select("item_id", F.posexplode(blocks.rich_text(F.col("text"))).alias("at", "r")).select("item_id", "at", "r.text", "r.bold", "r.italic")


def x1_notebook_hash(spark, sf_dir):
    own = _own(spark, sf_dir, "SELECT n.notebook_uuid, n.visible_name, n.authors, n.total_pages, t.text FROM d_notebook n JOIN (SELECT notebook_uuid, listagg(text, '\n') WITHIN GROUP (ORDER BY page_number) AS text FROM d_page GROUP BY notebook_uuid) t ON t.notebook_uuid = n.notebook_uuid")
    return own.select("notebook_uuid", fingerprints.notebook_hash(F.col("visible_name"), F.col("authors"), F.col("text"), F.col("total_pages")).alias("h"))


def x2_page_hash(spark, sf_dir):
    own = _own(spark, sf_dir, "SELECT notebook_uuid, page_uuid, page_number, text, confidence FROM d_page")
    return own.select("page_uuid", fingerprints.page_hash(*map(F.col, ("notebook_uuid", "page_number", "text", "confidence"))).alias("h"))


def x3_todo_hash(spark, sf_dir):
    own = _own(spark, sf_dir, "SELECT id, text, notebook_uuid, page_number FROM d_todo")
    return own.select("id", fingerprints.todo_hash(*map(F.col, ("text", "notebook_uuid", "page_number"))).alias("h"))


def x4_highlight_hash(spark, sf_dir):
    own = _own(spark, sf_dir, "SELECT id, original_text, corrected_text, concat(notebook_uuid, '.content') AS source_file, CAST(page_number AS VARCHAR(9)) AS page_number FROM d_highlight")
    return own.select("id", fingerprints.highlight_hash(*map(F.col, ("original_text", "corrected_text", "source_file", "page_number"))).alias("h"))


def g1_dedup(spark, sf_dir):
    own = _own(spark, sf_dir, "SELECT id, source_table, source_id, operation, hash_after, changed_ms FROM d_log")
    return files.stored_changes(own, ["source_table", "source_id", "operation", "hash_after"], "changed_ms", "id").select("id")


def s10_page_texts(spark, sf_dir):
    return strokes.with_html_text(_own(spark, sf_dir, "SELECT page_id, html FROM pages"), "page_id")


_ALL = (f12_page_dates, f15_calendar_dates, t1_todo_lines, t2_todo_dates, t4_todo_list, f24_word_jaccard, n3_todo_plan, m1_exact_containment, m6_page_search, k1_blocks, k3_rich_text, x1_notebook_hash, x2_page_hash, x3_todo_hash, x4_highlight_hash, g1_dedup, s10_page_texts)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in _ALL}

_LINE = f"SELECT conv_id, turn, unnest(generate_series(0, len(string_split(text, chr(10))) - 1)) AS line, trim(unnest(string_split(text, chr(10))), ' ' || chr(9) || chr(13) || chr(12)) AS raw FROM ({PAGES}) p"
_TODOS = f"SELECT conv_id, turn, CAST(line AS INTEGER) AS line, trim(regexp_extract(raw, '^- \\[[ X]\\]\\s*(.+)', 1)) AS todo, raw LIKE '- [X]%' AS completed FROM ({_LINE}) l WHERE length(trim(regexp_extract(raw, '^- \\[[ X]\\]\\s*(.+)', 1))) > 2"
#: What the patterns find, in their order; a date is one whose numbers have the same mark between them and can be a day, a month and a year.
_FOUND = ", ".join(f"regexp_extract_all(text, '{p}', 1)" for p in dates.PAGE_DATES)
_DAY, _MONTH, _YEAR = "TRY_CAST(regexp_extract(d, '^\\d+') AS INTEGER)", "TRY_CAST(regexp_extract(d, '^\\d+\\D(\\d+)', 1) AS INTEGER)", "regexp_extract(d, '\\d+$')"
_FULL = f"if(length({_YEAR}) = 2, if({_YEAR} <= '30', '20', '19') || {_YEAR}, {_YEAR})"
_VALID = f"regexp_full_match(d, '\\d+(-\\d+-|/\\d+/|[.]\\d+[.])\\d+') AND {_DAY} BETWEEN 1 AND 31 AND {_MONTH} BETWEEN 1 AND 12 AND {_FULL} BETWEEN '1900' AND '2100'"
_DATED = f"SELECT conv_id, turn, list_transform(list_filter(flatten([{_FOUND}]), lambda d: {_VALID}), lambda d: lpad({_DAY}::VARCHAR, 2, '0') || '-' || lpad({_MONTH}::VARCHAR, 2, '0') || '-' || {_FULL})[1] AS page_date FROM ({PAGES}) p"
_DAYS = ", ".join(f"try_strptime(regexp_extract(text, '{p}', 1), '{'%d/%m/%Y' if '/' in f else '%d-%m-%Y'}')" for p, f in dates.CALENDAR_DATES)
ORACLE = {
    "t1_todo_lines": _TODOS,
    "t4_todo_list": "SELECT completed AS part, CAST(-1 AS BIGINT) AS id, concat(CASE WHEN completed THEN '## Completed (' ELSE '## Pending (' END, count(*), ')') AS line FROM d_todo GROUP BY completed UNION ALL SELECT completed, id, concat(CASE WHEN completed THEN '- [x] ' ELSE '- [ ] ' END, coalesce(text, '')) FROM d_todo",
    "m1_exact_containment": f"SELECT doc_id, item_id, CAST(instr(t, n) AS INTEGER) AS at FROM (SELECT doc_id, {NORM.format('text')} AS t FROM documents) d, (SELECT item_id, {NORM.format('text')} AS n FROM benchmark) b WHERE n <> '' AND contains(t, n)",
    "f24_word_jaccard": "SELECT a.id, round(len(list_intersect(x, y)) / len(list_distinct(list_concat(x, y))), 9) AS jaccard FROM (SELECT item_id AS id, list_distinct(list_filter(regexp_split_to_array(lower(text), '[ \\n\\t\\r]+'), lambda w: w <> '')) AS x FROM benchmark) a JOIN (SELECT item_id AS id, list_distinct(list_filter(regexp_split_to_array(lower(text), '[ \\n\\t\\r]+'), lambda w: w <> '')) AS y FROM benchmark) b ON b.id = a.id + 1",
    "f12_page_dates": f"SELECT conv_id, turn, page_date FROM ({_DATED}) d",
    "f15_calendar_dates": f"SELECT conv_id, turn, strftime(coalesce({_DAYS}), '%Y-%m-%d') AS day FROM ({PAGES}) p",
    "t2_todo_dates": f"SELECT page_date, count(*) AS n FROM ({_TODOS}) t JOIN ({_DATED}) d USING (conv_id, turn) GROUP BY page_date",
    "k3_rich_text": """SELECT item_id, CAST(place - 1 AS INTEGER) AS at, CASE WHEN bold THEN r[3:-3] WHEN italic THEN r[2:-2] ELSE r END AS text, bold, italic FROM (
        SELECT *, starts_with(r, '**') AND ends_with(r, '**') AND length(r) > 4 AS bold, length(r) > 2 AND starts_with(r, '*') AND ends_with(r, '*') AND NOT contains(r[2:-2], '*') AS italic FROM (
        SELECT item_id, generate_subscripts(runs, 1) AS place, unnest(runs) AS r FROM (SELECT item_id, regexp_extract_all(concat('a **', replace(replace(text, '*', ''), '. ', '** b *'), '* c'), '(?s)\\*\\*.*?\\*\\*|\\*.*?\\*|[^*]+|\\*+') AS runs FROM benchmark) a) b) c""",
}
