"""Queries over logs of changes: upserts by batches, what needs a sync kept up with changes, and the views over the state of syncs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark.operators import queue
from quillspark.operators.pending import Pending
from quillspark.plans import oracles
from quillspark.plans.adapters import run, with_domain
from quillspark.plans.relational import MEANT
from quillspark.shared import folder
from quillspark.sources.log import ChangeLog


def _own(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    return run(spark, sf_dir, with_domain(sql))


def d2_upsert_log(spark, sf_dir):
    """d2_upsert as two batches of a log, each of which writes its own rows only."""
    rows = _own(spark, sf_dir, "SELECT item_id, content_hash, 0 AS retry_count, synced_ms, id FROM d_sync")
    log = ChangeLog(spark, folder(spark, "log"), ["item_id"], T.StructType(rows.schema.fields[:3]))
    log.put(rows, 0, F.col("synced_ms"), F.col("id"))
    log.put(_own(spark, sf_dir, "SELECT page_uuid AS item_id, sha256(text) AS content_hash, 0 AS retry_count FROM d_page WHERE page_number = 1"), 1)
    return log.view()


def _pending(spark, sf_dir) -> Pending:
    """Four batches: all pages in an old form under another notebook; their texts; successes, the newest first; and the other half of them."""
    own = Pending(spark, folder(spark, "pending"), buckets=16)
    page = f"page_uuid, notebook_uuid, sha256(text) AS text_hash, {MEANT} AS meant, updated_ms"
    pages = [_own(spark, sf_dir, f"SELECT {x} FROM d_page") for x in ("page_uuid, concat(notebook_uuid, '-old') AS notebook_uuid, md5(text) AS text_hash, TRUE AS meant, updated_ms", page)]
    syncs = _own(spark, sf_dir, "SELECT item_id AS page_uuid, content_hash, synced_ms, id FROM d_sync WHERE status = 'success' AND target = 'notion'")
    none, half = pages[0].limit(0), F.col("id") % 100 < 50
    for batch, (p, s) in enumerate([(pages[0], syncs.filter(~half & (F.col("id") % 2 == 0))), (pages[1], syncs.limit(0)), (none, syncs.filter(half)), (none, syncs.filter(~half))]):
        own.apply(p, s, batch)
        if batch == 1:
            own.compact(batch)
    return own


def c9_incremental(spark, sf_dir):
    """c9_unified kept up over batches of changes."""
    return _pending(spark, sf_dir).counts()


def c13_incremental(spark, sf_dir):
    """c13_page_plan kept up over batches of changes."""
    return _pending(spark, sf_dir).plan()


SYNC_STATE = "source_table string, source_id string, target string, remote_id string, status string, synced_ms bigint, metadata string"


def _state(spark, sf_dir) -> DataFrame:
    """The state of syncs as a log of two batches: records as pending, then as they are."""
    nb = "SELECT 'notebooks' AS source_table, notebook_uuid AS source_id, 'notion' AS target, concat('nt-', notebook_uuid) AS remote_id, CASE WHEN total_pages % 5 = 0 THEN 'failed' ELSE 'synced' END AS status, modified_ms AS synced_ms, md5(visible_name) AS content_hash, total_pages, CAST(NULL AS VARCHAR(20)) AS page_uuid, CAST(NULL AS BIGINT) AS exported_at FROM d_notebook"
    pg = "SELECT 'pages', concat(notebook_uuid, '|', page_number), target, max_by(external_id, struct(synced_ms, id)), max_by(status, struct(synced_ms, id)), max(synced_ms), max_by(content_hash, struct(synced_ms, id)), NULL, max_by(item_id, struct(synced_ms, id)), NULL FROM d_sync GROUP BY notebook_uuid, page_number, target"
    td = "SELECT 'todos', CAST(todo_id AS VARCHAR(20)), 'notion', notion_page_id, 'synced', exported_ms, NULL, NULL, NULL, exported_ms FROM d_todo_sync"
    rows = _own(spark, sf_dir, f"{nb} UNION ALL {pg} UNION ALL {td}").withColumn("metadata", F.to_json(F.struct("content_hash", "total_pages", "page_uuid", "exported_at")))
    log = ChangeLog(spark, folder(spark, "state"), ["source_table", "source_id", "target"], SYNC_STATE)
    log.put(rows.withColumn("status", F.lit("pending")), 0)
    log.put(rows, 1)
    return log.view()


def _field(name: str, kind: str = "string"):
    return F.get_json_object("metadata", f"$.{name}").try_cast(kind).alias(name)


def d12_view_notebooks(spark, sf_dir):
    own = _state(spark, sf_dir).filter("source_table = 'notebooks' and target = 'notion' and status = 'synced'")
    return own.select(F.col("source_id").alias("notebook_uuid"), F.col("remote_id").alias("notion_page_id"), "synced_ms", _field("content_hash"), _field("total_pages", "bigint"))


def d12_view_composite_pages(spark, sf_dir):
    own = _state(spark, sf_dir).filter("source_table = 'pages' and target = 'notion' and source_id like '%|%'")
    return own.select(F.substring_index("source_id", "|", 1).alias("notebook_uuid"), F.expr("try_cast(substr(source_id, instr(source_id, '|') + 1) as bigint)").alias("page_number"), _field("page_uuid"), _field("content_hash"), "synced_ms", F.col("remote_id").alias("notion_block_id"))


def d12_view_todos(spark, sf_dir):
    own = _state(spark, sf_dir).filter("source_table = 'todos' and target = 'notion' and status = 'synced'")
    return own.select(F.col("source_id").try_cast("bigint").alias("todo_id"), F.col("remote_id").alias("notion_page_id"), _field("exported_at", "bigint"), "synced_ms")


def d12_pending_changes(spark, sf_dir):
    """Pending changes with the states of their rows, in order of time."""
    log = _own(spark, sf_dir, "SELECT id AS changelog_id, source_table, CASE WHEN source_table = 'notebooks' THEN concat('nb-', source_id) ELSE source_id END AS source_id, operation, changed_ms FROM d_log WHERE status = 'pending'")
    state = _state(spark, sf_dir).select("source_table", "source_id", "target", "remote_id", "status", "synced_ms")
    return log.join(state, ["source_table", "source_id"], "left").orderBy("changed_ms", "changelog_id")


def d12_health(spark, sf_dir):
    return _state(spark, sf_dir).groupBy("target", "status").agg(F.count("*").alias("records"), F.min("synced_ms").alias("oldest_ms"), F.max("synced_ms").alias("latest_ms"))


ROUTES = "SELECT 'notebooks' AS source_table, 'notion' AS target UNION ALL SELECT 'pages', 'notion' UNION ALL SELECT 'todos', 'notion' UNION ALL SELECT 'highlights', 'readwise'"


def e4_queue(spark, sf_dir):
    """All pending changes with the target that takes them, in batches of ten by time."""
    own = _own(spark, sf_dir, f"SELECT g.id, g.changed_ms, c.target FROM d_log g JOIN ({ROUTES}) c ON c.source_table = g.source_table WHERE g.status = 'pending'")
    return queue.admit(own, ["changed_ms", "id"], folder(spark, "queue")).select("id", "target", "place", "batch")


_ALL = (e4_queue, d2_upsert_log, c9_incremental, c13_incremental, d12_view_notebooks, d12_view_composite_pages, d12_view_todos, d12_pending_changes, d12_health)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in _ALL}

_NEWEST = "(SELECT * FROM d_sync s WHERE NOT EXISTS (SELECT 1 FROM d_sync t WHERE t.notebook_uuid = s.notebook_uuid AND t.page_number = s.page_number AND t.target = s.target AND (t.synced_ms > s.synced_ms OR t.synced_ms = s.synced_ms AND t.id > s.id)))"
_BOOKS = "(SELECT *, if(total_pages % 5 = 0, 'failed', 'synced') AS status FROM d_notebook)"
ORACLE = {
    "e4_queue": "SELECT id, if(source_table = 'highlights', 'readwise', 'notion') AS target, row_number() OVER (ORDER BY changed_ms, id) - 1 AS place, (row_number() OVER (ORDER BY changed_ms, id) - 1) // 10 AS batch FROM d_log WHERE status = 'pending'",
    "d2_upsert_log": "SELECT item_id, content_hash, 0 AS retry_count FROM d_sync s WHERE item_id NOT IN (SELECT page_uuid FROM d_page WHERE page_number = 1) AND NOT EXISTS (SELECT 1 FROM d_sync t WHERE t.item_id = s.item_id AND (t.synced_ms > s.synced_ms OR t.synced_ms = s.synced_ms AND t.id > s.id)) UNION ALL SELECT page_uuid, sha256(text), 0 FROM d_page WHERE page_number = 1",
    "c9_incremental": oracles.SQL["c9_unified"],
    "c13_incremental": oracles.SQL["c13_page_plan"],
    "d12_view_notebooks": f"SELECT notebook_uuid, 'nt-' || notebook_uuid AS notion_page_id, modified_ms AS synced_ms, md5(visible_name) AS content_hash, total_pages FROM {_BOOKS} b WHERE status = 'synced'",
    "d12_view_composite_pages": f"SELECT notebook_uuid, page_number, item_id AS page_uuid, content_hash, synced_ms, external_id AS notion_block_id FROM {_NEWEST} n WHERE target = 'notion'",
    "d12_view_todos": "SELECT todo_id, notion_page_id, exported_ms AS exported_at, exported_ms AS synced_ms FROM d_todo_sync",
    "d12_pending_changes": f"""SELECT g.id AS changelog_id, g.source_table, if(g.source_table = 'notebooks', 'nb-', '') || g.source_id AS source_id, g.operation, g.changed_ms, s.target, s.remote_id, s.status, s.synced_ms FROM d_log g LEFT JOIN (
        SELECT 'notebooks' AS t, notebook_uuid AS id, 'notion' AS target, 'nt-' || notebook_uuid AS remote_id, status, modified_ms AS synced_ms FROM {_BOOKS} b
        UNION ALL SELECT 'todos', CAST(todo_id AS VARCHAR), 'notion', notion_page_id, 'synced', exported_ms FROM d_todo_sync) s
        ON s.t = g.source_table AND s.id = if(g.source_table = 'notebooks', 'nb-', '') || g.source_id WHERE g.status = 'pending'""",
    "d12_health": f"SELECT target, status, count(*) AS records, min(synced_ms) AS oldest_ms, max(synced_ms) AS latest_ms FROM (SELECT target, status, synced_ms FROM {_NEWEST} n UNION ALL SELECT 'notion', status, modified_ms FROM {_BOOKS} b UNION ALL SELECT 'notion', 'synced', exported_ms FROM d_todo_sync) x GROUP BY target, status",
}
