"""What the queries must return, asked of DuckDB in another way than the queries ask Spark.

Where a query joins and sums, its oracle looks each row's answer up in correlated subqueries, as row-at-a-time code would; where it
ranks, the oracle compares with all others; regular expressions are matched against list functions. Both read the same domain views.
"""

from __future__ import annotations

from quillspark.plans.adapters import DAY, NOW
from quillspark.plans.relational import READ_AGAIN

#: The hash of the newest successful record of page p at a target, and its time: newest time, then largest id.
_HASH = "(SELECT s.content_hash FROM d_sync s WHERE s.status = 'success' AND s.item_id = p.page_uuid AND s.target = {t} ORDER BY s.synced_ms DESC, s.id DESC LIMIT 1)"
_TIME = "(SELECT max(s.synced_ms) FROM d_sync s WHERE s.status = 'success' AND s.item_id = p.page_uuid AND s.target = {t})"
_N_HASH, _N_TIME = _HASH.format(t="'notion'"), _TIME.format(t="'notion'")
#: A row for each page and each target that has a successful record of it, and one with nulls where there is none.
_EACH = f"(SELECT p.*, t.target, {_HASH.format(t='t.target')} AS h, {_TIME.format(t='t.target')} AS ms FROM d_page p JOIN (SELECT DISTINCT item_id, target FROM d_sync WHERE status = 'success') t ON t.item_id = p.page_uuid UNION ALL SELECT p.*, NULL, NULL, NULL FROM d_page p WHERE p.page_uuid NOT IN (SELECT item_id FROM d_sync WHERE status = 'success'))"
_LETTERS = "len(list_filter(string_split(text, ''), lambda c: regexp_full_match(c, '\\p{L}'))) / len(string_split(text, ''))"
_SYMBOLS = "len(list_filter(string_split(text, ''), lambda c: NOT regexp_full_match(c, '[\\p{L}\\p{N}\\s]'))) / len(string_split(text, ''))"
_WORDS = "len(list_filter(regexp_split_to_array(text, '[ \\t\\n\\r\\f]+'), lambda w: w <> ''))"
_RUN = "len(list_filter(regexp_split_to_array(text, '[\\p{L}\\p{N}\\s]+'), lambda r: len(r) > 3)) > 0"
#: Of a log's rows in order: those that no stored row with the same key came before within five minutes.
_STORED = """WITH RECURSIVE keyed AS (SELECT id, changed_ms, hash_after, concat_ws('|', source_table, source_id, operation, hash_after) AS k, row_number() OVER (PARTITION BY source_table, source_id, operation, hash_after ORDER BY changed_ms, id) AS n FROM d_log WHERE hash_after IS NOT NULL),
 walk AS (SELECT id, k, n, changed_ms AS stored, true AS keep FROM keyed WHERE n = 1 UNION ALL SELECT x.id, x.k, x.n, CASE WHEN x.changed_ms - w.stored > 300000 THEN x.changed_ms ELSE w.stored END, x.changed_ms - w.stored > 300000 FROM walk w JOIN keyed x ON x.k = w.k AND x.n = w.n + 1)
 SELECT id FROM walk WHERE keep UNION ALL SELECT id FROM d_log WHERE hash_after IS NULL"""


def _spaced(rows: str, key: str, columns: str, us: str, gap: int) -> str:
    """Of rows (key, moment, tie) in order: those that come gap or more after the last one of their key that did."""
    return f"""WITH RECURSIVE keyed AS (SELECT *, {us} AS us, row_number() OVER (PARTITION BY {key} ORDER BY moment, tie) AS n FROM ({rows}) r),
 walk AS (SELECT {key}, moment, tie, n, us AS stored, true AS keep FROM keyed WHERE n = 1 UNION ALL SELECT x.{key}, x.moment, x.tie, x.n, CASE WHEN x.us - w.stored >= {gap} THEN x.us ELSE w.stored END, x.us - w.stored >= {gap} FROM walk w JOIN keyed x ON x.{key} = w.{key} AND x.n = w.n + 1)
 SELECT {columns} FROM walk WHERE keep"""


def _joined(text: str, between: str, order: str) -> str:
    return f"(SELECT array_to_string(list(t ORDER BY o), '{between}') FROM (SELECT {text} AS t, {order} AS o FROM d_page p WHERE p.notebook_uuid = n.notebook_uuid) l)"


def _json(text: str) -> str:
    """A JSON string of ASCII characters."""
    escaped = "CASE WHEN c = '' THEN '' WHEN c IN ('\"', '\\') THEN '\\' || c WHEN c = chr(10) THEN '\\n' WHEN c = chr(13) THEN '\\r' WHEN c = chr(9) THEN '\\t' WHEN c = chr(8) THEN '\\b' WHEN c = chr(12) THEN '\\f' WHEN ord(c) BETWEEN 32 AND 126 THEN c WHEN ord(c) < 65536 THEN '\\u' || format('{:04x}', ord(c)) ELSE '\\u' || format('{:04x}', 55296 + ((ord(c) - 65536) >> 10)) || '\\u' || format('{:04x}', 56320 + ((ord(c) - 65536) & 1023)) END"
    return f"""('"' || array_to_string(list_transform(string_split({text}, ''), lambda c: {escaped}), '') || '"')"""


_BOOKS = "(SELECT DISTINCT notebook_uuid FROM d_page) n"

SQL = {
    # change detection
    "c1_notebooks": f"SELECT notebook_uuid, count(*) FILTER (h IS NULL) AS new_pages, count(*) FILTER (h <> sha256(text)) AS changed_pages, CAST(bool_or(h IS NULL OR h <> sha256(text)) AS INTEGER) AS needs_sync FROM (SELECT p.*, {_N_HASH} AS h FROM d_page p) x GROUP BY notebook_uuid",
    "c2_todos": "SELECT id, if(completed, 'completed_todo', if(h IS NULL, 'never_synced_to_target', if(h = sha256(text), 'no_changes', 'content_changed'))) AS reason FROM (SELECT t.*, (SELECT max(g.hash_after) FROM d_log g WHERE g.source_table = 'todos' AND g.status = 'processed' AND TRY_CAST(g.source_id AS BIGINT) = t.id) AS h FROM d_todo t) x",
    "c3_highlights": "SELECT id, coalesce(if(h = sha256(original_text), 'no_changes', 'content_changed'), 'never_synced_to_target') AS reason FROM (SELECT t.*, (SELECT max(g.hash_after) FROM d_log g WHERE g.source_table = 'highlights' AND g.status = 'processed' AND TRY_CAST(g.source_id AS BIGINT) = t.id) AS h FROM d_highlight t) x WHERE h IS NOT NULL UNION ALL SELECT id, 'never_synced_to_target' FROM d_highlight t WHERE (SELECT max(g.hash_after) FROM d_log g WHERE g.source_table = 'highlights' AND g.status = 'processed' AND TRY_CAST(g.source_id AS BIGINT) = t.id) IS NULL",
    "c4_accessed": "SELECT notebook_uuid, CASE WHEN last_opened_ms IS NULL THEN false ELSE NOT EXISTS (SELECT 1 FROM d_sync s JOIN d_page p ON p.page_uuid = s.item_id WHERE p.notebook_uuid = n.notebook_uuid AND s.status = 'success' AND s.synced_ms >= n.last_opened_ms) END AS accessed FROM d_notebook n",
    "c5_page_state": f"SELECT notebook_uuid, page_number, if(h IS NULL, 'new', if(h = sha256(text), 'same', 'changed')) AS state FROM (SELECT p.*, {_N_HASH} AS h FROM d_page p) x",
    "c6_legacy_tracker": f"SELECT page_uuid, if(page_number > coalesce((SELECT count(DISTINCT s.page_number) FROM d_sync s WHERE s.status = 'success' AND s.notebook_uuid = x.notebook_uuid), 0), 'new', 'changed') AS kind FROM {_EACH} x WHERE h IS DISTINCT FROM sha256(text)",
    "c7_should_sync": f"SELECT notebook_uuid, bool_and(h IS NULL) AS is_new, bool_and(h IS NULL) OR bool_or(coalesce(h <> sha256(text), false)) OR bool_or(coalesce(updated_ms > ms, false)) AS should_sync FROM {_EACH} x GROUP BY notebook_uuid",
    "c8_unsynced": "SELECT notebook_uuid, count(*) AS pages, arg_max(updated_ms, updated_ms) AS last_ms FROM d_page WHERE notebook_uuid IN (SELECT notebook_uuid FROM d_page EXCEPT SELECT notebook_uuid FROM d_sync) GROUP BY notebook_uuid",
    "c9_unified": f"SELECT notebook_uuid, state, count(*) AS pages FROM (SELECT notebook_uuid, if(h IS NULL, 'NEVER_SYNCED', if(h = sha256(text), 'UP_TO_DATE', 'STALE')) AS state FROM (SELECT p.*, {_N_HASH} AS h FROM d_page p) x) y GROUP BY notebook_uuid, state",
    "c10_todos_enriched": "SELECT t.id, (SELECT n.visible_name FROM d_notebook n WHERE n.notebook_uuid = t.notebook_uuid) AS visible_name, s.external_id FROM d_todo t LEFT JOIN d_sync s ON s.notebook_uuid = t.notebook_uuid AND s.page_number = t.page_number AND s.status = 'success' WHERE NOT t.completed AND (SELECT z.content_hash FROM d_sync z WHERE z.status = 'success' AND z.item_id = s.item_id AND z.target = s.target ORDER BY z.synced_ms DESC, z.id DESC LIMIT 1) IS DISTINCT FROM sha256(t.text)",
    "c11_highlights_need": "SELECT h.id, (SELECT n.visible_name FROM d_notebook n WHERE n.notebook_uuid = h.notebook_uuid) AS visible_name FROM d_highlight h WHERE sha256(h.original_text) NOT IN (SELECT content_hash FROM d_sync WHERE status = 'success')",
    "c12_remote_need": "SELECT notebook_uuid, count(*) FILTER (needed) AS need, count(*) AS total FROM (SELECT p.notebook_uuid, s.id IS NULL OR s.content_hash IS DISTINCT FROM sha256(p.text) OR list_contains(['pending', 'failed'], s.status) AS needed FROM d_page p LEFT JOIN d_sync s ON s.item_id = p.page_uuid AND s.target = 'readwise') x GROUP BY notebook_uuid",
    "c13_page_plan": f"SELECT page_uuid, if(h IS NULL, 'missing', 'stale') AS why FROM (SELECT p.*, {_N_HASH} AS h FROM d_page p) x WHERE h IS DISTINCT FROM sha256(text) AND NOT regexp_matches(text, '(?i)this appears to be a blank|completely empty page')",
    "c15_metadata_upsert": "SELECT notebook_uuid, full_path, document_type = 'notebook' AS tracked FROM d_notebook WHERE document_type = 'epub' OR (length(notebook_uuid) % 2 = 1)",
    "c16_page_gate": "SELECT page_uuid FROM d_page WHERE text <> '' AND (notebook_uuid, page_number, sha256(text)) NOT IN (SELECT (notebook_uuid, page_number, content_hash) FROM d_sync)",
    "c17_reconcile": f"SELECT page_uuid, if(h IS NULL, 'never_synced', if(contains(lower(text), 'blank'), 'possibly_stale', 'ok')) AS category FROM {_EACH} x",
    "c18_pending_matrix": "SELECT kind, target, count(*) AS items, count(*) FILTER (done) AS synced, count(*) FILTER (NOT done) AS pending FROM (SELECT 'page' AS kind, t.target, EXISTS (SELECT 1 FROM d_sync s WHERE s.item_id = p.page_uuid AND s.target = t.target AND s.status = 'success') AS done FROM d_page p, (SELECT unnest(['notion', 'readwise', 'archive']) AS target) t UNION ALL SELECT 'todo', t.target, t.target = 'notion' AND p.id IN (SELECT todo_id FROM d_todo_sync) FROM d_todo p, (SELECT unnest(['notion', 'readwise', 'archive']) AS target) t UNION ALL SELECT 'highlight', t.target, t.target = 'readwise' AND EXISTS (SELECT 1 FROM d_log g WHERE g.source_table = 'highlights' AND g.status = 'processed' AND TRY_CAST(g.source_id AS BIGINT) = p.id) FROM d_highlight p, (SELECT unnest(['notion', 'readwise', 'archive']) AS target) t) x GROUP BY kind, target",
    "c19_baseline": "SELECT page_uuid, if(sha256(text) IN (SELECT content_hash FROM d_sync WHERE target = 'notion'), 'already_synced', 'needs_sync') AS state FROM d_page",
    "c21_risk": "SELECT source_table, if(n > 5000, 'high', if(n < 1000, 'low', 'medium')) AS risk FROM (SELECT DISTINCT source_table, count(*) OVER (PARTITION BY source_table) AS n FROM d_log) x",
    "c22_legacy_mappers": "SELECT DISTINCT h, min(k) OVER (PARTITION BY h) AS first_item, count(*) OVER (PARTITION BY h) AS n FROM (SELECT content_hash AS h, 'page_text ' || item_id AS k FROM d_sync WHERE status = 'success' UNION ALL SELECT sha256('todo|' || id), 'todo ' || id FROM d_todo WHERE completed UNION ALL SELECT sha256(original_text), 'highlight ' || id FROM d_highlight) x",
    "c24_backfill": "SELECT id, if(external_id IS NULL OR external_id = '', 'map-' || item_id, external_id) AS external_id FROM d_sync WHERE item_id IN (SELECT page_uuid FROM d_page)",
    "c25_page_backfill": "SELECT page_uuid, (notebook_uuid, page_number) IN (SELECT (notebook_uuid, page_number) FROM d_todo) AS is_remote FROM d_page p WHERE NOT EXISTS (SELECT 1 FROM d_sync s WHERE s.item_id = p.page_uuid AND s.status = 'success')",
    "c26_rehash": "SELECT id, old_hash, new_hash FROM (SELECT s.id, s.content_hash AS old_hash, (SELECT sha256(p.text) FROM d_page p WHERE p.page_uuid = s.item_id) AS new_hash FROM d_sync s) x WHERE new_hash IS NOT NULL AND new_hash <> old_hash",
    "c27_audit_flag": "SELECT page_uuid, (SELECT count(*) FILTER (external_id IS NOT NULL) > 1 OR count(*) FILTER (external_id IS NULL) > 0 FROM d_sync s WHERE s.item_id = p.page_uuid) AS possible_duplicate FROM d_page p",
    "c29_duplicate_books": "SELECT notebook_uuid FROM d_notebook WHERE authors IS NULL AND lower(visible_name[1:10]) IN (SELECT lower(visible_name[1:10]) FROM d_notebook WHERE authors IS NOT NULL)",
    # changelog
    "g1_dedup": _STORED,
    "g1_dedup_stream": _STORED,
    "r2_cooldown": _spaced("SELECT user_id, ts AS moment, event_id AS tie FROM events WHERE ts IS NOT NULL", "user_id", "user_id, tie AS event_id", "epoch_us(moment)", 21_600_000_000),
    "r3_lock": _spaced("SELECT notebook_uuid, synced_ms AS moment, id AS tie FROM d_sync", "notebook_uuid", "notebook_uuid, moment AS at_ms", "moment", 5000),
    "g3_pending": "SELECT g.id, s.target, s.status FROM (SELECT * FROM d_log WHERE status NOT IN ('failed', 'processed')) g LEFT JOIN (SELECT notebook_uuid, target, status FROM d_sync GROUP BY ALL) s ON substr(s.notebook_uuid, 4) = g.source_id",
    "g5_health": "SELECT count(*) AS total, count(*) FILTER (status = 'pending') AS pending, round(100.0 * count(*) FILTER (status = 'processed') / count(*), 1) AS rate, min(changed_ms) FILTER (status = 'pending') AS oldest FROM d_log",
    "g8_real_updates": "SELECT id FROM d_log g WHERE hash_after IS DISTINCT FROM (SELECT b.hash_after FROM d_log b WHERE b.source_table = g.source_table AND b.source_id = g.source_id AND (b.changed_ms, b.id) < (g.changed_ms, g.id) ORDER BY b.changed_ms DESC, b.id DESC LIMIT 1)",
    # sync engine
    "e2_deduplicate": "SELECT page_uuid, sha256(text) IN (SELECT content_hash FROM d_sync WHERE target = 'notion' AND status = 'success') AS is_duplicate FROM d_page",
    "e3_skip_rules": f"SELECT page_uuid, if({_N_HASH} IS NOT DISTINCT FROM sha256(text), 'SKIPPED', 'SYNC') AS action FROM d_page p",
    "e4_routing": "SELECT id, if(source_table = 'highlights', 'readwise', 'notion') AS target FROM d_log WHERE status = 'pending'",
    "e6_retry": f"SELECT id FROM d_sync WHERE status = 'retry' AND list_contains(range(0, 5), retry_count) AND {NOW} - synced_ms > 30000 * (1 << CAST(retry_count AS INTEGER))",
    "e8_transitions": "SELECT id, list_extract(['retry', 'failed', status], if(status = 'failed', if(retry_count < 5, 1, 2), 3)) AS next_status, retry_count + CAST(status = 'failed' AS INTEGER) AS retry_count FROM d_sync",
    "e9_batches": "SELECT notebook_uuid, batch, '[' || list_min(ps) || ',' || list_max(ps) || ']' AS item, len(ps) AS n FROM (SELECT notebook_uuid, (page_number - 1) // 25 AS batch, list(page_number) AS ps FROM d_page GROUP BY ALL) x",
    "e10_expansion": "SELECT page_uuid, if(notebook_uuid IN (SELECT notebook_uuid FROM d_sync WHERE status = 'success'), 'page', 'notebook') AS unit FROM d_page p WHERE NOT EXISTS (SELECT 1 FROM d_sync s WHERE s.item_id = p.page_uuid AND s.status = 'success')",
    "e13_payload": "SELECT id, left(original_text, 2000) AS text, 'page ' || page_number || if(confidence < 0.7, ' | low confidence', '') AS note FROM d_highlight WHERE length(original_text) > 9",
    "e14_todo_export": f"SELECT id, visible_name FROM (SELECT t.*, (SELECT n.full_path FROM d_notebook n WHERE n.notebook_uuid = t.notebook_uuid) AS path, (SELECT n.visible_name FROM d_notebook n WHERE n.notebook_uuid = t.notebook_uuid) AS visible_name FROM d_todo t) x WHERE NOT completed AND created_ms > {NOW - 66 * DAY} AND path NOT ILIKE '%archive%'",
    "e16_find_book": "SELECT notebook_uuid, (SELECT min(b.notebook_uuid) FROM d_notebook b WHERE b.authors = a.authors AND trim(lower(b.visible_name)) = trim(lower(a.visible_name))) AS book FROM d_notebook a WHERE authors IS NOT NULL",
    # fingerprints
    "x1_notebook_hash": "SELECT notebook_uuid, sha256('{\"author\": ' || " + _json("trim(ifnull(authors, ''))") + " || ', \"page_count\": ' || total_pages || ', \"text_content\": ' || " + _json("trim(t)") + " || ', \"title\": ' || " + _json("trim(visible_name)") + " || ', \"type\": \"notebook\"}') AS h FROM (SELECT n.*, " + _joined("text", chr(10), "page_number") + " AS t FROM d_notebook n) x",
    "x2_page_hash": "SELECT page_uuid, sha256('{\"confidence\": ' || confidence || ', \"notebook_uuid\": \"' || notebook_uuid || '\", \"page_number\": ' || page_number || ', \"text\": ' || " + _json("trim(text)") + " || ', \"type\": \"page_text\"}') AS h FROM d_page",
    "x3_todo_hash": "SELECT id, sha256('{\"notebook_uuid\": \"' || notebook_uuid || '\", \"page_number\": ' || page_number || ', \"text\": ' || " + _json("trim(text)") + " || ', \"type\": \"todo\"}') AS h FROM d_todo",
    "x4_highlight_hash": "SELECT id, sha256('{\"corrected_text\": ' || " + _json("trim(ifnull(corrected_text, ''))") + " || ', \"page_number\": \"' || page_number || '\", \"source_file\": \"' || notebook_uuid || '.content\", \"text\": ' || " + _json("trim(original_text)") + " || ', \"type\": \"highlight\"}') AS h FROM d_highlight",
    "x6_notebook_md5": f"SELECT notebook_uuid, md5({_joined(chr(39) + 'page_' + chr(39) + ' || page_number || ' + chr(39) + ':' + chr(39) + ' || text', '|', 'page_number')}) AS h FROM {_BOOKS}",
    "x7_metadata_md5": "SELECT notebook_uuid, md5(format('path:{}|modified:{}|opened:{}', ifnull(full_path, ''), modified_ms, ifnull(last_opened_ms::VARCHAR, ''))) AS h FROM d_notebook",
    "x8_page_md5": "SELECT page_uuid, md5(format('{}:{}', text, confidence)) AS h FROM d_page",
    "x9_page_sha": "SELECT page_uuid, lower(hex(unhex(sha256(encode(text))))) AS h FROM d_page",
    "x11_changelog_sha": "SELECT id, sha256('table:' || source_table || '|op:' || operation || ifnull('|hash:' || hash_after, '')) AS h FROM d_log",
    "x12_target_md5": f"SELECT notebook_uuid, md5({_joined(chr(39) + 'page_' + chr(39) + ' || page_number || ' + chr(39) + ':' + chr(39) + ' || text || ' + chr(39) + ':' + chr(39) + ' || confidence', '|', 'page_number')}) AS h FROM {_BOOKS}",
    "x13_full_text_md5": f"SELECT notebook_uuid, md5({_joined('text', '', 'page_number')}) AS h FROM {_BOOKS}",
    "c28_uuid_baseline": f"SELECT notebook_uuid, 'uuid' AS match_method, md5({_joined('text', '', 'page_number')}) AS h FROM {_BOOKS} WHERE EXISTS (SELECT 1 FROM d_sync s WHERE s.notebook_uuid = n.notebook_uuid)",
    # text functions
    "f1_clean": "SELECT doc_id, array_to_string(list_filter(regexp_split_to_array(array_to_string(list_filter(string_split(text, ''), lambda c: ord(c) > 31 OR ord(c) IN (9, 10, 13)), ''), '[ \\t\\n\\r]+'), lambda w: w <> ''), ' ') AS clean FROM documents",
    "f2_normalise": "SELECT doc_id, array_to_string(list_filter(regexp_split_to_array(lower(text), '[ \\t\\n\\r]+'), lambda w: w <> ''), ' ') AS clean FROM documents",
    "f4_quality": f"SELECT doc_id, length(text) >= 15 AND {_LETTERS} > 0.6 AND {_SYMBOLS} < 0.2 AND {_WORDS} >= 3 AND NOT {_RUN} AS good FROM documents WHERE text <> ''",
    "f5_gibberish": f"SELECT doc_id FROM documents WHERE text <> '' AND NOT (length(text) >= 15 AND {_LETTERS} >= 0.6 AND {_SYMBOLS} <= 0.2 AND {_WORDS} >= 3 AND NOT {_RUN})",
    "f6_confidence": f"SELECT doc_id, round(least(1.0, if(length(text) < 20, 0.8::DOUBLE, 1.0::DOUBLE) * if(list_contains(['.', '!', '?'], right(text, 1)), 1.1::DOUBLE, 1.0::DOUBLE) * if({_SYMBOLS} >= 0.2, 0.7::DOUBLE, 1.0::DOUBLE)), 9) AS confidence FROM documents WHERE text <> ''",
    "f11_demotion": "SELECT id, round(confidence * if(corrected_text IS NULL, 0.9::DOUBLE, 1.0::DOUBLE), 9) AS confidence FROM d_highlight",
    "f14_iso_date": "SELECT id, strftime(strptime(actual_date, '%Y-%m-%d'), '%Y-%m-%d') AS iso FROM d_todo WHERE actual_date IS NOT NULL",
    "f18_truncate": "SELECT doc_id, if(length(text) > 2000, left(text, 1997) || '...', text) AS short FROM documents",
    "f20_category": "SELECT notebook_uuid, map_extract_value(MAP {'epub': 'books', 'pdf': 'articles', 'notebook': 'books'}, document_type) AS category, if(length(ifnull(authors, '')) = 0, 'Unknown', authors) AS author FROM d_notebook",
    "f21_note": "SELECT id, array_to_string(list_filter(['Page ' || page_number, if(confidence < 0.5, 'Low confidence', NULL), if(corrected_text IS NULL, NULL, 'Corrected')], lambda x: x IS NOT NULL), ' | ') AS note FROM d_highlight",
    "f23_reasons": f"SELECT page_uuid, if(len(r) = 0, 'no_changes', array_to_string(r, ', ')) AS reasons FROM (SELECT page_uuid, list_concat(if(h <> sha256(text), ['content_changed'], []), if(updated_ms > ms, ['accessed_since_sync'], [])) AS r FROM {_EACH} x WHERE h IS NOT NULL) y",
    "p9_status_case": f"SELECT page_uuid, if(ms IS NULL, 'NEVER SYNCED', if(updated_ms > ms, 'CONTENT_NEWER_THAN_SYNC', 'UP_TO_DATE')) AS state FROM (SELECT p.*, {_N_TIME} AS ms FROM d_page p) x",
    # predicates
    "p1_nonempty_text": "SELECT page_uuid, len(text) AS n FROM d_page WHERE len(ifnull(text, '')) NOT BETWEEN 0 AND 50",
    "p2_not_blank": "SELECT page_uuid FROM d_page WHERE NOT regexp_matches(text, '(?i)this appears to be a blank|completely empty page')",
    "p3_not_archived": "SELECT notebook_uuid FROM d_notebook WHERE NOT contains(lower(full_path), 'archive')",
    "p7_file_names": "SELECT page_id, url FROM pages WHERE regexp_matches(url, '[.]html?$')",
    "p12_json_path": "SELECT id, (props::JSON ->> 'k')::BIGINT AS k FROM d_log",
    "p13_split_key": "SELECT notebook_uuid, page_number FROM d_page",
    "p14_author_suffix": "SELECT notebook_uuid, visible_name AS title FROM d_notebook WHERE authors IS NOT NULL",
    "p15_md5_rows": "SELECT id FROM d_highlight WHERE id % 2 = 0",
    # joins
    "j1_inner": "SELECT (SELECT n.visible_name FROM d_notebook n WHERE n.notebook_uuid = h.notebook_uuid) AS visible_name, id FROM d_highlight h WHERE notebook_uuid IN (SELECT notebook_uuid FROM d_notebook)",
    "j2_left_dimension": "SELECT id, (SELECT n.visible_name FROM d_notebook n WHERE n.notebook_uuid = t.notebook_uuid) AS visible_name FROM d_todo t",
    "j5_composite_key": "SELECT id, (SELECT p.page_uuid FROM d_page p WHERE (p.notebook_uuid, p.page_number) = (t.notebook_uuid, t.page_number)) AS page_uuid FROM d_todo t",
    "j6_anti": "SELECT page_uuid FROM d_page EXCEPT ALL SELECT DISTINCT item_id FROM d_sync",
    "j8_semi": "SELECT page_uuid FROM d_page p WHERE EXISTS (SELECT 1 FROM d_notebook n WHERE n.notebook_uuid = p.notebook_uuid AND n.document_type <> 'notebook')",
    "j9_not_in": "SELECT page_uuid FROM d_page p WHERE NOT EXISTS (SELECT 1 FROM d_sync s WHERE s.item_id = p.page_uuid)",
    "j12_scalar_subquery": "SELECT n.notebook_uuid, max(p.page_number) AS last_page FROM d_notebook n LEFT JOIN d_page p USING (notebook_uuid) GROUP BY n.notebook_uuid",
    "j14_through_second": "SELECT s.id FROM d_sync s JOIN d_notebook n USING (notebook_uuid) WHERE n.document_type = 'pdf'",
    # aggregations, windows, limits
    "a4_distinct": "SELECT len(list_distinct(list(notebook_uuid))) AS books, len(list_distinct(list(notebook_uuid) FILTER (confidence > 0.5))) AS sure FROM d_highlight",
    "a5_rates": "SELECT target, count(*) FILTER (status = 'success') AS ok, round(100.0 * count(*) FILTER (status = 'success') / count(*), 1) AS rate FROM d_sync GROUP BY target",
    "a7_text": f"SELECT notebook_uuid, {_joined('text', chr(10) + chr(10), 'page_number')} AS text FROM {_BOOKS}",
    "a10_duplicates": "SELECT id, min(id) OVER w AS keep, count(*) OVER w AS n FROM d_todo WINDOW w AS (PARTITION BY text) QUALIFY count(*) OVER w > 1",
    "a11_singletons": "SELECT count(*) AS n FROM d_todo a WHERE NOT EXISTS (SELECT 1 FROM d_todo b WHERE b.text = a.text AND b.id <> a.id)",
    "a12_gaps": "SELECT notebook_uuid, gap FROM (SELECT notebook_uuid, total_pages - (SELECT count(DISTINCT s.page_number) FROM d_sync s WHERE s.notebook_uuid = n.notebook_uuid AND s.status = 'success') AS gap FROM d_notebook n) x WHERE gap > 0",
    "a13_no_blocks": "SELECT DISTINCT notebook_uuid FROM d_sync WHERE external_id IS NULL",
    "a16_matrix": "SELECT target, count(*) FILTER (status = 'success') AS success, count(*) FILTER (status = 'failed') AS failed, count(*) FILTER (status = 'retry') AS retry, count(*) FILTER (status = 'pending') AS pending FROM d_sync GROUP BY target",
    "a20_export_stats": f"SELECT (SELECT count(*) FROM d_todo) AS total, (SELECT count(*) FROM d_todo WHERE created_ms > {NOW - 64 * DAY}) AS recent, (SELECT count(DISTINCT todo_id) FROM d_todo_sync) AS exported, round(100.0 * (SELECT count(DISTINCT todo_id) FROM d_todo_sync) / (SELECT count(*) FROM d_todo WHERE actual_date IS NOT NULL), 1) AS pct",
    "w1_latest_success": "SELECT item_id, target, content_hash FROM d_sync s WHERE status = 'success' AND NOT EXISTS (SELECT 1 FROM d_sync z WHERE z.status = 'success' AND z.item_id = s.item_id AND z.target = s.target AND z.item_type = s.item_type AND (z.synced_ms, z.id) > (s.synced_ms, s.id))",
    "w2_keep_first": "SELECT id, text FROM d_todo QUALIFY row_number() OVER (PARTITION BY text ORDER BY id) = 1",
    "w4_predecessor": "SELECT page_uuid, (SELECT b.page_uuid FROM d_page b WHERE b.notebook_uuid = a.notebook_uuid AND b.page_number > a.page_number ORDER BY b.page_number LIMIT 1) AS after_page FROM d_page a",
    "w5_newest_pages": "SELECT page_uuid FROM d_page a WHERE (SELECT count(*) FROM d_page b WHERE b.notebook_uuid = a.notebook_uuid AND b.page_number > a.page_number) < 50",
    "o6_gap_order": "SELECT notebook_uuid, total_pages - (SELECT count(DISTINCT s.page_number) FROM d_sync s WHERE s.notebook_uuid = n.notebook_uuid AND s.status = 'success') AS gap FROM d_notebook n ORDER BY gap DESC, notebook_uuid LIMIT 10",
    "u2_page_sets": "SELECT DISTINCT notebook_uuid, page_number FROM d_page WHERE (notebook_uuid, page_number) NOT IN (SELECT (notebook_uuid, page_number) FROM d_sync WHERE status = 'success')",
    "d1_insert_or_ignore": "SELECT id, text FROM d_todo WHERE text NOT IN (SELECT original_text FROM d_highlight) QUALIFY row_number() OVER (PARTITION BY text ORDER BY id) = 1",
    "d4_partial_update": "SELECT id, if(retry_count > 5, 'archived', status) AS status, content_hash FROM d_sync",
    "d7_cleanup": f"SELECT id FROM d_sync WHERE status <> 'failed' OR retry_count < 3 OR synced_ms >= {NOW - DAY}",
    "d8_cascade": "SELECT id FROM d_sync WHERE notebook_uuid NOT IN (SELECT notebook_uuid FROM d_notebook WHERE document_type = 'epub')",
    "n6_read_again": f"SELECT id FROM ({READ_AGAIN}) a EXCEPT ALL SELECT min(id) FROM ({READ_AGAIN}) b GROUP BY notebook_uuid, page_number, text, coalesce(actual_date, '')",
    "n6_without_date": f"SELECT id FROM ({READ_AGAIN}) a EXCEPT ALL SELECT coalesce(min(id) FILTER (actual_date IS NOT NULL), min(id)) FROM ({READ_AGAIN}) b GROUP BY notebook_uuid, page_number, text",
    "n6_natural_key": "SELECT id FROM d_todo a WHERE EXISTS (SELECT 1 FROM d_todo b WHERE b.id < a.id AND b.notebook_uuid = a.notebook_uuid AND b.page_number = a.page_number AND b.text = a.text AND b.actual_date IS NOT DISTINCT FROM a.actual_date)",
    "s15_restore": "SELECT notebook_uuid, page_uuid, page_number FROM d_page WHERE page_number % 3 = 0",
    "s18_allow_list": "SELECT notebook_uuid FROM d_notebook WHERE visible_name IN ('Notebook 1', 'Notebook 7')",
    # the rest, by other operators of SQL
    "p4_in_list": "SELECT notebook_uuid, visible_name FROM d_notebook WHERE list_contains(['nb-1', 'nb-5', 'nb-8'], notebook_uuid) AND list_contains(['notebook', 'pdf'], document_type)",
    "p5_recent": f"SELECT id, created_ms FROM d_highlight EXCEPT ALL SELECT id, created_ms FROM d_highlight WHERE created_ms <= {NOW - 60 * DAY}",
    "p6_excluded_notebooks": "SELECT notebook_uuid FROM d_notebook WHERE NOT regexp_matches(visible_name, '^Notebook (2$|1)|(?i)book 33')",
    "p8_page_range": "SELECT page_uuid, page_number FROM d_page WHERE page_number IN (SELECT unnest(range(2, 5)))",
    "p10_preview": "SELECT id, left(if(corrected_text IS NULL, original_text, corrected_text), 100) AS preview, left(original_text, 50) || if(length(original_text) > 50, '...', '') AS short FROM d_highlight",
    "p11_epoch_seconds": "SELECT notebook_uuid, epoch(to_timestamp(last_opened_ms // 1000))::BIGINT AS opened_s FROM d_notebook",
    "p17_id_compare": "SELECT if(external_id IS NULL, 'missing', 'real') AS kind, count(*) AS n FROM (SELECT s.external_id FROM d_sync s WHERE s.item_id IN (SELECT page_uuid FROM d_page) UNION ALL SELECT NULL FROM d_page WHERE page_uuid NOT IN (SELECT item_id FROM d_sync)) x GROUP BY 1 HAVING kind <> 'real' UNION ALL SELECT if(translate(substr(s.external_id, 4), '-', '') = translate(substr(s.item_id, 4), '-', ''), 'dash_only', 'real'), count(*) FROM d_sync s WHERE s.external_id IS NOT NULL AND s.item_id IN (SELECT page_uuid FROM d_page) GROUP BY 1",
    "p18_deep_link": "SELECT id, format('https://notes.example/{}#{}', translate(notebook_uuid, '-', ''), translate(external_id, '-', '')) AS link FROM d_sync WHERE external_id IS NOT NULL",
    "j3_left_on_predicates": "SELECT item_id AS page_uuid, id AS sync_id FROM d_sync WHERE target = 'notion' AND status = 'success' AND item_id IN (SELECT page_uuid FROM d_page) UNION ALL SELECT page_uuid, NULL FROM d_page p WHERE NOT EXISTS (SELECT 1 FROM d_sync s WHERE s.item_id = p.page_uuid AND s.target = 'notion' AND s.status = 'success')",
    "j4_cast_key": "SELECT TRY_CAST(source_id AS BIGINT) AS id, operation, count(*) AS n FROM d_log WHERE TRY_CAST(source_id AS BIGINT) IN (SELECT id FROM d_todo) GROUP BY ALL UNION ALL SELECT id, NULL, 0 FROM d_todo WHERE CAST(id AS VARCHAR) NOT IN (SELECT source_id FROM d_log)",
    "j7_changed_or_new": "SELECT s.item_id AS page_uuid FROM d_sync s JOIN d_page p ON p.page_uuid = s.item_id WHERE s.status = 'success' AND NOT sha256(p.text) = s.content_hash UNION ALL SELECT page_uuid FROM d_page WHERE page_uuid NOT IN (SELECT item_id FROM d_sync WHERE status = 'success')",
    "j10_two_targets": "SELECT page_uuid, unnest(coalesce((SELECT list(s.status) FROM d_sync s WHERE s.item_id = p.page_uuid AND s.target = 'notion'), [NULL])) AS notion, (SELECT s.status FROM d_sync s WHERE s.item_id = p.page_uuid AND s.target = 'readwise') AS readwise FROM d_page p",
    "j11_chain": "SELECT x.id, (SELECT n.visible_name FROM d_notebook n WHERE n.notebook_uuid = x.notebook_uuid) AS visible_name, page_uuid, unnest(coalesce((SELECT list(s.external_id) FROM d_sync s WHERE s.item_id = x.page_uuid AND s.status = 'success'), [NULL])) AS external_id FROM (SELECT t.*, (SELECT p.page_uuid FROM d_page p WHERE p.notebook_uuid = t.notebook_uuid AND p.page_number = t.page_number) AS page_uuid FROM d_todo t WHERE NOT completed) x",
    "j13_computed_key": "SELECT page_uuid, unnest(coalesce((SELECT list(s.id) FROM d_sync s WHERE s.external_id IS NULL AND s.notebook_uuid = p.notebook_uuid AND s.page_number = p.page_number), [NULL])) AS sync_id FROM d_page p",
    "j15_full_lookup": "SELECT notebook_uuid, (SELECT n.visible_name FROM d_notebook n WHERE n.notebook_uuid = k.notebook_uuid) AS visible_name, nullif((SELECT count(*) FROM d_todo t WHERE t.notebook_uuid = k.notebook_uuid), 0) AS n FROM (SELECT notebook_uuid FROM d_notebook UNION SELECT notebook_uuid FROM d_todo) k",
    "a1_counts": "SELECT unnest(['pages', 'todos', 'syncs', 'log']) AS name, unnest([(SELECT count(*) FROM d_page), (SELECT count(*) FROM d_todo), (SELECT count(*) FROM d_sync), (SELECT count(*) FROM d_log)]) AS n",
    "a2_by_status": "SELECT DISTINCT target, item_type, status, count(*) OVER (PARTITION BY target, item_type, status) AS n FROM d_sync",
    "a3_min_max": "SELECT DISTINCT target, item_type, status, count(*) OVER w AS n, first_value(synced_ms) OVER (w ORDER BY synced_ms) AS first_ms, first_value(synced_ms) OVER (w ORDER BY synced_ms DESC) AS last_ms FROM d_sync WINDOW w AS (PARTITION BY target, item_type, status)",
    "a6_rollup": "SELECT notebook_uuid, len(l) AS pages, list_sum(list_transform(l, lambda x: length(x.t)))::BIGINT AS total_characters, round(list_avg(list_transform(l, lambda x: x.c)), 9) AS confidence, list_min(list_transform(l, lambda x: x.u)) AS first_ms, list_max(list_transform(l, lambda x: x.u)) AS last_ms FROM (SELECT notebook_uuid, list({'t': text, 'c': confidence, 'u': updated_ms}) AS l FROM d_page GROUP BY notebook_uuid) x WHERE list_sum(list_transform(l, lambda x: length(x.t))) > 1000",
    "a8_top_groups": "SELECT authors, n FROM (SELECT authors, sum(n)::BIGINT AS n, row_number() OVER (ORDER BY sum(n) DESC, authors) AS k FROM (SELECT b.authors, (SELECT count(*) FROM d_highlight h WHERE h.notebook_uuid = b.notebook_uuid) AS n FROM d_notebook b WHERE b.authors IS NOT NULL) x WHERE n > 0 GROUP BY authors) y WHERE k <= 5",
    "a9_books": "SELECT notebook_uuid, visible_name, authors, n FROM (SELECT b.*, (SELECT count(*) FROM d_highlight h WHERE h.notebook_uuid = b.notebook_uuid) AS n FROM d_notebook b) x WHERE n > 0",
    "a14_dates": "SELECT actual_date, len(l) AS n, list_min(l) AS first_id, list_max(l) AS last_id FROM (SELECT actual_date, list(id) AS l FROM d_todo GROUP BY actual_date) x WHERE actual_date IS NOT NULL",
    "a15_pending": "SELECT source_table, operation, len(l) AS n, list_min(l) AS oldest, list_max(l) AS newest FROM (SELECT source_table, operation, list(changed_ms) FILTER (status = 'pending') AS l FROM d_log GROUP BY ALL) x WHERE l IS NOT NULL",
    "a17_nested_pages": f"SELECT notebook_uuid, {_joined(chr(39) + 'page_' + chr(39) + ' || page_number || ' + chr(39) + ':' + chr(39) + ' || length(text)', '|', 'page_number')} AS pages FROM {_BOOKS}",
    "a18_cost": "SELECT document_type, coalesce(sum(total_pages) FILTER (document_type = 'notebook'), 0)::BIGINT AS paid_pages, round(coalesce(sum(total_pages * 0.003::DOUBLE) FILTER (document_type = 'notebook'), 0), 6) AS cost FROM d_notebook GROUP BY document_type",
    "a19_results": "SELECT result, count(*) AS n FROM (SELECT coalesce(map_extract_value(MAP {'success': 'success', 'failed': 'failed'}, status), 'skipped') AS result FROM d_sync) x GROUP BY result",
    "a21_version": "SELECT version, version < 6 AS pending FROM d_migration ORDER BY version DESC LIMIT 1",
    "a22_recent_first": "SELECT notebook_uuid, len(l) AS n, l[1] AS last_ms FROM (SELECT notebook_uuid, list(created_ms ORDER BY created_ms DESC) AS l FROM d_highlight GROUP BY notebook_uuid) x",
    "o1_newest": "SELECT id, changed_ms FROM (SELECT *, row_number() OVER (ORDER BY changed_ms DESC, id) AS k FROM d_log) x WHERE k <= 20",
    "o2_nulls_last": "SELECT id, actual_date FROM (SELECT *, row_number() OVER (ORDER BY actual_date IS NULL, actual_date DESC, id) AS k FROM d_todo) x WHERE k <= 25",
    "o3_numeric_text": "SELECT source_id, id FROM (SELECT *, row_number() OVER (ORDER BY length(source_id), source_id, id) AS k FROM d_log) x WHERE k <= 30",
    "o4_quotas": "SELECT kind, id, created_ms FROM (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY created_ms DESC, id) AS k FROM (SELECT 'todo' AS kind, id, created_ms FROM d_todo UNION ALL SELECT 'highlight', id, created_ms FROM d_highlight) a) x WHERE k <= 10",
    "o5_priority": "SELECT id, status, synced_ms FROM (SELECT *, row_number() OVER (ORDER BY coalesce(list_position(['failed', 'retry'], status), 3), synced_ms DESC, id) AS k FROM d_sync) x WHERE k <= 15",
    "o7_reading_order": f"SELECT notebook_uuid, {_joined('text', ' ', '(confidence, page_number)')} AS text FROM {_BOOKS}",
    "o8_filter_then_limit": "SELECT item_id, id FROM (SELECT *, row_number() OVER (ORDER BY id) AS k FROM d_sync WHERE status IN ('failed', 'retry', 'pending')) x WHERE k <= 12",
    "o9_new_then_backlog": "SELECT page_uuid, is_new FROM (SELECT page_uuid, CAST(known IS NOT TRUE AS INTEGER) AS is_new, row_number() OVER (ORDER BY known IS TRUE, page_number DESC, page_uuid) AS k FROM (SELECT p.*, EXISTS (SELECT 1 FROM d_sync s WHERE s.item_id = p.page_uuid) AS known FROM d_page p) x) y WHERE k <= 50",
    "u3_distinct": "SELECT notebook_uuid, status FROM d_sync GROUP BY notebook_uuid, status",
    "u5_three_way": "SELECT if(l AND r, 'both', if(l, 'only_local', 'only_remote')) AS side, count(*) AS n FROM (SELECT notebook_uuid, page_number, bool_or(local) AS l, bool_or(NOT local) AS r FROM (SELECT notebook_uuid, page_number, true AS local FROM d_page UNION ALL SELECT notebook_uuid, page_number, false FROM d_todo) a GROUP BY ALL) x GROUP BY 1",
    "h7_folder_part": "SELECT notebook_uuid, array_to_string(string_split(full_path, '/')[:-2], '/') AS folder FROM d_notebook",
    "c20_cutoff": f"SELECT id, ['skipped', 'recent'][1 + CAST(changed_ms - {NOW - 68 * DAY} > 0 AS INTEGER)] AS part FROM d_log",
    "g7_hook_filter": "SELECT notebook_uuid FROM d_notebook WHERE document_type = 'notebook' AND NOT starts_with(ifnull(full_path, ''), 'trash')",
    "e7_stale": f"SELECT len(list_filter(list({{'s': status, 'm': synced_ms}}), lambda x: list_contains(['pending', 'in_progress'], x.s) AND x.m < {NOW - DAY})) AS n FROM d_sync",
    "r6_catch_up": "SELECT DISTINCT source_table, count(*) OVER (PARTITION BY source_table) AS n, count(*) OVER (PARTITION BY source_table) > 10 AS over_cap FROM d_log WHERE status = 'pending'",
    "r7_recent_events": "SELECT id, source_table FROM d_log a WHERE (SELECT count(*) FROM d_log b WHERE b.id > a.id) < 50",
    "f19_badge": "SELECT id, ['', '🔴', '🟡', '🟢'][1 + CAST(confidence > 0 AS INTEGER) + CAST(confidence > 0.5 AS INTEGER) + CAST(confidence > 0.8 AS INTEGER)] AS badge FROM d_highlight",
    "t4_export": "SELECT DISTINCT completed, count(*) OVER (PARTITION BY completed) AS n, first_value(text) OVER (PARTITION BY completed ORDER BY text) AS first_text FROM d_todo",
    "c14_metadata_diff": "SELECT notebook_uuid, if(document_type = 'epub', 'new', if(length(notebook_uuid) % 2 = 0, 'same', 'path')) AS change FROM d_notebook",
    "c23_validation": "SELECT item_type, status, count(*) AS n, count(*) FILTER (NOT regexp_full_match(ifnull(content_hash, ''), '[0-9a-f]{64}')) AS bad_hashes, count(*) FILTER (external_id IS NOT NULL) AS with_block FROM d_sync GROUP BY ALL",
    "g2_typed_changes": "SELECT 'pages' AS source_table, page_uuid AS source_id, sha256('text:' || text || '|page_number:' || page_number) AS h FROM d_page UNION ALL SELECT 'todos', id::VARCHAR, sha256('text:' || text || ifnull('|actual_date:' || actual_date, '')) FROM d_todo",
    "g4_mark": f"SELECT id, if(status = 'pending' AND id % 10 = 4, 'processed', status) AS status, if(status = 'pending' AND id % 10 = 4, {NOW}, NULL) AS processed_ms FROM d_log",
    "g6_batch": "SELECT id AS source_id, 'INSERT' AS operation, nullif(sha256(text), sha256('')) AS hash_after FROM d_todo",
    "f10_collate": f"SELECT notebook_uuid, (SELECT count(*) FROM d_page p WHERE p.notebook_uuid = n.notebook_uuid AND trim(p.text) <> '') AS fragments, {_joined('trim(text)', ' ', 'page_number')} AS text FROM (SELECT DISTINCT notebook_uuid FROM d_page WHERE trim(text) <> '') n",
    "f16_ms": "SELECT id, if(id % 3 = 0, NULL, changed_ms) AS at_ms FROM d_log",
    "f17_fence": "SELECT item_id, if(item_id % 3 = 1, '```mermaid' || chr(10) || text || chr(10) || '```', text) AS text FROM benchmark",
    "f25_distance": "SELECT a.id, round(sqrt((a.page_number - b.page_number - 1.0) ** 2 + (a.id % 50 + 1.0 - b.id % 40) ** 2), 6) AS distance FROM d_highlight a, d_highlight b WHERE b.id - a.id = 1",
    "d2_upsert": "SELECT page_uuid AS item_id, sha256(text) AS content_hash, 0 AS retry_count FROM d_page WHERE page_number = 1 UNION ALL SELECT DISTINCT item_id, first_value(content_hash) OVER (PARTITION BY item_id ORDER BY synced_ms DESC, id DESC), 0 FROM d_sync WHERE item_id NOT IN (SELECT page_uuid FROM d_page WHERE page_number = 1)",
    "d6_retention": f"SELECT id FROM d_log EXCEPT ALL SELECT id FROM d_log WHERE changed_ms < {NOW - 68 * DAY}",
    "d10_stamp": f"SELECT id, coalesce(nullif({NOW} * CAST(status = 'retry' AS BIGINT), 0), synced_ms) AS updated_ms FROM d_sync",
}
