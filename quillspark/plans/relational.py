
from quillspark.plans.adapters import DAY, NOW

LATEST = "SELECT item_id, target, max_by(content_hash, struct(synced_ms, id)) AS content_hash, max(synced_ms) AS synced_ms FROM d_sync WHERE status = 'success' GROUP BY item_id, target"
MEANT = "lower(text) NOT LIKE '%this appears to be a blank%' AND lower(text) NOT LIKE '%completely empty page%'"
#: Runs go at once: a match for each letter would cost most of these queries' time.
LETTERS = r"CAST(length(regexp_replace(text, '[^\p{L}]+', '', 'g')) AS DOUBLE) / length(text)"
SYMBOLS = r"CAST(length(regexp_replace(text, '[\p{L}\p{N} \t\n\r\f]+', '', 'g')) AS DOUBLE) / length(text)"
N_WORDS = r"regexp_count(text, '[^ \t\n\r\f]+')"

READ_AGAIN = "SELECT id, notebook_uuid, page_number, text, actual_date FROM d_todo UNION ALL SELECT id + 1000000000, notebook_uuid, page_number, text, CASE WHEN id % 2 = 0 THEN actual_date END FROM d_todo WHERE id % 3 <> 1"

SQL = {
    # predicates and projections
    "p1_nonempty_text": "SELECT page_uuid, length(text) AS n FROM d_page WHERE text IS NOT NULL AND length(text) > 50",
    "p2_not_blank": f"SELECT page_uuid FROM d_page WHERE {MEANT}",
    "p3_not_archived": "SELECT notebook_uuid FROM d_notebook WHERE lower(full_path) NOT LIKE '%archive%'",
    "p4_in_list": "SELECT notebook_uuid, visible_name FROM d_notebook WHERE notebook_uuid IN ('nb-1', 'nb-5', 'nb-8') AND document_type <> 'epub'",
    "p5_recent": f"SELECT id, created_ms FROM d_highlight WHERE created_ms > {NOW - 60 * DAY}",
    "p6_excluded_notebooks": "SELECT notebook_uuid FROM d_notebook WHERE notebook_uuid NOT IN ('nb-2') AND visible_name NOT LIKE 'Notebook 1%' AND lower(visible_name) NOT LIKE '%book 33%'",
    "p7_file_names": "SELECT page_id, url FROM pages WHERE url NOT LIKE '%.tmp' AND (url LIKE '%.html' OR url LIKE '%.htm')",
    "p8_page_range": "SELECT page_uuid, page_number FROM d_page WHERE page_number BETWEEN 2 AND 4",
    "p9_status_case": f"WITH latest AS ({LATEST}) SELECT p.page_uuid, CASE WHEN l.item_id IS NULL THEN 'NEVER SYNCED' WHEN p.updated_ms > l.synced_ms THEN 'CONTENT_NEWER_THAN_SYNC' ELSE 'UP_TO_DATE' END AS state FROM d_page p LEFT JOIN latest l ON l.item_id = p.page_uuid AND l.target = 'notion'",
    "p10_preview": "SELECT id, substr(coalesce(corrected_text, original_text), 1, 100) AS preview, CASE WHEN length(original_text) > 50 THEN concat(substr(original_text, 1, 50), '...') ELSE original_text END AS short FROM d_highlight",
    "p11_epoch_seconds": "SELECT notebook_uuid, CAST(floor(last_opened_ms / 1000) AS BIGINT) AS opened_s FROM d_notebook",
    "p12_json_path": "SELECT id, CAST(get_json_object(props, '$.k') AS BIGINT) AS k FROM d_log",
    "p13_split_key": "SELECT split_part(composite, '|', 1) AS notebook_uuid, CAST(split_part(composite, '|', 2) AS BIGINT) AS page_number FROM (SELECT concat(notebook_uuid, '|', page_number) AS composite FROM d_page) t",
    "p14_author_suffix": "SELECT notebook_uuid, substr(title, 1, length(title) - length(authors) - 3) AS title FROM (SELECT notebook_uuid, authors, concat(visible_name, ' - ', authors) AS title FROM d_notebook) t WHERE authors IS NOT NULL AND title LIKE concat('% - ', authors)",
    "p15_md5_rows": "SELECT id FROM (SELECT id, CASE WHEN id % 2 = 0 THEN md5(original_text) ELSE sha256(original_text) END AS h FROM d_highlight) t WHERE length(h) = 32",
    "p17_id_compare": "SELECT kind, count(*) AS n FROM (SELECT CASE WHEN s.external_id IS NULL THEN 'missing' WHEN s.external_id = p.page_uuid THEN 'exact' WHEN replace(substr(s.external_id, 3), '-', '') = replace(substr(p.page_uuid, 3), '-', '') THEN 'dash_only' ELSE 'real' END AS kind FROM d_page p LEFT JOIN d_sync s ON s.item_id = p.page_uuid) t GROUP BY kind",
    "p18_deep_link": "SELECT id, concat('https://notes.example/', replace(notebook_uuid, '-', ''), '#', replace(external_id, '-', '')) AS link FROM d_sync WHERE external_id IS NOT NULL",
    # joins
    "j1_inner": "SELECT n.visible_name, h.id FROM d_notebook n JOIN d_highlight h ON h.notebook_uuid = n.notebook_uuid",
    "j2_left_dimension": "SELECT t.id, n.visible_name FROM d_todo t LEFT JOIN d_notebook n ON n.notebook_uuid = t.notebook_uuid",
    "j3_left_on_predicates": "SELECT p.page_uuid, s.id AS sync_id FROM d_page p LEFT JOIN d_sync s ON s.item_id = p.page_uuid AND s.target = 'notion' AND s.status = 'success'",
    "j4_cast_key": "SELECT t.id, g.operation, count(g.id) AS n FROM d_todo t LEFT JOIN d_log g ON g.source_id = CAST(t.id AS VARCHAR(20)) GROUP BY t.id, g.operation",
    "j5_composite_key": "SELECT t.id, p.page_uuid FROM d_todo t LEFT JOIN d_page p ON p.notebook_uuid = t.notebook_uuid AND p.page_number = t.page_number",
    "j6_anti": "SELECT p.page_uuid FROM d_page p LEFT JOIN d_sync s ON s.item_id = p.page_uuid WHERE s.id IS NULL",
    "j7_changed_or_new": "SELECT p.page_uuid FROM d_page p LEFT JOIN d_sync s ON s.notebook_uuid = p.notebook_uuid AND s.page_number = p.page_number AND s.status = 'success' WHERE s.content_hash IS NULL OR s.content_hash <> sha256(p.text)",
    "j8_semi": "SELECT page_uuid FROM d_page WHERE notebook_uuid IN (SELECT notebook_uuid FROM d_notebook WHERE document_type IN ('pdf', 'epub'))",
    "j9_not_in": "SELECT page_uuid FROM d_page WHERE page_uuid NOT IN (SELECT item_id FROM d_sync)",
    "j10_two_targets": "SELECT p.page_uuid, a.status AS notion, b.status AS readwise FROM d_page p LEFT JOIN d_sync a ON a.item_id = p.page_uuid AND a.target = 'notion' LEFT JOIN d_sync b ON b.item_id = p.page_uuid AND b.target = 'readwise'",
    "j11_chain": "SELECT t.id, n.visible_name, p.page_uuid, s.external_id FROM d_todo t LEFT JOIN d_notebook n ON n.notebook_uuid = t.notebook_uuid LEFT JOIN d_page p ON p.notebook_uuid = t.notebook_uuid AND p.page_number = t.page_number LEFT JOIN d_sync s ON s.item_id = p.page_uuid AND s.status = 'success' WHERE t.completed = FALSE",
    "j12_scalar_subquery": "SELECT n.notebook_uuid, (SELECT max(p.page_number) FROM d_page p WHERE p.notebook_uuid = n.notebook_uuid) AS last_page FROM d_notebook n",
    "j13_computed_key": "SELECT p.page_uuid, s.id AS sync_id FROM d_page p LEFT JOIN d_sync s ON coalesce(s.external_id, concat(s.notebook_uuid, '::', s.page_number)) = concat(p.notebook_uuid, '::', p.page_number)",
    "j14_through_second": "SELECT s.id FROM d_sync s WHERE EXISTS (SELECT 1 FROM d_notebook n WHERE n.notebook_uuid = s.notebook_uuid AND n.document_type = 'pdf')",
    "j15_full_lookup": "SELECT coalesce(n.notebook_uuid, t.notebook_uuid) AS notebook_uuid, n.visible_name, t.n FROM d_notebook n FULL OUTER JOIN (SELECT notebook_uuid, count(*) AS n FROM d_todo GROUP BY notebook_uuid) t ON t.notebook_uuid = n.notebook_uuid",
    # aggregations
    "a1_counts": "SELECT 'pages' AS name, count(*) AS n FROM d_page UNION ALL SELECT 'todos', count(*) FROM d_todo UNION ALL SELECT 'syncs', count(*) FROM d_sync UNION ALL SELECT 'log', count(*) FROM d_log",
    "a2_by_status": "SELECT target, item_type, status, count(*) AS n FROM d_sync GROUP BY target, item_type, status",
    "a3_min_max": "SELECT target, item_type, status, count(*) AS n, min(synced_ms) AS first_ms, max(synced_ms) AS last_ms FROM d_sync GROUP BY target, item_type, status",
    "a4_distinct": "SELECT count(DISTINCT notebook_uuid) AS books, count(DISTINCT CASE WHEN confidence > 0.5 THEN notebook_uuid END) AS sure FROM d_highlight",
    "a5_rates": "SELECT target, sum(CASE WHEN status = 'success' THEN 1 ELSE 0 END) AS ok, CASE WHEN count(*) = 0 THEN CAST(100 AS DOUBLE) ELSE round(CAST(sum(CASE WHEN status = 'success' THEN 1 ELSE 0 END) AS DOUBLE) / count(*) * 100, 1) END AS rate FROM d_sync GROUP BY target",
    "a6_rollup": "SELECT notebook_uuid, count(*) AS pages, sum(length(text)) AS total_characters, round(avg(confidence), 9) AS confidence, min(updated_ms) AS first_ms, max(updated_ms) AS last_ms FROM d_page GROUP BY notebook_uuid HAVING sum(length(text)) > 1000",
    "a7_text": "SELECT notebook_uuid, listagg(text, '\n\n') WITHIN GROUP (ORDER BY page_number) AS text FROM d_page GROUP BY notebook_uuid",
    "a8_top_groups": "SELECT n.authors, count(*) AS n FROM d_notebook n JOIN d_highlight h ON h.notebook_uuid = n.notebook_uuid WHERE n.authors IS NOT NULL GROUP BY n.authors ORDER BY n DESC, n.authors LIMIT 5",
    "a9_books": "SELECT n.notebook_uuid, n.visible_name, n.authors, count(h.id) AS n FROM d_notebook n JOIN d_highlight h ON h.notebook_uuid = n.notebook_uuid GROUP BY n.notebook_uuid, n.visible_name, n.authors",
    "a10_duplicates": "SELECT t.id, g.keep, g.n FROM d_todo t JOIN (SELECT text, count(*) AS n, min(id) AS keep FROM d_todo GROUP BY text HAVING count(*) > 1) g ON g.text = t.text",
    "a11_singletons": "SELECT count(*) AS n FROM (SELECT text FROM d_todo GROUP BY text HAVING count(*) = 1) t",
    "a12_gaps": "SELECT n.notebook_uuid, n.total_pages - count(DISTINCT s.page_number) AS gap FROM d_notebook n LEFT JOIN d_sync s ON s.notebook_uuid = n.notebook_uuid AND s.status = 'success' GROUP BY n.notebook_uuid, n.total_pages HAVING n.total_pages > count(DISTINCT s.page_number)",
    "a13_no_blocks": "SELECT notebook_uuid FROM d_sync GROUP BY notebook_uuid HAVING count(external_id) < count(*)",
    "a14_dates": "SELECT actual_date, count(*) AS n, min(id) AS first_id, max(id) AS last_id FROM d_todo WHERE actual_date IS NOT NULL GROUP BY actual_date",
    "a15_pending": "SELECT source_table, operation, count(*) AS n, min(changed_ms) AS oldest, max(changed_ms) AS newest FROM d_log WHERE status = 'pending' GROUP BY source_table, operation",
    "a16_matrix": "SELECT target, sum(CASE WHEN status = 'success' THEN 1 ELSE 0 END) AS success, sum(CASE WHEN status = 'failed' THEN 1 ELSE 0 END) AS failed, sum(CASE WHEN status = 'retry' THEN 1 ELSE 0 END) AS retry, sum(CASE WHEN status = 'pending' THEN 1 ELSE 0 END) AS pending FROM d_sync GROUP BY target",
    "a17_nested_pages": "SELECT notebook_uuid, listagg(concat('page_', page_number, ':', length(text)), '|') WITHIN GROUP (ORDER BY page_number) AS pages FROM d_page GROUP BY notebook_uuid",
    "a18_cost": "SELECT document_type, sum(CASE WHEN document_type = 'notebook' THEN total_pages ELSE 0 END) AS paid_pages, round(sum(CASE WHEN document_type = 'notebook' THEN CAST(total_pages AS DOUBLE) * CAST(0.003 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END), 6) AS cost FROM d_notebook GROUP BY document_type",
    "a19_results": "SELECT CASE status WHEN 'success' THEN 'success' WHEN 'failed' THEN 'failed' ELSE 'skipped' END AS result, count(*) AS n FROM d_sync GROUP BY 1",
    "a20_export_stats": f"SELECT count(*) AS total, sum(CASE WHEN t.created_ms > {NOW - 64 * DAY} THEN 1 ELSE 0 END) AS recent, count(x.todo_id) AS exported, CASE WHEN count(t.actual_date) = 0 THEN CAST(0 AS DOUBLE) ELSE round(CAST(count(x.todo_id) AS DOUBLE) / CAST(count(t.actual_date) AS DOUBLE) * 100, 1) END AS pct FROM d_todo t LEFT JOIN (SELECT DISTINCT todo_id FROM d_todo_sync) x ON x.todo_id = t.id",
    "a21_version": "SELECT coalesce(max(version), 0) AS version, coalesce(max(version), 0) < 6 AS pending FROM d_migration",
    "a22_recent_first": "SELECT notebook_uuid, count(*) AS n, max(created_ms) AS last_ms FROM d_highlight GROUP BY notebook_uuid",
    # windows
    "w1_latest_success": "SELECT item_id, target, content_hash FROM (SELECT s.*, row_number() OVER (PARTITION BY item_id, target, item_type ORDER BY synced_ms DESC, id DESC) AS rn FROM d_sync s WHERE status = 'success') t WHERE rn = 1",
    "w2_keep_first": "SELECT min(id) AS id, text FROM d_todo GROUP BY text",
    "w4_predecessor": "SELECT page_uuid, lag(page_uuid) OVER (PARTITION BY notebook_uuid ORDER BY page_number DESC) AS after_page FROM d_page",
    "w5_newest_pages": "SELECT page_uuid FROM (SELECT page_uuid, row_number() OVER (PARTITION BY notebook_uuid ORDER BY page_number DESC) AS rn FROM d_page) t WHERE rn <= 50",
    # sorts and limits: the limit is the operator
    "o1_newest": "SELECT id, changed_ms FROM d_log ORDER BY changed_ms DESC, id LIMIT 20",
    "o2_nulls_last": "SELECT id, actual_date FROM d_todo ORDER BY actual_date DESC NULLS LAST, id LIMIT 25",
    "o3_numeric_text": "SELECT source_id, id FROM d_log ORDER BY CAST(source_id AS BIGINT), id LIMIT 30",
    "o4_quotas": "SELECT * FROM (SELECT 'todo' AS kind, id, created_ms FROM d_todo ORDER BY created_ms DESC, id LIMIT 10) a UNION ALL SELECT * FROM (SELECT 'highlight' AS kind, id, created_ms FROM d_highlight ORDER BY created_ms DESC, id LIMIT 10) b",
    "o5_priority": "SELECT id, status, synced_ms FROM d_sync ORDER BY CASE status WHEN 'failed' THEN 0 WHEN 'retry' THEN 1 ELSE 2 END, synced_ms DESC, id LIMIT 15",
    "o6_gap_order": "SELECT n.notebook_uuid, n.total_pages - coalesce(s.pages, 0) AS gap FROM d_notebook n LEFT JOIN (SELECT notebook_uuid, count(DISTINCT page_number) AS pages FROM d_sync WHERE status = 'success' GROUP BY notebook_uuid) s ON s.notebook_uuid = n.notebook_uuid ORDER BY n.total_pages - coalesce(s.pages, 0) DESC, n.notebook_uuid LIMIT 10",
    "o7_reading_order": "SELECT notebook_uuid, listagg(text, ' ') WITHIN GROUP (ORDER BY confidence, page_number) AS text FROM d_page GROUP BY notebook_uuid",
    "o8_filter_then_limit": "SELECT item_id, id FROM d_sync WHERE status <> 'success' ORDER BY id LIMIT 12",
    "o9_new_then_backlog": "SELECT page_uuid, is_new FROM (SELECT p.page_uuid, p.page_number, CASE WHEN s.item_id IS NULL THEN 1 ELSE 0 END AS is_new FROM d_page p LEFT JOIN (SELECT DISTINCT item_id FROM d_sync) s ON s.item_id = p.page_uuid) t ORDER BY is_new DESC, page_number DESC, page_uuid LIMIT 50",
    # sets and changes of tables
    "u1_union": "SELECT 'todo' AS kind, notebook_uuid, text, CAST(NULL AS DOUBLE) AS confidence FROM d_todo UNION ALL SELECT 'highlight', notebook_uuid, original_text, confidence FROM d_highlight",
    "u2_page_sets": "SELECT notebook_uuid, page_number FROM d_page EXCEPT SELECT notebook_uuid, page_number FROM d_sync WHERE status = 'success'",
    "u3_distinct": "SELECT DISTINCT notebook_uuid, status FROM d_sync",
    "u5_three_way": "SELECT side, count(*) AS n FROM (SELECT CASE WHEN a.k IS NULL THEN 'only_remote' WHEN b.k IS NULL THEN 'only_local' ELSE 'both' END AS side FROM (SELECT DISTINCT concat(notebook_uuid, '|', page_number) AS k FROM d_page) a FULL OUTER JOIN (SELECT DISTINCT concat(notebook_uuid, '|', page_number) AS k FROM d_todo) b ON a.k = b.k) t GROUP BY side",
    "d1_insert_or_ignore": "SELECT min(t.id) AS id, t.text FROM d_todo t WHERE NOT EXISTS (SELECT 1 FROM d_highlight h WHERE h.original_text = t.text) GROUP BY t.text",
    "d2_upsert": "SELECT item_id, content_hash, 0 AS retry_count FROM (SELECT item_id, content_hash, row_number() OVER (PARTITION BY item_id ORDER BY version DESC) AS rn FROM (SELECT item_id, content_hash, struct(synced_ms, id) AS version FROM d_sync UNION ALL SELECT page_uuid, sha256(text), struct(9000000000000000000, CAST(0 AS BIGINT)) FROM d_page WHERE page_number = 1) v) t WHERE rn = 1",
    "d3_replace_partition": "SELECT notebook_uuid, page_number, text FROM d_page WHERE notebook_uuid NOT IN (SELECT notebook_uuid FROM d_highlight) UNION ALL SELECT notebook_uuid, page_number, original_text FROM d_highlight",
    "d4_partial_update": "SELECT s.id, coalesce(u.status, s.status) AS status, s.content_hash FROM d_sync s LEFT JOIN (SELECT id, 'archived' AS status FROM d_sync WHERE retry_count > 5) u ON u.id = s.id",
    "d6_retention": f"SELECT id FROM d_log WHERE changed_ms >= {NOW - 68 * DAY}",
    "d7_cleanup": f"SELECT id FROM d_sync WHERE NOT (status = 'failed' AND retry_count >= 3 AND synced_ms < {NOW - DAY})",
    "d8_cascade": "SELECT s.id FROM d_sync s WHERE NOT EXISTS (SELECT 1 FROM d_notebook n WHERE n.notebook_uuid = s.notebook_uuid AND n.document_type = 'epub')",
    "d9_rebuild": "SELECT lower(visible_name) AS title, coalesce(authors, 'Unknown') AS author, notebook_uuid FROM d_notebook",
    "d10_stamp": f"SELECT id, CASE WHEN status = 'retry' THEN {NOW} ELSE synced_ms END AS updated_ms FROM d_sync",
    "d12_view_pages": "SELECT item_id AS page_uuid, content_hash, synced_ms FROM d_sync WHERE item_type = 'page_text' AND target = 'notion'",
    # hierarchy (the others are in devices.py)
    "h7_folder_part": "SELECT notebook_uuid, CASE WHEN full_path IS NULL THEN NULL WHEN full_path NOT LIKE '%/%' THEN '' ELSE regexp_extract(full_path, '^(.*)/[^/]*$', 1) END AS folder FROM d_notebook",
    # fingerprints
    "x6_notebook_md5": "SELECT notebook_uuid, md5(listagg(concat('page_', page_number, ':', text), '|') WITHIN GROUP (ORDER BY page_number)) AS h FROM d_page GROUP BY notebook_uuid",
    "x7_metadata_md5": "SELECT notebook_uuid, md5(concat('path:', coalesce(full_path, ''), '|modified:', coalesce(CAST(modified_ms AS VARCHAR(20)), ''), '|opened:', coalesce(CAST(last_opened_ms AS VARCHAR(20)), ''))) AS h FROM d_notebook",
    "x9_page_sha": "SELECT page_uuid, sha256(text) AS h FROM d_page",
    "x11_changelog_sha": "SELECT id, sha256(concat_ws('|', concat('table:', source_table), concat('op:', operation), CASE WHEN hash_after IS NOT NULL THEN concat('hash:', hash_after) END)) AS h FROM d_log",
    "x13_full_text_md5": "SELECT notebook_uuid, md5(listagg(text, '') WITHIN GROUP (ORDER BY page_number)) AS h FROM d_page GROUP BY notebook_uuid",
    # what needs to be synced
    "c1_notebooks": f"WITH latest AS ({LATEST}) SELECT p.notebook_uuid, sum(CASE WHEN l.item_id IS NULL THEN 1 ELSE 0 END) AS new_pages, sum(CASE WHEN l.content_hash <> sha256(p.text) THEN 1 ELSE 0 END) AS changed_pages, max(CASE WHEN l.item_id IS NULL OR l.content_hash <> sha256(p.text) THEN 1 ELSE 0 END) AS needs_sync FROM d_page p LEFT JOIN latest l ON l.item_id = p.page_uuid AND l.target = 'notion' GROUP BY p.notebook_uuid",
    "c2_todos": "SELECT t.id, CASE WHEN t.completed THEN 'completed_todo' WHEN g.h IS NULL THEN 'never_synced_to_target' WHEN g.h <> sha256(t.text) THEN 'content_changed' ELSE 'no_changes' END AS reason FROM d_todo t LEFT JOIN (SELECT source_id, max(hash_after) AS h FROM d_log WHERE source_table = 'todos' AND status = 'processed' GROUP BY source_id) g ON g.source_id = CAST(t.id AS VARCHAR(20))",
    "c4_accessed": f"WITH latest AS ({LATEST}) SELECT n.notebook_uuid, coalesce(n.last_opened_ms > max(l.synced_ms), n.last_opened_ms IS NOT NULL) AS accessed FROM d_notebook n LEFT JOIN d_page p ON p.notebook_uuid = n.notebook_uuid LEFT JOIN latest l ON l.item_id = p.page_uuid GROUP BY n.notebook_uuid, n.last_opened_ms",
    "c8_unsynced": "SELECT p.notebook_uuid, count(*) AS pages, max(p.updated_ms) AS last_ms FROM d_page p WHERE NOT EXISTS (SELECT 1 FROM d_sync s WHERE s.notebook_uuid = p.notebook_uuid) GROUP BY p.notebook_uuid",
    "c9_unified": f"WITH latest AS ({LATEST}), state AS (SELECT p.notebook_uuid, p.page_uuid, CASE WHEN l.item_id IS NULL THEN 'NEVER_SYNCED' WHEN l.content_hash <> sha256(p.text) THEN 'STALE' ELSE 'UP_TO_DATE' END AS state FROM d_page p LEFT JOIN latest l ON l.item_id = p.page_uuid AND l.target = 'notion') SELECT notebook_uuid, state, count(*) AS pages FROM state GROUP BY notebook_uuid, state",
    "c12_remote_need": "SELECT p.notebook_uuid, sum(CASE WHEN s.id IS NULL OR s.content_hash <> sha256(p.text) OR s.status IN ('pending', 'failed') THEN 1 ELSE 0 END) AS need, count(*) AS total FROM d_page p LEFT JOIN d_sync s ON s.item_id = p.page_uuid AND s.target = 'readwise' GROUP BY p.notebook_uuid",
    "c13_page_plan": f"WITH latest AS ({LATEST}) SELECT p.page_uuid, CASE WHEN l.item_id IS NULL THEN 'missing' ELSE 'stale' END AS why FROM d_page p LEFT JOIN latest l ON l.item_id = p.page_uuid AND l.target = 'notion' WHERE {MEANT.replace('text', 'p.text')} AND (l.item_id IS NULL OR l.content_hash <> sha256(p.text))",
    "c17_reconcile": f"WITH latest AS ({LATEST}) SELECT p.page_uuid, CASE WHEN l.item_id IS NULL THEN 'never_synced' WHEN lower(p.text) LIKE '%blank%' THEN 'possibly_stale' ELSE 'ok' END AS category FROM d_page p LEFT JOIN latest l ON l.item_id = p.page_uuid",
    "c20_cutoff": f"SELECT id, CASE WHEN changed_ms > {NOW - 68 * DAY} THEN 'recent' ELSE 'skipped' END AS part FROM d_log",
    "c21_risk": "SELECT source_table, CASE WHEN count(*) > 5000 THEN 'high' WHEN count(*) < 1000 THEN 'low' ELSE 'medium' END AS risk FROM d_log GROUP BY source_table",
    "c24_backfill": "SELECT s.id, coalesce(nullif(s.external_id, ''), concat('map-', p.page_uuid)) AS external_id FROM d_sync s JOIN d_page p ON p.page_uuid = s.item_id",
    "c29_duplicate_books": "SELECT a.notebook_uuid FROM d_notebook a WHERE a.authors IS NULL AND EXISTS (SELECT 1 FROM d_notebook b WHERE lower(substr(b.visible_name, 1, 10)) = lower(substr(a.visible_name, 1, 10)) AND b.authors IS NOT NULL)",
    # changelog
    "g3_pending": "SELECT g.id, s.target, s.status FROM d_log g LEFT JOIN (SELECT DISTINCT notebook_uuid, target, status FROM d_sync) s ON s.notebook_uuid = concat('nb-', g.source_id) WHERE g.status = 'pending'",
    "g5_health": "SELECT count(*) AS total, sum(CASE WHEN status = 'pending' THEN 1 ELSE 0 END) AS pending, round(CAST(sum(CASE WHEN status = 'processed' THEN 1 ELSE 0 END) AS DOUBLE) / count(*) * 100, 1) AS rate, min(CASE WHEN status = 'pending' THEN changed_ms END) AS oldest FROM d_log",
    "g7_hook_filter": "SELECT notebook_uuid FROM d_notebook WHERE document_type = 'notebook' AND (full_path IS NULL OR full_path NOT LIKE 'trash%')",
    "g8_real_updates": "SELECT id FROM (SELECT id, hash_after, lag(hash_after) OVER (PARTITION BY source_table, source_id ORDER BY changed_ms, id) AS before FROM d_log) t WHERE hash_after IS DISTINCT FROM before",
    # sync engine
    "e2_deduplicate": "SELECT p.page_uuid, count(s.id) > 0 AS is_duplicate FROM d_page p LEFT JOIN d_sync s ON s.content_hash = sha256(p.text) AND s.target = 'notion' AND s.status = 'success' GROUP BY p.page_uuid",
    "e3_skip_rules": f"WITH latest AS ({LATEST}) SELECT p.page_uuid, CASE WHEN l.content_hash = sha256(p.text) THEN 'SKIPPED' ELSE 'SYNC' END AS action FROM d_page p LEFT JOIN latest l ON l.item_id = p.page_uuid AND l.target = 'notion'",
    "e4_routing": "SELECT g.id, c.target FROM d_log g JOIN (SELECT 'notebooks' AS source_table, 'notion' AS target UNION ALL SELECT 'pages', 'notion' UNION ALL SELECT 'todos', 'notion' UNION ALL SELECT 'highlights', 'readwise') c ON c.source_table = g.source_table WHERE g.status = 'pending'",
    "e6_retry": f"SELECT id FROM d_sync WHERE status = 'retry' AND retry_count < 5 AND synced_ms < {NOW} - 30000 * power(2, retry_count)",
    "e7_stale": f"SELECT count(*) AS n FROM d_sync WHERE status IN ('pending', 'in_progress') AND synced_ms < {NOW - DAY}",
    "e9_batches": "SELECT notebook_uuid, CAST(floor((page_number - 1) / 25) AS BIGINT) AS batch, concat('[', min(page_number), ',', max(page_number), ']') AS item, count(*) AS n FROM d_page GROUP BY notebook_uuid, CAST(floor((page_number - 1) / 25) AS BIGINT)",
    "e13_payload": "SELECT id, substr(original_text, 1, 2000) AS text, concat_ws(' | ', concat('page ', page_number), CASE WHEN confidence < 0.7 THEN 'low confidence' END) AS note FROM d_highlight WHERE length(original_text) >= 10",
    "e14_todo_export": f"SELECT t.id, n.visible_name FROM d_todo t LEFT JOIN d_notebook n ON n.notebook_uuid = t.notebook_uuid WHERE t.completed = FALSE AND t.created_ms > {NOW - 66 * DAY} AND lower(n.full_path) NOT LIKE '%archive%'",
    "e16_find_book": "SELECT a.notebook_uuid, min(b.notebook_uuid) AS book FROM d_notebook a JOIN d_notebook b ON trim(lower(a.visible_name)) = trim(lower(b.visible_name)) AND a.authors = b.authors GROUP BY a.notebook_uuid",
    # streaming history in batch form
    "r6_catch_up": "SELECT source_table, count(*) AS n, count(*) > 10 AS over_cap FROM d_log WHERE status = 'pending' GROUP BY source_table",
    "r7_recent_events": "SELECT id, source_table FROM d_log ORDER BY id DESC LIMIT 50",
    # text functions
    "f1_clean": "SELECT doc_id, trim(regexp_replace(regexp_replace(text, '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F]', '', 'g'), '[ \\t\\n\\r]+', ' ', 'g')) AS clean FROM documents",
    "f2_normalise": "SELECT doc_id, lower(trim(regexp_replace(text, '[ \\t\\n\\r]+', ' ', 'g'))) AS clean FROM documents",
    "f4_quality": f"SELECT doc_id, length(text) >= 15 AND {LETTERS} > 0.6 AND {SYMBOLS} < 0.2 AND {N_WORDS} >= 3 AND NOT regexp_like(text, '[^\\p{{L}}\\p{{N}} \\t\\n\\r\\f]{{4,}}') AS good FROM documents WHERE length(text) > 0",
    "f5_gibberish": f"SELECT doc_id FROM documents WHERE length(text) > 0 AND (length(text) < 15 OR {LETTERS} < 0.6 OR {SYMBOLS} > 0.2 OR {N_WORDS} < 3 OR regexp_like(text, '[^\\p{{L}}\\p{{N}} \\t\\n\\r\\f]{{4,}}'))",
    "f6_confidence": f"SELECT doc_id, round(least(CAST(1 AS DOUBLE), CASE WHEN length(text) < 20 THEN CAST(0.8 AS DOUBLE) ELSE CAST(1 AS DOUBLE) END * CASE WHEN substr(text, length(text), 1) IN ('.', '!', '?') THEN CAST(1.1 AS DOUBLE) ELSE CAST(1 AS DOUBLE) END * CASE WHEN {SYMBOLS} >= 0.2 THEN CAST(0.7 AS DOUBLE) ELSE CAST(1 AS DOUBLE) END), 9) AS confidence FROM documents WHERE length(text) > 0",
    "f14_iso_date": "SELECT id, concat_ws('-', split_part(d, '-', 3), split_part(d, '-', 2), split_part(d, '-', 1)) AS iso FROM (SELECT id, concat(split_part(actual_date, '-', 3), '-', split_part(actual_date, '-', 2), '-', split_part(actual_date, '-', 1)) AS d FROM d_todo WHERE actual_date IS NOT NULL) t",
    "f18_truncate": "SELECT doc_id, CASE WHEN length(text) > 2000 THEN concat(substr(text, 1, 1997), '...') ELSE text END AS short FROM documents",
    "f19_badge": "SELECT id, CASE WHEN confidence > 0.8 THEN '🟢' WHEN confidence > 0.5 THEN '🟡' WHEN confidence > 0 THEN '🔴' ELSE '' END AS badge FROM d_highlight",
    "f20_category": "SELECT notebook_uuid, CASE document_type WHEN 'epub' THEN 'books' WHEN 'pdf' THEN 'articles' ELSE 'books' END AS category, coalesce(nullif(authors, ''), 'Unknown') AS author FROM d_notebook",
    "f21_note": "SELECT id, concat_ws(' | ', concat('Page ', page_number), CASE WHEN confidence < 0.5 THEN 'Low confidence' END, CASE WHEN corrected_text IS NOT NULL THEN 'Corrected' END) AS note FROM d_highlight",
    "f23_reasons": f"WITH latest AS ({LATEST}) SELECT p.page_uuid, CASE WHEN r = '' THEN 'no_changes' ELSE r END AS reasons FROM (SELECT p.page_uuid, concat_ws(', ', CASE WHEN l.content_hash <> sha256(p.text) THEN 'content_changed' END, CASE WHEN p.updated_ms > l.synced_ms THEN 'accessed_since_sync' END) AS r FROM d_page p JOIN latest l ON l.item_id = p.page_uuid) p",
    "t4_export": "SELECT completed, count(*) AS n, min(text) AS first_text FROM d_todo GROUP BY completed",
    "n6_natural_key": "SELECT id FROM (SELECT id, row_number() OVER (PARTITION BY notebook_uuid, page_number, text, actual_date ORDER BY id) AS rn FROM d_todo) t WHERE rn > 1",
    # todos that were read in again, some without their date
    "n6_read_again": f"SELECT id FROM (SELECT id, row_number() OVER (PARTITION BY notebook_uuid, page_number, text, actual_date ORDER BY id) AS rn FROM ({READ_AGAIN}) a) t WHERE rn > 1",
    "n6_without_date": f"SELECT id FROM (SELECT id, row_number() OVER (PARTITION BY notebook_uuid, page_number, text ORDER BY CASE WHEN actual_date IS NULL THEN 1 ELSE 0 END, id) AS rn FROM ({READ_AGAIN}) a) t WHERE rn > 1",
}
