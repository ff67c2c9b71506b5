
from quillspark.plans.adapters import NOW
from quillspark.plans.relational import LATEST

#: Ligatures that recognition loses, in order. Each is a whole word, in any case.
LIGATURES = [
    ("gratiDcation", "gratification"), ("speciDc", "specific"), ("spociDc", "specific"), ("deDning", "defining"), ("Dghts", "fights"),
    ("Dnal", "final"), ("Drst", "first"), ("Dle", "file"), ("Daws", "flaws"), ("signiDcant", "significant"), ("beneDto", "benefit"),
    ("Dlled", "filled"), ("Dnd", "find"), ("Dx", "fix"), ("e:ectively", "effectively"), ("e:icient", "efficient"), ("e:ect", "effect"),
    ("e:ort", "effort"), ("di:erent", "different"), ("di:icult", "difficult"), ("o:er", "offer"), ("su:ering", "suffering"),
    ("sta:ing", "staffing"), ("a:ected", "affected"), ("a:ection", "affection"),
]
#: What a stroke file holds beside text.
UNWANTED = ["reMarkable .lines file, version=6", "reMarkable .lines file, version=3", "Layer 1<", "Layer 2<", "Layer 3<", "Layer 4<", "Layer 5<"]
UNWANTED_PARTS = ["Layer 1<", "Layer 2<", "Layer 3<", "Layer 4<", "Layer 5<", ".lines file", "remarkable", "version="]


def ocr_repair(text: str, parity: bool = False) -> str:
    """SQL of text with lost ligatures restored. parity: the general rules ignore case, and so corrupt ordinary words."""
    case = "(?i)" if parity else ""
    rules = [(rf"(?i)\b{a}\b", b) for a, b in LIGATURES]
    rules += [(case + r"([a-z])D([cefilmnrstuvwy])\b", r"<1>fi<2>"), (case + "([a-z]):([a-z])", "<1>ff<2>"), (r"(?i)\brn\b", "m"), (r"(?i)\bcl\b", "d"), ("[ \\t\\n\\r\\f]+", " ")]
    for pattern, to in rules:
        text = f"regexp_replace({text}, '{pattern}', '{to}', 'g')"
    return f"trim({text})"


SPLIT_STATE = f"WITH latest AS ({LATEST})"
LINES = "concat('# ', role, '\n\n- [ ] ', replace(replace(text, ', ', '\n- [X] '), '. ', '.\n* '), '\n12. ', role, '\n---\nDate: ', conv_id % 35, '/', turn + 6, '/2', turn)"
_SEEN = "SELECT notebook_uuid, count(DISTINCT page_number) AS total FROM d_sync WHERE status = 'success' GROUP BY notebook_uuid"
_OLD = "SELECT notebook_uuid, CASE WHEN length(notebook_uuid) % 2 = 0 THEN full_path ELSE concat(coalesce(full_path, ''), '/old') END AS full_path, last_opened_ms FROM d_notebook WHERE document_type <> 'epub'"

SQL = {
    "c3_highlights": "SELECT h.id, CASE WHEN g.h IS NULL THEN 'never_synced_to_target' WHEN g.h <> sha256(h.original_text) THEN 'content_changed' ELSE 'no_changes' END AS reason FROM d_highlight h LEFT JOIN (SELECT source_id, max(hash_after) AS h FROM d_log WHERE source_table = 'highlights' AND status = 'processed' GROUP BY source_id) g ON g.source_id = CAST(h.id AS VARCHAR(20))",
    "c5_page_state": f"{SPLIT_STATE} SELECT p.notebook_uuid, p.page_number, CASE WHEN coalesce(l.content_hash, '') = '' THEN 'new' WHEN l.content_hash <> sha256(p.text) THEN 'changed' ELSE 'same' END AS state FROM d_page p LEFT JOIN latest l ON l.item_id = p.page_uuid AND l.target = 'notion'",
    "c6_legacy_tracker": f"{SPLIT_STATE} SELECT p.page_uuid, CASE WHEN p.page_number > coalesce(s.total, 0) THEN 'new' ELSE 'changed' END AS kind FROM d_page p LEFT JOIN ({_SEEN}) s ON s.notebook_uuid = p.notebook_uuid LEFT JOIN latest l ON l.item_id = p.page_uuid WHERE l.content_hash IS NULL OR l.content_hash <> sha256(p.text)",
    "c7_should_sync": f"{SPLIT_STATE} SELECT p.notebook_uuid, count(l.item_id) = 0 AS is_new, count(l.item_id) = 0 OR max(CASE WHEN l.content_hash <> sha256(p.text) THEN 1 ELSE 0 END) = 1 OR max(CASE WHEN p.updated_ms > l.synced_ms THEN 1 ELSE 0 END) = 1 AS should_sync FROM d_page p LEFT JOIN latest l ON l.item_id = p.page_uuid GROUP BY p.notebook_uuid",
    "c10_todos_enriched": f"{SPLIT_STATE} SELECT t.id, n.visible_name, s.external_id FROM d_todo t LEFT JOIN d_notebook n ON n.notebook_uuid = t.notebook_uuid LEFT JOIN d_sync s ON s.notebook_uuid = t.notebook_uuid AND s.page_number = t.page_number AND s.status = 'success' LEFT JOIN latest l ON l.item_id = s.item_id AND l.target = s.target WHERE t.completed = FALSE AND (l.content_hash IS NULL OR l.content_hash <> sha256(t.text))",
    "c11_highlights_need": "SELECT h.id, n.visible_name FROM d_highlight h LEFT JOIN d_notebook n ON n.notebook_uuid = h.notebook_uuid WHERE NOT EXISTS (SELECT 1 FROM d_sync s WHERE s.status = 'success' AND s.content_hash = sha256(h.original_text))",
    "c14_metadata_diff": f"SELECT coalesce(n.notebook_uuid, o.notebook_uuid) AS notebook_uuid, CASE WHEN o.notebook_uuid IS NULL THEN 'new' WHEN coalesce(n.full_path, '') <> coalesce(o.full_path, '') THEN 'path' WHEN coalesce(n.last_opened_ms, 0) <> coalesce(o.last_opened_ms, 0) THEN 'opened' ELSE 'same' END AS change FROM d_notebook n FULL OUTER JOIN ({_OLD}) o ON o.notebook_uuid = n.notebook_uuid",
    "c15_metadata_upsert": f"SELECT n.notebook_uuid, n.full_path, n.document_type = 'notebook' AS tracked FROM d_notebook n LEFT JOIN ({_OLD}) o ON o.notebook_uuid = n.notebook_uuid WHERE o.notebook_uuid IS NULL OR coalesce(n.full_path, '') <> coalesce(o.full_path, '')",
    "c16_page_gate": "SELECT p.page_uuid FROM d_page p WHERE length(p.text) > 0 AND NOT EXISTS (SELECT 1 FROM d_sync s WHERE s.notebook_uuid = p.notebook_uuid AND s.page_number = p.page_number AND s.content_hash = sha256(p.text))",
    "c18_pending_matrix": "SELECT i.kind, i.target, count(*) AS items, count(s.item_id) AS synced, count(*) - count(s.item_id) AS pending FROM (SELECT 'page' AS kind, page_uuid AS item, 'notion' AS target FROM d_page UNION ALL SELECT 'page', page_uuid, 'readwise' FROM d_page UNION ALL SELECT 'page', page_uuid, 'archive' FROM d_page UNION ALL SELECT 'todo', CAST(id AS VARCHAR(20)), 'notion' FROM d_todo UNION ALL SELECT 'todo', CAST(id AS VARCHAR(20)), 'readwise' FROM d_todo UNION ALL SELECT 'todo', CAST(id AS VARCHAR(20)), 'archive' FROM d_todo UNION ALL SELECT 'highlight', CAST(id AS VARCHAR(20)), 'notion' FROM d_highlight UNION ALL SELECT 'highlight', CAST(id AS VARCHAR(20)), 'readwise' FROM d_highlight UNION ALL SELECT 'highlight', CAST(id AS VARCHAR(20)), 'archive' FROM d_highlight) i LEFT JOIN (SELECT DISTINCT 'page' AS kind, item_id, target FROM d_sync WHERE status = 'success' UNION ALL SELECT 'todo', CAST(todo_id AS VARCHAR(20)), 'notion' FROM d_todo_sync UNION ALL SELECT DISTINCT 'highlight', source_id, 'readwise' FROM d_log WHERE source_table = 'highlights' AND status = 'processed') s ON s.kind = i.kind AND s.item_id = i.item AND s.target = i.target GROUP BY i.kind, i.target",
    "c19_baseline": "SELECT p.page_uuid, CASE WHEN r.h IS NULL THEN 'needs_sync' ELSE 'already_synced' END AS state FROM d_page p LEFT JOIN (SELECT DISTINCT content_hash AS h FROM d_sync WHERE target = 'notion') r ON r.h = sha256(p.text)",
    "c22_legacy_mappers": "SELECT h, min(concat(kind, ' ', item_id)) AS first_item, count(*) AS n FROM (SELECT 'page_text' AS kind, item_id, content_hash AS h FROM d_sync WHERE status = 'success' UNION ALL SELECT 'todo', CAST(id AS VARCHAR(20)), sha256(concat('todo|', id)) FROM d_todo WHERE completed UNION ALL SELECT 'highlight', CAST(id AS VARCHAR(20)), sha256(original_text) FROM d_highlight) a GROUP BY h",
    "c23_validation": "SELECT item_type, status, count(*) AS n, sum(CASE WHEN content_hash IS NULL OR length(content_hash) <> 64 THEN 1 ELSE 0 END) AS bad_hashes, count(external_id) AS with_block FROM d_sync GROUP BY item_type, status",
    "c25_page_backfill": "SELECT p.page_uuid, EXISTS (SELECT 1 FROM d_todo t WHERE t.notebook_uuid = p.notebook_uuid AND t.page_number = p.page_number) AS is_remote FROM d_page p WHERE p.page_uuid NOT IN (SELECT item_id FROM d_sync WHERE status = 'success')",
    "c26_rehash": "SELECT s.id, s.content_hash AS old_hash, sha256(p.text) AS new_hash FROM d_sync s JOIN d_page p ON p.page_uuid = s.item_id WHERE s.content_hash <> sha256(p.text)",
    "c27_audit_flag": "SELECT p.page_uuid, coalesce(b.blocks, 0) > 1 OR coalesce(b.lost, 0) > 0 AS possible_duplicate FROM d_page p LEFT JOIN (SELECT item_id, count(external_id) AS blocks, count(*) - count(external_id) AS lost FROM d_sync GROUP BY item_id) b ON b.item_id = p.page_uuid",
    "c28_uuid_baseline": "SELECT p.notebook_uuid, 'uuid' AS match_method, md5(listagg(p.text, '') WITHIN GROUP (ORDER BY p.page_number)) AS h FROM d_page p WHERE p.notebook_uuid IN (SELECT notebook_uuid FROM d_sync) GROUP BY p.notebook_uuid",
    "c30_methods": f"WITH found AS (SELECT 'old' AS method, id, md5(original_text) AS h FROM d_highlight UNION ALL SELECT 'new', id, md5(coalesce(corrected_text, original_text)) FROM d_highlight UNION ALL SELECT 'enhanced', id, md5({ocr_repair('coalesce(corrected_text, original_text)')}) FROM d_highlight) SELECT a.method, count(*) AS n, count(DISTINCT a.h) AS texts, sum(CASE WHEN b.h <> a.h THEN 1 ELSE 0 END) AS differ_from_old FROM found a JOIN found b ON b.id = a.id AND b.method = 'old' GROUP BY a.method",
    # fingerprints
    "x8_page_md5": "SELECT page_uuid, md5(concat(text, ':', CAST(confidence AS VARCHAR(30)))) AS h FROM d_page",
    "x12_target_md5": "SELECT notebook_uuid, md5(listagg(concat('page_', page_number, ':', text, ':', CAST(confidence AS VARCHAR(30))), '|') WITHIN GROUP (ORDER BY page_number)) AS h FROM d_page GROUP BY notebook_uuid",
    # changelog and sync bookkeeping
    "g2_typed_changes": "SELECT 'pages' AS source_table, page_uuid AS source_id, sha256(concat_ws('|', concat('text:', text), concat('page_number:', page_number))) AS h FROM d_page UNION ALL SELECT 'todos', CAST(id AS VARCHAR(20)), sha256(concat_ws('|', concat('text:', text), CASE WHEN actual_date IS NOT NULL THEN concat('actual_date:', actual_date) END)) FROM d_todo",
    "g4_mark": f"SELECT g.id, CASE WHEN m.id IS NULL THEN g.status ELSE 'processed' END AS status, CASE WHEN m.id IS NOT NULL THEN {NOW} END AS processed_ms FROM d_log g LEFT JOIN (SELECT id FROM d_log WHERE status = 'pending' AND id % 10 = 4) m ON m.id = g.id",
    "g6_batch": "SELECT id AS source_id, 'INSERT' AS operation, CASE WHEN length(text) > 0 THEN sha256(text) END AS hash_after FROM d_todo",
    "e8_transitions": "SELECT id, CASE WHEN status = 'success' THEN 'success' WHEN status = 'failed' AND retry_count < 5 THEN 'retry' WHEN status = 'failed' THEN 'failed' ELSE status END AS next_status, CASE WHEN status = 'failed' THEN retry_count + 1 ELSE retry_count END AS retry_count FROM d_sync",
    "e10_expansion": "SELECT p.page_uuid, CASE WHEN EXISTS (SELECT 1 FROM d_sync s WHERE s.notebook_uuid = p.notebook_uuid AND s.status = 'success') THEN 'page' ELSE 'notebook' END AS unit FROM d_page p WHERE p.page_uuid NOT IN (SELECT item_id FROM d_sync WHERE status = 'success')",
    "e15_audit": f"SELECT page_uuid, 'append' AS operation, {NOW} AS at_ms, length(text) AS n FROM d_page UNION ALL SELECT item_id, 'update', synced_ms, 0 FROM d_sync WHERE external_id IS NOT NULL",
    # scans whose rows are here in tables
    "s15_restore": "SELECT p.notebook_uuid, p.page_uuid, p.page_number FROM d_page p LEFT JOIN (SELECT notebook_uuid, page_uuid, page_number FROM d_page WHERE page_number % 3 <> 0) live ON live.notebook_uuid = p.notebook_uuid AND live.page_uuid = p.page_uuid AND live.page_number = p.page_number WHERE live.page_uuid IS NULL",
    "s18_allow_list": "SELECT n.notebook_uuid FROM d_notebook n WHERE n.visible_name IN (SELECT line FROM (SELECT trim(line) AS line FROM (SELECT 'Notebook 1' AS line UNION ALL SELECT ' Notebook 7 ' UNION ALL SELECT '# Notebook 8' UNION ALL SELECT '') raw) t WHERE line <> '' AND line NOT LIKE '#%')",
    # scalar functions
    "f3_todo_norm": r"SELECT id, regexp_replace(regexp_replace(lower(trim(text)), '[ \t\n\r]+', ' ', 'g'), '[^\p{L}\p{N}_ \t\n\r:.-]', '', 'g') AS clean FROM d_todo",
    "f7_ocr_repair": f"SELECT doc_id, md5(repaired) AS h, repaired <> text AS changed FROM (SELECT doc_id, text, {ocr_repair('text')} AS repaired FROM (SELECT doc_id, replace(replace(text, ' the ', ' speciDc '), ' and ', ' e:ect ') AS text FROM documents) d) t",
    "f7_ocr_repair_parity": f"SELECT item_id, {ocr_repair('text', parity=True)} AS repaired FROM benchmark",
    "f9_block_lists": "SELECT page_uuid, fragment FROM (SELECT page_uuid, trim(replace(concat(CASE WHEN page_number % 4 = 0 THEN 'Layer 1<' WHEN page_number % 4 = 1 THEN 'l!' ELSE '' END, text), 'l!', '')) AS fragment FROM d_page) t WHERE fragment NOT IN (" + ", ".join(f"'{x}'" for x in UNWANTED) + ") AND " + " AND ".join(f"lower(fragment) NOT LIKE '%{x.lower()}%'" for x in UNWANTED_PARTS),
    "f10_collate": "SELECT notebook_uuid, count(*) AS fragments, listagg(fragment, ' ') WITHIN GROUP (ORDER BY page_number) AS text FROM (SELECT notebook_uuid, page_number, trim(text) AS fragment FROM d_page) t WHERE length(fragment) > 0 GROUP BY notebook_uuid",
    "f11_demotion": "SELECT id, round(CASE WHEN corrected_text IS NULL THEN confidence * CAST(0.9 AS DOUBLE) ELSE confidence END, 9) AS confidence FROM d_highlight",
    "f16_ms": "SELECT id, CASE WHEN regexp_extract(raw, '^([0-9]+)$', 1) <> '' THEN CAST(regexp_extract(concat(raw, '|0'), '([0-9]+)', 1) AS BIGINT) END AS at_ms FROM (SELECT id, CASE WHEN id % 3 = 0 THEN 'unknown' ELSE CAST(changed_ms AS VARCHAR(20)) END AS raw FROM d_log) t",
    "f17_fence": "SELECT item_id, CASE WHEN body <> '' THEN body ELSE raw END AS text FROM (SELECT item_id, raw, regexp_extract(raw, '(?s)^```(markdown|md|text)?[ \\t]*\\n(.*?)\\n```$', 2) AS body FROM (SELECT item_id, concat('```', CASE item_id % 3 WHEN 0 THEN 'markdown' WHEN 1 THEN 'mermaid' ELSE '' END, '\n', text, '\n```') AS raw FROM benchmark) f) t",
    "f22_source_file": "SELECT source_file, CASE WHEN source_file LIKE '%.content' THEN substr(source_file, 1, length(source_file) - 8) WHEN source_file LIKE '%/%.rm' THEN split_part(source_file, '/', 1) WHEN length(source_file) = 36 AND length(replace(source_file, '-', '')) = 32 THEN source_file END AS notebook_uuid, CASE WHEN source_file LIKE '%/%.rm' THEN regexp_extract(source_file, '([^/]*)[.]rm$', 1) END AS page_uuid FROM (SELECT CASE page_number % 3 WHEN 0 THEN concat(notebook_uuid, '.content') WHEN 1 THEN concat(notebook_uuid, '/', page_uuid, '.rm') ELSE concat(notebook_uuid, page_uuid) END AS source_file FROM d_page) t",
    "f25_distance": "SELECT a.id, round(sqrt(power(a.page_number + 2.0 - b.page_number - 3.0, 2) + power(a.id % 50 + 1.0 - b.id % 40, 2)), 6) AS distance FROM d_highlight a JOIN d_highlight b ON b.id = a.id + 1",
}
