"""The notes domain over the driver's tables, as SQL that Spark and DuckDB both read.

Times are milliseconds, and "now" is a value in the query, so results don't depend on the clock. sha256(x) is Spark's sha2(x, 256).
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

NOW = 1710000000000
DAY = 86400000
TABLES = ["region", "nation", "customer", "supplier", "orders", "lineitem", "events", "documents", "pages", "benchmark", "conversations"]

DOMAIN = {
    "d_page": """SELECT concat('nb-', conv_id) AS notebook_uuid, concat('pg-', conv_id, '-', turn) AS page_uuid, turn + 1 AS page_number, text,
        CAST(0.5 AS DOUBLE) + CAST(length(text) % 50 AS DOUBLE) / CAST(100 AS DOUBLE) AS confidence, 1704067200000 + conv_id * 7200000 + turn * 60000 AS updated_ms
        FROM conversations""",
    "d_notebook": """SELECT concat('nb-', conv_id) AS notebook_uuid, concat('Notebook ', conv_id) AS visible_name,
        CASE conv_id % 5 WHEN 0 THEN concat('Work/Archive/Notebook ', conv_id) WHEN 1 THEN concat('Work/Projects/Notebook ', conv_id) WHEN 2 THEN concat('Home/Notebook ', conv_id) WHEN 3 THEN concat('Notebook ', conv_id) END AS full_path,
        CASE conv_id % 3 WHEN 0 THEN 'notebook' WHEN 1 THEN 'pdf' ELSE 'epub' END AS document_type,
        CASE WHEN conv_id % 7 <> 0 THEN 1704067200000 + conv_id * 7200000 + 400000 END AS last_opened_ms,
        1704067200000 + conv_id * 7200000 AS modified_ms, CASE WHEN conv_id % 4 <> 0 THEN concat('Author ', conv_id % 20) END AS authors, count(*) AS total_pages
        FROM conversations GROUP BY conv_id""",
    "d_todo": """SELECT doc_id AS id, concat('nb-', doc_id % 60) AS notebook_uuid, doc_id % 7 + 1 AS page_number, text, doc_id % 5 = 0 AS completed,
        CASE WHEN doc_id % 3 = 0 THEN concat('2024-', lpad(CAST(doc_id % 12 + 1 AS VARCHAR(2)), 2, '0'), '-', lpad(CAST(doc_id % 28 + 1 AS VARCHAR(2)), 2, '0')) END AS actual_date,
        1704067200000 + doc_id * 600000 AS created_ms FROM documents""",
    "d_highlight": """SELECT item_id AS id, concat('nb-', item_id % 40) AS notebook_uuid, item_id % 9 + 1 AS page_number, text AS original_text,
        CASE WHEN item_id % 3 = 0 THEN concat(text, ' (read again)') END AS corrected_text, CAST(item_id % 10 AS DOUBLE) / CAST(10 AS DOUBLE) AS confidence, 1704067200000 + item_id * 86400000 AS created_ms FROM benchmark""",
    "d_sync": """SELECT conv_id * 100 + turn AS id, concat('pg-', conv_id, '-', turn) AS item_id, concat('nb-', conv_id) AS notebook_uuid, turn + 1 AS page_number, 'page_text' AS item_type,
        CASE WHEN conv_id % 2 = 0 THEN 'notion' ELSE 'readwise' END AS target, CASE (conv_id + turn) % 6 WHEN 0 THEN 'failed' WHEN 1 THEN 'retry' WHEN 2 THEN 'pending' ELSE 'success' END AS status,
        CASE WHEN (conv_id + turn) % 7 = 0 THEN sha256(concat(text, 'x')) ELSE sha256(text) END AS content_hash, CASE WHEN turn % 3 <> 2 THEN concat('bl-', conv_id, '-', turn) END AS external_id,
        1704067200000 + conv_id * 7200000 + turn * 60000 + 90000 AS synced_ms, (conv_id + turn) % 7 AS retry_count FROM conversations WHERE conv_id % 3 <> 0
        UNION ALL SELECT conv_id * 100 + turn + 50, concat('pg-', conv_id, '-', turn), concat('nb-', conv_id), turn + 1, 'page_text', 'notion', 'success', sha256(concat(text, 'old')), NULL, 1704067200000 + conv_id * 7200000, 0 FROM conversations WHERE conv_id % 6 = 2""",
    "d_log": """SELECT event_id AS id, CASE user_id % 4 WHEN 0 THEN 'notebooks' WHEN 1 THEN 'pages' WHEN 2 THEN 'todos' ELSE 'highlights' END AS source_table, CAST(user_id AS VARCHAR(20)) AS source_id,
        CASE event_type WHEN 'signup' THEN 'INSERT' WHEN 'error' THEN 'DELETE' ELSE 'UPDATE' END AS operation, 1704067200000 + event_id * 50000 AS changed_ms,
        CASE WHEN event_id % 11 <> 0 THEN sha256(CAST(CAST(floor(value) AS BIGINT) % 5 AS VARCHAR(20))) END AS hash_after, CASE event_id % 4 WHEN 0 THEN 'pending' WHEN 1 THEN 'failed' ELSE 'processed' END AS status, props FROM events""",
    "d_todo_sync": "SELECT doc_id AS todo_id, concat('nt-', doc_id) AS notion_page_id, 1704067200000 + doc_id * 600000 + 1000 AS exported_ms FROM documents WHERE doc_id % 6 = 0",
    "d_migration": "SELECT r_regionkey + 1 AS version, r_name AS description FROM region",
    "d_folder": """SELECT concat('r', r_regionkey) AS uuid, CAST(NULL AS VARCHAR(30)) AS parent, r_name AS name, 'folder' AS item_type FROM region
        UNION ALL SELECT concat('n', n_nationkey), concat('r', n_regionkey), n_name, 'folder' FROM nation
        UNION ALL SELECT concat('c', c_custkey), CASE WHEN c_custkey % 50 = 7 THEN 'trash' WHEN c_custkey % 50 = 9 THEN 'gone' ELSE concat('n', c_nationkey) END, c_name, 'document' FROM customer
        UNION ALL SELECT concat('s', s_suppkey), CASE WHEN s_suppkey % 10 = 3 THEN 'c7' ELSE concat('n', s_nationkey) END, s_name, 'document' FROM supplier""",
}


def with_domain(sql: str) -> str:
    """sql after the domain tables that it names, as common table expressions."""
    recursive, body = ("RECURSIVE ", sql.removeprefix("WITH RECURSIVE ")) if sql.startswith("WITH RECURSIVE ") else ("", sql.removeprefix("WITH ") if sql.startswith("WITH ") else sql)
    own = ", ".join(f"{k} AS ({v})" for k, v in DOMAIN.items() if re.search(rf"\b{k}\b", sql))
    if not own:
        return sql
    return f"WITH {recursive}{own}{', ' if body is not sql else ' '}{body}"


def to_spark(sql: str) -> str:
    while (m := re.search(r"\bsha256\(", sql)) is not None:
        depth, at = 1, m.end()
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[at], 0)
            at += 1
        sql = f"{sql[: m.start()]}sha2({sql[m.end() : at - 1]}, 256){sql[at:]}"
    sql = re.sub(r"VARCHAR\(\d+\)", "STRING", sql).replace(", 'g')", ")")
    sql = re.sub(r"<(\d)>", r"$\1", sql)  # groups in replacements
    return sql.replace("\\", "\\\\")  # Spark's string literals have escapes


def to_duckdb(sql: str) -> str:
    sql = re.sub(r"<(\d)>", r"\\\1", sql)
    sql = re.sub(r"\bstruct\(", "row(", sql)
    sql = re.sub(r"\bregexp_like\(", "regexp_matches(", sql)
    sql = re.sub(r"get_json_object\(([^,]*), ", r"json_extract_string(\1, ", sql)
    return re.sub(r"listagg\((.*?)\) WITHIN GROUP \(ORDER BY ([^)]*)\)", r"string_agg(\1 ORDER BY \2)", sql, flags=re.S)


def run(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """Tables are read by path, so folders don't cross and the session gets no names."""
    def read(m: re.Match) -> str:
        return f"{m[1]} parquet.`{sf_dir}/{m[2]}.parquet`{'' if m[3] else f' AS {m[2]}'}{m[3] or ''}"

    return spark.sql(re.sub(rf"\b(FROM|JOIN|,) ({'|'.join(TABLES)})\b(\s+(?:AS\s+)?(?!WHERE|GROUP|UNION|JOIN|LEFT|ON|ORDER|INNER|EXCEPT)[a-z]\w*)?", read, to_spark(sql)))
