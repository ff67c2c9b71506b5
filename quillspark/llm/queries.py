"""The registered queries of this subpackage, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm import chunks, decontam, jaccard, mixing, negatives, packing, quality, records, rules, shards, spelling, suffixes, warc
from quillspark.llm.common import work_dir


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = work_dir(spark, "op1")
    parts = records.write_records(_read(spark, sf_dir, "documents"), folder, tokenizer("word_bpe_49k.json"), end_id=1)
    return records.read_records(spark, folder, parts, with_ids=False)


def op2_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = work_dir(spark, "op2")
    parts = warc.write_archives(_read(spark, sf_dir, "pages"), folder)
    return warc.read_archives(spark, folder, parts).drop("payload", "url")


def op4_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"), work_dir(spark, "op4"))


def op5_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = shards.hilbert_shards(_read(spark, sf_dir, "documents"), ["lang", "source", "n_chars", "doc_id"], work_dir(spark, "op5"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = packing.pieces(_read(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"), end_id=0, capacity=2048)
    return packing.pack(found, work_dir(spark, "op6"), capacity=2048)


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"), work_dir(spark, "op3"))


def op7_suffix_family(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.deduplicate(_read(spark, sf_dir, "documents"), work_dir(spark, "op7"))


def op8_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.component_table(_read(spark, sf_dir, "documents"), work_dir(spark, "op8"), words_each=3, percent=90)


def op9_gear_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks.deduplicate(_read(spark, sf_dir, "documents"), work_dir(spark, "op9"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    return rules.judge(docs, rules.train(docs, _read(spark, sf_dir, "labels")))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = _read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), moved.alias("label"), F.col("embedding").alias("vector"))
    return negatives.mine(rows, 100, work_dir(spark, "op11"))


def op12_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_read(spark, sf_dir, "documents"), work_dir(spark, "op12")).select("doc_id", "size", "source_size", "target", "taken", "source")


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(_read(spark, sf_dir, "documents"), work_dir(spark, "op13"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_token_records, op2_warc_revisits, op3_quality_classifier, op4_benchmark_decontamination, op5_hilbert_shards, op6_best_fit_packing, op7_suffix_family, op8_ngram_jaccard, op9_gear_chunks, op10_quality_rules, op11_hard_negatives, op12_source_mix, op13_spelling_variants)}


#: Equal payloads by their text; of those of 1000 bytes the largest page_id is the response.
_WARC = """SELECT page_id, size AS payload_bytes, digest AS payload_digest, if(best IS NULL, 'response', 'revisit') AS record_type, best AS refers_to
FROM (SELECT page_id, strlen(h) AS size, sha1(h) AS digest, if(strlen(h) >= 1000 AND page_id < max(page_id) OVER (PARTITION BY h), max(page_id) OVER (PARTITION BY h), NULL) AS best
      FROM (SELECT page_id, coalesce(html, '') AS h FROM pages) p) q"""
#: All pairs of documents that share a shingle, then all that pairs reach.
_JACCARD = r"""WITH RECURSIVE split AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents),
sets AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS s FROM split),
each AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM sets),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b FROM each a JOIN each b ON b.x = a.x AND b.doc_id <> a.doc_id AND 10 * least(a.n, b.n) >= 9 * greatest(a.n, b.n) GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 90 * (a.n + b.n - count(*))),
reach AS (SELECT doc_id AS a, doc_id AS b FROM sets UNION SELECT r.a, p.b FROM reach r JOIN pairs p ON p.a = r.b)
SELECT s.doc_id, len(s.s) AS n_shingles, c.low AS component_id FROM sets s JOIN (SELECT a, min(b) AS low FROM reach GROUP BY a) c ON c.a = s.doc_id"""

#: All anchors with all rows.
_NEGATIVES = """WITH v AS (SELECT vec_id AS id, if(vec_id % 7 = 0, (label + 1) % 10, label) AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q FROM embeddings
      WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.id AS anchor_id, b.id AS other, a.label = b.label AS same, CAST(list_dot_product(a.q, b.q) AS BIGINT) AS score FROM v a JOIN v b ON a.id % 100 = 0 AND b.id <> a.id),
p AS (SELECT anchor_id, other AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5)
SELECT p.anchor_id, p.positive_id, CAST(row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.other) AS INTEGER) AS rank, s.other AS negative_id, p.positive_score, s.score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND 100 * s.score BETWEEN 30 * p.positive_score AND 90 * p.positive_score
QUALIFY row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.other) <= 10"""


def oracle_sql() -> dict[str, str]:
    """The others need a tokenizer, a fitted model, bytes or a curve, or all windows of all texts: tests hold them against brute force."""
    return {"op2_warc_revisits": _WARC, "op8_ngram_jaccard": _JACCARD, "op11_hard_negatives": _NEGATIVES}
