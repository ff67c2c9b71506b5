"""A corpus from raw documents to packed sequences: five stages, each written as Parquet and read by the next.

All but the last stage return rows of documents with all columns as they came, whatever their names; suffix_array_dedup changes text and
n_chars. Every stage takes empty tables, giving no rows, and nulls in any column; null texts count as empty. Texts of any length are
looked at whole. A stage's result must be written before the next stage is called, which deletes the files that it was read from.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillspark.llm import decontam, jaccard, packing, quality, suffixes
from quillspark.llm.common import remove, work_dir
from quillspark.llm.queries import tokenizer

_used: list[str] = []


def fresh(spark: SparkSession, name: str) -> str:
    """A folder for a stage's own files; those of the stage before go, as its result is written."""
    while _used:
        remove(_used.pop())
    _used.append(work_dir(spark, name))
    return _used[-1]


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored 0.5 or more stay. Null and empty texts are scored like others; repeated rows fare alike."""
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), fresh(spark, "quality"))


def ngram_jaccard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id of each group of near-duplicates stays: five words, 80 %.

    Null doc_ids come last; of equal ones, the text with the smallest md5 stays, once. Texts without words all stay.
    """
    return jaccard.one_of_each(docs, fresh(spark, "jaccard"), words_each=5, percent=80)


def suffix_array_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Strings of 50 bytes or more that a smaller doc_id has are cut out of the texts; documents that lose all go.

    Null doc_ids come last; equal ones (null, too) cut nothing out of each other. Null and empty texts stay, empty.
    """
    return suffixes.cut(docs, fresh(spark, "suffixes"))


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark stay: similarity 0.8 of five-word shingles. Rows are judged by text; null and empty ones stay."""
    return decontam.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), fresh(spark, "decontam"))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every piece of every document with its place in sequences of at most 2048 tokens; repeated rows and null doc_ids have pieces of their own."""
    return packing.pack(packing.pieces(docs, tokenizer("byte_bpe_50k.json"), end_id=0, capacity=2048), fresh(spark, "packing"), capacity=2048)


STAGES = [(f.__name__, f) for f in (quality_classifier, ngram_jaccard, suffix_array_dedup, benchmark_decontamination, best_fit_packing)]

#: SQL can't express a trained classifier or a tokenizer; tests/llm/test_pipeline.py holds run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = work_dir(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = None
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        if before:
            remove(f"{folder}/{before}")
        before = name
    fresh(spark, "done")
    return docs
