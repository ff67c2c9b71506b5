"""The pipeline against a brute-force composition of its stages, and on odd tables."""

import numpy as np

import corpus_pipeline
from quillspark.llm import quality, queries
from quillspark.llm.common import work_dir

from .helpers import awkward, empty
from .test_decontam import brute as leaks
from .test_files import ids_of
from .test_jaccard import brute as groups


def cut(rows, match=50):
    first = {}
    for doc, text in rows:
        b = text.encode()
        for i in range(len(b) - match + 1):
            first[b[i : i + match]] = min(doc, first.get(b[i : i + match], doc))
    out = {}
    for doc, text in rows:
        b = text.encode()
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - match + 1):
            if first[b[i : i + match]] < doc:
                gone[i : i + match] = True
        if not len(b) or not gone.all():
            out[doc] = bytes(np.frombuffer(b, np.uint8)[~gone]).decode(errors="ignore")
    return out


def test_against_brute_force(spark, sf):
    docs, labels, items = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels", "benchmark"))
    good = {r.doc_id for r in quality.classify(docs, labels, work_dir(spark, "tp")).collect() if r.predicted}
    texts = {r.doc_id: r.text for r in docs.collect() if r.doc_id in good}
    texts = {d: texts[d] for d, n, c in groups(list(texts.items()), 5, 80) if n == 0 or d == c}
    texts = cut(list(texts.items()))
    dirty = {d for d, _ in leaks(list(texts.items()), items.select("item_id", "text").collect())}
    texts = {d: t for d, t in texts.items() if d not in dirty}
    want = {d: len(x) for d, x in zip(texts, ids_of("byte_bpe_50k.json", texts.values(), 0), strict=True)}
    got = {}
    for r in corpus_pipeline.run(spark, sf).collect():
        got[r.doc_id] = got.get(r.doc_id, 0) + r.length
    assert got == want and 0 < len(dirty)


def test_odd_tables_keep_their_columns(spark, sf):
    for docs in (awkward(spark), empty(spark)):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, sf)
            assert out.columns == docs.columns and [f.dataType for f in out.schema] == [f.dataType for f in docs.schema]
            assert out.count() <= docs.count()
        assert corpus_pipeline.STAGES[-1][1](spark, docs, sf).count() >= docs.count()


def test_suffix_stage_keeps_rows_and_columns(spark, sf):
    docs = awkward(spark)
    rows = corpus_pipeline.suffix_array_dedup(spark, docs, sf).collect()
    own = {(r.doc_id, r.source, r.rank) for r in docs.collect()}
    assert {(r.doc_id, r.source, r.rank) for r in rows} <= own
    assert all(r.n_chars == len(r.text) for r in rows)
    assert {r.doc_id for r in rows} >= {0, 3, 4, 5, 6, 7, 8, 10, 11, 12}


def test_names():
    assert [n.split("_")[0] for n in queries.queries()] == ["op1", "op2", "op3", "op4", "op5", "op6", "op7", "op8", "op9", "op10"]
