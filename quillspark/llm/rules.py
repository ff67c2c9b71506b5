"""Quality rules: fixed base counts, then a logistic regression on hashed word and character n-grams.

A text's features are the shares of its hashed words, word pairs and triples of characters, each kind summing to one, so that a
score is a sum of gathered weights: whole Arrow batches are scored without a loop over texts. The model is fitted on the
driver, on at most ``sample`` labelled rows a class (those with the smallest hashes of doc_id, so any input has one choice), of which it gets
at most 2^BITS cells a kind, however long the texts,
and calibrated to the prior of all labels on a third of the rows that it wasn't fitted on. Rows whose crc32(doc_id) mod 3 is 1 are left out,
to measure it.

Null and empty texts have no words, so the base rules fail them. Null doc_ids are kept in the result. Without labels of both
classes there's no model, and only the base rules judge. Labels for unknown documents and null labels are left out. Ties, repeated rows
and repeated labels count each. A text of any length is scored whole by its task. An empty table gives no rows. Columns other than
doc_id and text aren't read, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import arrow, grams, per_text, prepare, text_slices
from quillspark.llm.textstats import Counts, count

BITS = 16
KINDS = 3


def characters(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of each character as one number, and how many characters come before each text."""
    start = np.flatnonzero((data & 0xC0) != 0x80)
    out = data[start].astype(np.uint32)
    more = np.flatnonzero(out > 127)
    for k in (1, 2, 3):
        at = start[more] + k
        inside = at < len(data)
        at, more = at[inside], more[inside]
        own = (data[at] & 0xC0) == 0x80
        at, more = at[own], more[own]
        out[more] |= data[at].astype(np.uint32) << np.uint32(8 * k)
    return out, np.searchsorted(start, offsets)


def cells(c: Counts, data: np.ndarray, offsets: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Of each kind of n-gram: hashed cells, and bounds of the texts in them (starts and ends)."""
    shift = np.uint64(64 - BITS)
    pairs, ptr = grams(c.hashes, c.first, 2)
    wide, first = characters(data, offsets)
    triple = (wide[:-2] * np.uint32(0x9E3779B1) + wide[1:-1] * np.uint32(0x85EBCA77) + wide[2:] * np.uint32(0xC2B2AE3D)) if len(wide) > 2 else np.empty(0, np.uint32)
    triple = (triple ^ (triple >> np.uint32(15))) * np.uint32(0x2C1B3C6D) >> np.uint32(32 - BITS)
    ends = np.maximum(first[1:] - 2, first[:-1])
    return [
        ((c.hashes >> shift).astype(np.int32), np.stack([c.first[:-1], c.first[1:]])),
        ((pairs >> shift).astype(np.int32) + (1 << BITS), np.stack([ptr[:-1], ptr[1:]])),
        (triple.astype(np.int32) + (2 << BITS), np.stack([first[:-1], ends])),
    ]


@dataclass
class Model:
    weights: np.ndarray
    bias: float
    slope: float
    shift: float

    def raw(self, found: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        out = self.bias
        for cell, (a, b) in found:
            sums = np.concatenate([[0.0], np.cumsum(self.weights[cell], dtype=np.float64)])
            b = np.minimum(b, len(cell))
            a = np.minimum(a, b)
            out = out + (sums[b] - sums[a]) / np.maximum(b - a, 1)
        return out

    def probability(self, raw: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * raw + self.shift, -40, 40)))


def fit(rows: list[tuple[int, bool, np.ndarray, np.ndarray]], prior: float, epochs: int = 12, batch: int = 32, rate: float = 4.0) -> Model:
    """rows: label, whether it is for calibration, cells, shares. prior: the share of label 1 among all labels."""
    model = Model(np.zeros(KINDS << BITS), 0.0, 1.0, 0.0)
    train = [r for r in rows if not r[1]]
    rng = np.random.default_rng(7)
    squares, bias_square = np.full(KINDS << BITS, 1e-8), 1e-8
    for _ in range(epochs):
        for own in np.array_split(rng.permutation(len(train)), max(1, len(train) // batch)):
            cell, share = np.concatenate([train[i][2] for i in own]), np.concatenate([train[i][3] for i in own])
            row = np.repeat(np.arange(len(own)), [len(train[i][2]) for i in own])
            raw = np.bincount(row, model.weights[cell] * share, len(own)) + model.bias
            error = 1 / (1 + np.exp(-np.clip(raw, -40, 40))) - np.array([train[i][0] for i in own])
            gradient = np.bincount(cell, error[row] * share, KINDS << BITS) / len(own)
            squares += gradient**2
            bias_square += error.mean() ** 2
            model.weights -= rate * gradient / np.sqrt(squares) * (gradient != 0)
            model.bias -= 0.1 * error.mean() / bias_square**0.5
    held = [r for r in rows if r[1]]
    y = np.array([r[0] for r in held], float)
    raw = np.array([(model.weights[r[2]] * r[3]).sum() for r in held]) + model.bias
    if 0 < y.sum() < len(y):
        weight = np.where(y == 1, prior / y.mean(), (1 - prior) / (1 - y.mean()))
        scale = max(raw.std(), 1e-9)
        x, beta = np.stack([raw / scale, np.ones(len(y))]), np.zeros(2)
        for _ in range(50):  # Newton's method; the penalty keeps it finite where the classes part
            p = 1 / (1 + np.exp(-np.clip(beta @ x, -40, 40)))
            gradient = x @ (weight * (p - y)) + 0.01 * beta
            beta -= np.linalg.solve((x * (weight * p * (1 - p))) @ x.T + 0.01 * np.eye(2), gradient)
        model.slope, model.shift = beta[0] / scale, beta[1]
    return model


def train(docs: DataFrame, labels: DataFrame, sample: int = 1500) -> Model | None:
    prepare(docs.sparkSession)
    known = labels.select(F.col("doc_id").cast("long"), F.col("quality").cast("int")).filter("quality in (0, 1) and doc_id is not null").withColumn("fold", F.expr("crc32(cast(doc_id as string)) % 3"))
    total = dict(map(tuple, known.filter("fold != 1").groupBy("quality").count().collect()))
    if len(total) < 2:
        return None
    chosen = [known.filter(f"fold != 1 and quality = {q}").orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample) for q in (0, 1)]
    chosen = F.broadcast(chosen[0].unionByName(chosen[1]))  # 2 * sample rows at most

    def featurise(batches):
        for batch in batches:
            quality, fold = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            for row, offsets, data in text_slices(batch, "text"):
                found = cells(count(data, offsets), data, offsets)
                out = []
                for i in range(len(offsets) - 1):
                    parts = [np.unique(cell[a[i] : max(a[i], b[i])], return_counts=True) for cell, (a, b) in found]
                    shares = [n / max(n.sum(), 1) for _, n in parts]
                    out.append((np.concatenate([x for x, _ in parts]).astype("<i4").tobytes(), np.concatenate(shares).astype("<f4").tobytes()))
                n = len(out)
                yield pa.RecordBatch.from_arrays([pa.array(quality[row : row + n], pa.int32()), pa.array([x == 2 for x in fold[row : row + n]]), pa.array([a for a, _ in out], pa.binary()), pa.array([b for _, b in out], pa.binary())], ["quality", "held", "cells", "shares"])

    own = docs.select(F.col("doc_id").cast("long"), "text").join(chosen, "doc_id").select("text", "quality", "fold")
    rows = arrow(own, featurise, "quality int, held boolean, cells binary, shares binary").collect()  # as many as the sample
    rows = sorted((r.quality, r.held, bytes(r.cells), bytes(r.shares)) for r in rows)
    if len({r[0] for r in rows if not r[1]}) < 2:
        return None
    return fit([(q, held, np.frombuffer(c, "<i4"), np.frombuffer(s, "<f4")) for q, held, c, s in rows], total[1] / sum(total.values()))


def judge(docs: DataFrame, model: Model | None, least_words: int = 10, most_repeated: int = 20, threshold: float = 0.5) -> DataFrame:
    """doc_id, counts, base_failed, score and kept of every document. score is null without a model."""
    prepare(docs.sparkSession)
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    sent = docs.sparkSession.sparkContext.broadcast(model)  # 2^BITS weights a kind

    def score(batches):
        own = sent.value
        for batch in batches:
            ids = batch.column(0)
            for row, offsets, data in text_slices(batch, "text"):
                c = count(data, offsets)
                n = len(offsets) - 1
                failed = (c.n_words < least_words) | (100 * c.n_repeat_words > most_repeated * c.n_words)
                p = None if own is None else own.probability(own.raw(cells(c, data, offsets)))
                kept = ~failed if p is None else ~failed & (p >= threshold)
                yield pa.RecordBatch.from_arrays([ids.slice(row, n), *[pa.array(getattr(c, k).astype(np.int64)) for k in names], pa.array(failed), pa.nulls(n, pa.float64()) if p is None else pa.array(p), pa.array(kept)], ["doc_id", *names, "base_failed", "score", "kept"])

    return arrow(docs.select(F.col("doc_id").cast("long"), "text"), score, f"doc_id long, {', '.join(f'{k} long' for k in names)}, base_failed boolean, score double, kept boolean")
