"""Quality classifier: random Fourier features of document statistics, ridge scores, isotonic calibration.

Statistics of every whole text are written once. Labelled rows of one fold (crc32(doc_id as text) mod 3 is 0) give normal
equations: each task sums its own, Spark sums their cells, and the driver solves as many equations as features. The
scores of the fold of remainder 2 are counted in bins and pooled into a non-decreasing curve, read by linear interpolation.
Remainder 1 is held out. All labelled rows of their folds are used.

Null and empty texts have statistics of zeros and are scored alike. Null doc_ids are scored and not held out. Without labels
of both classes every score is the share of label 1, or 0.5 without any. Null labels are left out; repeated rows count
again. A text of any length is measured whole by its task. An empty table gives no rows. Columns other than doc_id and text aren't
read; keep_good returns them as they are, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark.llm.common import arrow, per_text, prepare, table, text_slices, unused
from quillspark.llm.textstats import DIGIT, LOWER, UPPER, count, of_text, repeats

FEATURES, SEED, BINS = 256, 11, 2000
MARKS = [list(x) for x in (b"!", b"?", b".", b",", b"|", b"#*$%&<>", b"\n")]


def statistics(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A row of numbers for each text."""
    c = count(data, offsets)
    size, n = np.maximum(np.diff(offsets), 1), np.maximum(c.n_words, 1)
    share = lambda flags, ptr, of: np.sqrt(per_text(flags, ptr) / of)
    later, _ = repeats(c.hashes ^ of_text(c.first))
    beside = np.zeros(len(c.hashes), bool)
    beside[1:] = c.hashes[1:] == c.hashes[:-1]
    beside[c.first[:-1][np.diff(c.first) > 0]] = False
    length = (c.ends - c.starts).astype(float)
    mean = per_text(length, c.first) / n
    columns = [share(t[data], offsets, size) for t in (UPPER, LOWER, DIGIT, np.arange(256) > 127)]
    for mark in MARKS:
        flag = np.zeros(256, bool)
        flag[mark] = True
        columns.append(share(flag[data], offsets, size))
    columns += [
        share(later, c.first, n), share(beside, c.first, n), share(UPPER[data[c.starts]], c.first, n), share(UPPER[data[c.ends - 1]], c.first, n),
        np.log1p(c.n_words), mean, np.sqrt(np.maximum(per_text(length**2, c.first) / n - mean**2, 0)),
        np.sqrt(c.n_repeat_words / n), np.sqrt(c.n_dup_lines / np.maximum(c.n_lines, 1)), np.log1p(n / np.maximum(c.n_lines, 1)),
    ]
    return np.stack(columns, 1)


WIDTH = 4 + len(MARKS) + 10


def listed(x: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * WIDTH), pa.array(x.ravel()))


def featurise(docs: DataFrame) -> DataFrame:
    prepare(docs.sparkSession)

    def run(batches):
        for batch in batches:
            for row, offsets, data in text_slices(batch, "text"):
                x = statistics(data, offsets)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(row, len(x)), listed(x)], ["doc_id", "x"])

    return arrow(docs.select(F.col("doc_id").cast("long"), "text"), run, "doc_id long, x array<double>")


class Model:
    def __init__(self, mean: np.ndarray, deviation: np.ndarray):
        rng = np.random.default_rng(SEED)
        self.mean, self.deviation = mean, np.where(deviation > 1e-9, deviation, 1.0)
        self.frequencies = rng.standard_normal((WIDTH, FEATURES)) / np.sqrt(WIDTH)  # a kernel as wide as the mean distance of rows
        self.phases = rng.uniform(0, 2 * np.pi, FEATURES)
        self.weights, self.x, self.y = np.zeros(FEATURES + 1), np.array([0.0]), np.array([0.5])

    def lift(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.deviation, -6, 6)
        return np.hstack([np.sqrt(2 / FEATURES) * np.cos(z @ self.frequencies + self.phases), np.ones((len(x), 1))])

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.lift(x) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(self.raw(x), self.x, self.y), 0, 1)


def pool(x: np.ndarray, total: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: places and heights of the blocks of the non-decreasing fit."""
    blocks: list[list[float]] = []
    for place, s, k in zip(x, total, n, strict=True):
        blocks.append([place * k, s, k])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][2] >= blocks[-1][1] * blocks[-2][2]:
            last = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], last, strict=True)]
    b = np.array(blocks)
    return b[:, 0] / b[:, 2], b[:, 1] / b[:, 2]


def matrix(batch: pa.RecordBatch) -> np.ndarray:
    values = batch.column(batch.schema.get_field_index("x"))
    return np.asarray(values.flatten()).reshape(-1, WIDTH)


def train(features: DataFrame, labels: DataFrame, folder: str, ridge: float = 1e-2) -> Model:
    known = labels.select(F.col("doc_id").cast("long"), F.col("quality").cast("int").alias("y")).filter("y in (0, 1)").withColumn("fold", F.expr("crc32(cast(doc_id as string)) % 3")).filter("fold != 1")
    rows = table(features.join(known, "doc_id").select("x", "y", "fold"), f"{folder}/labelled")
    sums = rows.filter("fold = 0").agg(F.count("*"), F.sum("y"), *[f(F.col("x")[i]) for f in (F.avg, F.stddev_pop) for i in range(WIDTH)]).first()
    model = Model(np.zeros(WIDTH), np.ones(WIDTH))
    if not sums[0] or sums[1] in (0, sums[0]):
        n, ones = rows.agg(F.count("*"), F.sum("y")).first()
        model.y = np.array([ones / n if n else 0.5])
        return model
    model = Model(np.array(sums[2 : 2 + WIDTH]), np.array(sums[2 + WIDTH :]))
    size = FEATURES + 1
    upper = np.triu_indices(size)

    def equations(batches):
        a, b = np.zeros((size, size)), np.zeros(size)
        for batch in batches:
            z = model.lift(matrix(batch))
            a += z.T @ z
            b += z.T @ batch.column(1).to_numpy().astype(float)
        values = np.concatenate([a[upper], b])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(values), dtype=np.int32)), pa.array(values)], ["cell", "value"])

    summed = arrow(rows.filter("fold = 0").select("x", "y"), equations, "cell int, value double").groupBy("cell").agg(F.sum("value").alias("value")).collect()  # cells of the equations
    values = np.zeros(len(upper[0]) + size)
    values[[r[0] for r in summed]] = [r[1] for r in summed]
    a = np.zeros((size, size))
    a[upper] = values[: len(upper[0])]
    a = a + a.T - np.diag(np.diag(a))
    model.weights = np.linalg.solve(a + ridge * np.eye(size), values[len(upper[0]) :])

    def bins(batches):
        for batch in batches:
            place = np.clip((model.raw(matrix(batch)) + 0.5) / 2 * BINS, 0, BINS - 1).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(place), batch.column(1)], ["bin", "y"])

    found = sorted(map(tuple, arrow(rows.filter("fold = 2").select("x", "y"), bins, "bin int, y int").groupBy("bin").agg(F.sum("y"), F.count("*")).collect()))  # BINS rows at most
    if found:
        at, ones, n = (np.array(x, float) for x in zip(*found, strict=True))
        model.x, model.y = pool((at + 0.5) / BINS * 2 - 0.5, ones, n)
    else:
        model.x, model.y = np.array([0.0, 1.0]), np.array([0.0, 1.0])
    return model


def classify(docs: DataFrame, labels: DataFrame, folder: str) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    features = table(featurise(docs), f"{folder}/features")
    model = train(features, labels, folder)

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.score(matrix(batch)))], ["doc_id", "score"])

    scored = arrow(features, run, "doc_id long, score double")
    held = F.coalesce(F.expr("crc32(cast(doc_id as string)) % 3 = 1"), F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, folder: str) -> DataFrame:
    """The rows of docs with a score of 0.5 or more. Rows are written with their statistics, which are taken once."""
    prepare(docs.sparkSession)
    name = unused(docs, "x")
    schema = T.StructType([*docs.schema.fields, T.StructField(name, T.ArrayType(T.DoubleType()))])

    def measure(batches):
        for batch in batches:
            for row, offsets, data in text_slices(batch, "text"):
                yield pa.RecordBatch.from_arrays([*batch.slice(row, len(offsets) - 1).columns, listed(statistics(data, offsets))], [*batch.schema.names, name])

    whole = table(arrow(docs, measure, schema), f"{folder}/measured")
    model = train(whole.select(F.col("doc_id").cast("long"), F.col(name).alias("x")), labels, folder)

    def good(batches):
        for batch in batches:
            x = np.asarray(batch.column(batch.schema.get_field_index(name)).flatten()).reshape(-1, WIDTH)
            yield batch.filter(pa.array(model.score(x) >= 0.5)).drop_columns([name])

    return arrow(whole, good, docs.schema)
