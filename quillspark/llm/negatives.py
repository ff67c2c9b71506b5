"""Hard-negative mining: exact search by inner product in norm-bucketed files.

Candidates are sorted by norm and written as files of buckets, the longest first. Anchors are cut into blocks, which also are
files. A task takes some pairs of a block and a file: a bucket is left out for an anchor if the product of its norm and the bucket's
largest (Cauchy and Schwarz) stays under what the anchor still looks for, the larger of its windows' least lower limit and least running k-th score.
The file of the longest candidates comes first, so that the pairs that follow start with a k-th score, and most are never made where norms
differ. A search runs twice: for positives without limits, then for negatives in the window of each positive.

Rows with a null label, a null vector or any null or non-finite component take no part, nor do those whose scaled norm is 2**31 or
more (their scores aren't longs). Shorter vectors, empty ones too, count as if zeros followed. Null ids are no anchors and come last at ties; rows that
repeat are rows of their own, and so are anchors that repeat. Extra columns are not looked at. Tables without anchors give no rows.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspark.llm.common import arrow, buckets, prepare, table
from quillspark.llm.store import LAST, load, save

BUCKET, FILE, BLOCK = 2048, 8192, 64
LOW, HIGH = -(2**62), 2**62
WANTS = "array<struct<number: int, low: long, high: long>>"


def scaled(rows: DataFrame, scale: float) -> DataFrame:
    """id, label, norm and vec (little-endian 32-bit integers) of the rows (id, label, vector) that take part."""

    def each(batches):
        for batch in batches:
            vectors, out = batch.column(2), []
            flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)  # nulls: NaN
            length = np.array([-1 if x is None else x for x in pc.list_value_length(vectors).to_pylist()], np.int64)
            at = np.concatenate([[0], np.cumsum(np.maximum(length, 0))])
            with np.errstate(over="ignore", invalid="ignore"):
                whole = np.floor(flat * scale)
            for i in np.flatnonzero((length >= 0) & ~batch.column(1).is_null().to_numpy(zero_copy_only=False)):
                own = whole[at[i] : at[i + 1]]
                norm = float(np.sqrt((own * own).sum()))
                if norm < 2**31:  # false for NaN and infinity
                    out.append((int(i), norm, own.astype("<i4").tobytes()))
            chosen = pa.array([i for i, _, _ in out], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(chosen), batch.column(1).take(chosen), pa.array([n for _, n, _ in out], pa.float64()), pa.array([v for _, _, v in out], pa.binary())], ["id", "label", "norm", "vec"])

    return arrow(rows.select(F.col("id").cast("long"), F.col("label").cast("long"), "vector"), each, "id long, label long, norm double, vec binary")


def filed(rows: DataFrame, folder: str, most: int) -> DataFrame:
    """Files of up to ``most`` rows (row, id, label, norm, vec, wants) in descending order of norms: file, top (the largest norm), least (the lowest score wanted)."""

    filesystem, path = fs.FileSystem.from_uri(folder)
    filesystem.create_dir(path, recursive=True)

    def write(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        own = pa.concat_batches(held)
        vecs = [np.frombuffer(x, "<i4") for x in own.column(4).to_pylist()]
        matrix = np.zeros((len(vecs), max(1, *map(len, vecs))), np.int32)
        for x, v in zip(matrix, vecs, strict=True):
            x[: len(v)] = v
        wants = [(i, w["number"], w["low"], w["high"]) for i, x in enumerate(own.column(5).to_pylist()) for w in x or ()]
        name = f"{folder}/{uuid.uuid4().hex}"  # a task that is retried writes under other names, and those that counted are returned
        save(name, [own.column(0).to_numpy(), own.column(1).fill_null(LAST).to_numpy(), own.column(1).is_null().to_numpy(zero_copy_only=False), own.column(2).to_numpy(), own.column(3).to_numpy(), matrix.ravel(), *np.array(wants, np.int64).reshape(-1, 4).T])
        return pa.RecordBatch.from_pydict({"file": [name], "top": [own.column(3)[0].as_py()], "least": pa.array([min((w[2] for w in wants), default=HIGH)], pa.int64())})

    def each(batches):
        held, n = [], 0
        for batch in batches:
            while len(batch):
                own = batch.slice(0, most - n)
                held.append(own)
                n, batch = n + len(own), batch.slice(len(own))
                if n == most:
                    yield write(held)
                    held, n = [], 0
        if n:
            yield write(held)

    order = [F.col("norm").desc(), F.col("row")]
    ranged = rows.select("row", "id", "label", "norm", "vec", "wants").repartitionByRange(*order).sortWithinPartitions(*order)
    return table(arrow(ranged, each, "file string, top double, least long"), f"{folder}-names")


class Rows:
    """What a file has: row, id (null: LAST), label, norm and vec of each, and wanted: the row, number, low and high of each window."""

    def __init__(self, file: str):
        self.row, self.id, self.null, self.label, self.norm, flat, *self.wanted = load(file)
        self.vec = flat.reshape(len(self.row), -1)

    def scores(self, which: np.ndarray, other: Rows, a: int, b: int) -> np.ndarray:
        wide = max(self.vec.shape[1], other.vec.shape[1])
        # Sums of products stay under the product of norms: exact as floats below 2**53.
        kind = np.float64 if self.norm[which].max() * other.norm[a:b].max() < 2**53 else np.int64
        pad = lambda x: np.pad(x.astype(kind), ((0, 0), (0, wide - x.shape[1])))
        return (pad(self.vec[which]) @ pad(other.vec[a:b]).T).astype(np.int64)


class Search:
    """The windows of a block of anchors: each takes its ``most`` best with scores from low to high, among rows of the anchor's label or of others."""

    def __init__(self, block: Rows, same: bool, most: int):
        self.block, self.same, self.most = block, same, most
        self.anchor, self.number, low, self.high = block.wanted
        self.first = np.searchsorted(self.anchor, np.arange(len(block.row) + 1))
        self.need = low.copy()  # the running k-th score, once there are k
        self.held = [np.empty((0, 3), np.int64) for _ in self.anchor]  # score, id, whether null; best first

    def scan(self, other: Rows) -> None:
        for a in range(0, len(other.row), BUCKET):
            b = min(a + BUCKET, len(other.row))
            least = np.array([self.need[x:y].min() if y > x else HIGH for x, y in zip(self.first, self.first[1:], strict=False)])
            wanted = np.flatnonzero(self.block.norm * other.norm[a] * (1 + 1e-9) + 1 >= least)
            if not len(wanted):
                continue
            got = self.block.scores(wanted, other, a, b)
            for i, score in zip(wanted, got, strict=True):
                own = (other.label[a:b] == self.block.label[i]) == self.same
                own &= (score >= least[i]) & (score <= self.high[self.first[i] : self.first[i + 1]].max())
                if self.same:
                    own &= other.row[a:b] != self.block.row[i]
                at = np.flatnonzero(own)
                if not len(at):
                    continue
                rows = np.stack([score[at], other.id[a:b][at], other.null[a:b][at]], axis=1)
                rows = rows[np.lexsort((rows[:, 2], rows[:, 1], -rows[:, 0]))]
                down = -rows[:, 0]
                for q in range(self.first[i], self.first[i + 1]):
                    x, y = np.searchsorted(down, -self.high[q]), np.searchsorted(down, -self.need[q], "right")
                    if y > x:
                        both = np.concatenate([self.held[q], rows[x : min(y, x + self.most)]])
                        both = both[np.lexsort((both[:, 2], both[:, 1], -both[:, 0]))][: self.most]
                        self.held[q] = both
                        if len(both) == self.most:
                            self.need[q] = max(self.need[q], both[-1, 0])

    def found(self) -> pa.RecordBatch:
        n = [len(x) for x in self.held]
        rows = np.concatenate([np.empty((0, 3), np.int64), *self.held])
        at = np.repeat(self.anchor, n)
        return pa.RecordBatch.from_arrays(
            [pa.array(self.block.row[at]), pa.array(self.block.id[at]), pa.array(np.repeat(self.number, n).astype(np.int32)), pa.array(rows[:, 1], mask=rows[:, 2] == 1), pa.array(rows[:, 0])],
            ["anchor", "anchor_id", "number", "id", "score"],
        )


FOUND = "anchor long, anchor_id long, number int, id long, score long"


def search(anchors: DataFrame, wants: DataFrame, files: DataFrame, folder: str, same: bool, most: int) -> DataFrame:
    """anchor, anchor_id, number, rank, id and score of the ``most`` best of each window. wants: row (of the anchor), number, low, high; files: those of all rows."""

    spark = anchors.sparkSession

    def each(batches):
        done, own = None, None
        for batch in batches:
            for block, file in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if block != done:
                    if own:
                        yield own.found()
                    done, own = block, Search(Rows(block), same, most)
                own.scan(Rows(file))
        if own:
            yield own.found()

    def run(windows: DataFrame, candidates: DataFrame, name: str) -> DataFrame:
        grouped = windows.groupBy("row").agg(F.collect_list(F.struct("number", "low", "high")).alias("wants"))  # a few an anchor
        blocks = filed(anchors.join(grouped, "row"), f"{folder}/{name}-blocks", BLOCK)
        blocks = blocks.select(F.col("file").alias("block"), F.col("top").alias("block_top"), F.col("least").alias("wanted"))
        # The stated queries against all rows, a pair a block and file, unless norms forbid it.
        pairs = blocks.join(candidates.drop("least"), F.col("block_top") * F.col("top") * (1 + 1e-9) + 1 >= F.col("wanted"))
        dealt = pairs.withColumn("part", F.pmod(F.xxhash64("file"), F.lit(parts))).repartition(max(buckets(spark), parts), "block", "part").sortWithinPartitions("block", F.col("top").desc(), "file")
        return table(arrow(dealt.select("block", "file"), each, FOUND), f"{folder}/{name}")

    number, longest = files.agg(F.count("*"), F.max_by("file", F.struct("top", "file"))).first()
    parts = max(1, number // 8)  # about eight files of a block in a task; pairs are few bytes and much work, so their number of tasks is given
    first = run(wants, files.filter(F.col("file") == longest), "first")
    kth = first.groupBy(F.col("anchor").alias("row"), "number").agg(F.count("*").alias("n"), F.min("score").alias("kth")).filter(F.col("n") >= most)
    raised = wants.join(kth, ["row", "number"], "left").withColumn("low", F.greatest("low", F.coalesce("kth", "low")))
    both = first.unionByName(run(raised, files.filter(F.col("file") != longest), "others"))
    ranked = Window.partitionBy("anchor", "number").orderBy(F.col("score").desc(), F.col("id").asc_nulls_last())
    return table(both.withColumn("rank", F.row_number().over(ranked)).filter(F.col("rank") <= most), f"{folder}/best")


def mine(rows: DataFrame, every: int, folder: str, scale: float = 256.0, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score and negative_score of rows (id, label, vector).

    Components become floor(scale * x). Anchors are rows whose id is divisible by ``every``, positives the best of their label, negatives
    the best of other labels with ``low`` to ``high`` percent of the positive's score. Ties go to smaller ids.
    """
    spark = rows.sparkSession
    prepare(spark)
    own = table(scaled(rows, scale).withColumn("row", F.monotonically_increasing_id()), f"{folder}/rows")
    none = F.lit(None).cast(WANTS)
    files = filed(own.withColumn("wants", none), f"{folder}/files", FILE)
    anchors = own.filter(F.col("id") % every == 0)
    wants = anchors.select("row", F.lit(0).alias("number"), F.lit(LOW).cast("long").alias("low"), F.lit(HIGH).cast("long").alias("high"))
    good = search(anchors, wants, files, f"{folder}/positives", True, positives).select("anchor", F.col("rank").alias("number"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    percent = lambda x, to: to(F.col("positive_score").cast("decimal(20,0)") * x / 100).cast("long")  # noqa: E731  exact
    windows = good.select(F.col("anchor").alias("row"), "number", percent(low, F.ceil).alias("low"), percent(high, F.floor).alias("high")).filter("low <= high")
    bad = search(anchors, windows, files, f"{folder}/negatives", False, negatives)
    return bad.join(good, ["anchor", "number"]).select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
