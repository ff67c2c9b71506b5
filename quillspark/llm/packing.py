"""Best-fit packing with large-item matching.

Pieces above a third of the capacity fit at most twice in a sequence: they are matched greedily, the largest with the
largest partner that fits. Smaller pieces, largest first, go where they leave the least room. Only the number of
pieces of each length matters to both, so the plan is made from one histogram (as many counts as the capacity, whatever
the input), as patterns of lengths with a count of sequences. Pieces then find their place by their rank among those of
their length: numbered in the task that encodes them, plus a base from the counts of each task, read from a file.

Null and empty texts are one piece, their end id. Null doc_ids are kept. An empty table gives no rows. Ties (pieces of one length) and
repeated rows are told apart by place in the input. Longer documents are cut into full pieces; the first may be shorter; a text of any
length is encoded whole by its task. Columns other than doc_id and text aren't read, whatever their names.
"""

from __future__ import annotations

import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark.llm.common import arrow, prepare, table
from quillspark.llm.tokens import Encoder

GROUP = 256


def pieces(docs: DataFrame, tokenizer: str, end_id: int, capacity: int, drops_space: bool = False, keep_ids: bool = False) -> DataFrame:
    """Pieces of every document with task and seq, its place among the task's pieces of that length. keep_ids: with ids."""
    prepare(docs.sparkSession)
    end = np.array([end_id], "<u4").tobytes()

    def encode(batches):
        from pyspark import TaskContext

        task, encoder, seen = TaskContext.get().partitionId(), None, np.zeros(capacity + 1, np.int64)
        for batch in batches:
            encoder = encoder or Encoder.of(tokenizer, drops_space)
            doc_ids, texts = batch.column(0).to_pylist(), [x or "" for x in batch.column(1).to_pylist()]
            for i in range(0, len(texts), 256):
                rows: list[tuple] = []
                for doc_id, ids in zip(doc_ids[i : i + 256], encoder.encode(texts[i : i + 256]), strict=True):
                    ids += end
                    n = len(ids) // 4
                    edges = [0, *range(n % capacity or capacity, n + 1, capacity)]
                    for k, (a, b) in enumerate(zip(edges, edges[1:], strict=False)):
                        own = ids[4 * a : 4 * b]
                        rows.append((doc_id, k, a, b - a, zlib.crc32(own), task, int(seen[b - a]), np.frombuffer(own, "<i4") if keep_ids else None))
                        seen[b - a] += 1
                yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], t) for j, t in enumerate(types)], names)

    names = ["doc_id", "piece", "start", "length", "ids_crc32", "task", "seq"] + ["ids"] * keep_ids
    types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()] + [pa.list_(pa.int32())] * keep_ids
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, task int, seq long" + ", ids array<int>" * keep_ids
    return arrow(docs.select(F.col("doc_id").cast("long"), "text"), encode, schema, keep=True)


def plan(counts: dict[int, int], capacity: int) -> list[tuple[int, tuple[tuple[int, int], ...]]]:
    """(sequences, ((length, copies), ...)) of each pattern, for so many pieces of each length."""
    left = {k: v for k, v in counts.items() if v > 0}
    rooms: dict[int, list[tuple[int, tuple]]] = {}
    large = sorted((k for k in left if 3 * k > capacity), reverse=True)
    for a in large:
        for b in [x for x in large if x <= a and x <= capacity - a]:
            if not left[a]:
                break
            if n := left[a] // 2 if a == b else min(left[a], left[b]):
                left[a] -= n
                left[b] -= n
                rooms.setdefault(capacity - a - b, []).append((n, ((a, 2),) if a == b else ((a, 1), (b, 1))))
        if left[a]:
            rooms.setdefault(capacity - a, []).append((left[a], ((a, 1),)))
            left[a] = 0
    for s in sorted((k for k in left if 3 * k <= capacity), reverse=True):
        n = left[s]
        while n:
            room = min((r for r in rooms if r >= s), default=None)
            if room is None:
                room, rooms[capacity] = capacity, [((n * s + capacity - 1) // capacity + 1, ())]
            many, pattern = rooms[room].pop()
            fit = room // s
            if n >= fit * many:
                used, copies = many, fit
            elif n >= fit:
                used, copies = n // fit, fit
            else:
                used, copies = 1, n
            n -= used * copies
            if many > used and (pattern or n):  # sequences that nothing is in yet aren't kept
                rooms[room].append((many - used, pattern))
            if not rooms[room]:
                del rooms[room]
            rooms.setdefault(room - copies * s, []).append((used, (*pattern, (s, copies))))
    return [x for room in sorted(rooms) for x in rooms[room] if x[1]]


def places(patterns: list[tuple[int, tuple[tuple[int, int], ...]]]) -> dict[int, np.ndarray]:
    """For each length, rows of: first rank, copies, first sequence, offset; in order of rank."""
    out: dict[int, list[tuple[int, int, int, int]]] = {}
    ranks: dict[int, int] = {}
    sequence = 0
    for many, pattern in patterns:
        offset = 0
        for length, copies in pattern:
            first = ranks.get(length, 0)
            out.setdefault(length, []).append((first, copies, sequence, offset))
            ranks[length], offset = first + many * copies, offset + length * copies
        sequence += many
    return {k: np.array(v, np.int64) for k, v in out.items()}


def bases(counts: DataFrame, folder: str, capacity: int) -> None:
    """Writes how many pieces of each length the tasks before a task have: a row of longs each, GROUP tasks a file.

    A task that places pieces then reads the rows of the tasks whose pieces it has; nothing grows with the number of tasks there.
    """
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select(F.expr(f"task div {GROUP}").cast("int").alias("file"), "task", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))

    def write(batches):
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            file, task, length, base = (c.to_numpy() for c in batch.columns)
            for f in np.unique(file).tolist():
                own = held.setdefault(f, np.zeros((GROUP, capacity + 1), np.int64))
                rows = file == f
                own[task[rows] % GROUP, length[rows]] = base[rows]
        for f, own in held.items():
            filesystem, root = fs.FileSystem.from_uri(folder)
            new = f"{root}/.{uuid.uuid4().hex}"
            with filesystem.open_output_stream(new) as out:
                out.write(own.tobytes())
            filesystem.move(new, f"{root}/bases-{f:06d}")
        yield pa.RecordBatch.from_arrays([pa.array([len(held)], pa.int64())], ["files"])

    arrow(base.repartition("file"), write, "files long").agg(F.sum("files")).collect()


def base_of(folder: str, task: int, capacity: int) -> np.ndarray:
    filesystem, root = fs.FileSystem.from_uri(folder)
    size = 8 * (capacity + 1)
    with filesystem.open_input_file(f"{root}/bases-{task // GROUP:06d}") as source:
        return np.frombuffer(source.read_at(size, task % GROUP * size), np.int64)


def pack(found: DataFrame, folder: str, capacity: int) -> DataFrame:
    """Adds sequence_id and offset to pieces()."""
    found = table(found, f"{folder}/pieces")
    counts = table(found.groupBy("length", "task").agg(F.count("*").alias("n")), f"{folder}/counts")
    total = {r[0]: r[1] for r in counts.groupBy("length").agg(F.sum("n")).collect()}  # as many rows as the capacity, at most
    where = places(plan(total, capacity))
    bases(counts, folder, capacity)
    fields = [f for f in found.schema.fields if f.name not in ("task", "seq")]

    def place(batches):
        known: dict[int, np.ndarray] = {}
        for batch in batches:
            lengths, tasks, seq = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("length", "task", "seq"))
            ranks = seq.copy()
            for task in np.unique(tasks).tolist():
                if task not in known:
                    known = {task: base_of(folder, task, capacity), **dict(list(known.items())[:7])}
                ranks[tasks == task] += known[task][lengths[tasks == task]]
            sequence, offset = np.empty(len(ranks), np.int64), np.empty(len(ranks), np.int64)
            for length in np.unique(lengths):
                rows, slots = np.flatnonzero(lengths == length), where[int(length)]
                slot = slots[np.searchsorted(slots[:, 0], ranks[rows], "right") - 1]
                past = ranks[rows] - slot[:, 0]
                sequence[rows], offset[rows] = slot[:, 2] + past // slot[:, 1], slot[:, 3] + past % slot[:, 1] * length
            names = [f.name for f in fields]
            yield pa.RecordBatch.from_arrays([*[batch.column(batch.schema.get_field_index(c)) for c in names], pa.array(sequence), pa.array(offset)], [*names, "sequence_id", "offset"])

    return arrow(found, place, T.StructType([*fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())]))
