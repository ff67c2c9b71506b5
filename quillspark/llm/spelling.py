"""Spelling variants: words that one inserted, deleted or replaced letter parts, and the commoner form of each.

Words are counted where texts are read: a task sends each word once in a while with its count, however common it is. The inverted
index of positional bigrams is dealt out by nodes: words of length ``size`` that share all before ``low`` and all from ``high`` on. A
word is posted to the nodes of its own length, and looked up there and in those of words one letter longer. One edit leaves the
first or the second half alone, so both halves of a word are nodes; a node of more than ``most`` words is halved again, down to
one free letter, where the alphabet bounds it. Nothing is dropped, and no task holds more than a few nodes. In a node, the sorted
postings of a word's bigrams, in their place or one further, are merged, and words with enough of them in common are compared in full.

Null texts have no words, null doc_ids count as empty when a letter's deletion is drawn; repeated rows count each. Extra columns are
not looked at. Tables without words give no rows.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import Substrings, arrow, prepare, remove, table, text_slices

SHORT = 64  # bytes of runs whose checksums are combined from tables
HELD = 300_000  # words whose counts a task holds
CHUNK = 16_384  # rows of whole nodes that are merged at once
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
LETTER = np.zeros(256, bool)
LETTER[97:123] = True


def _shifts() -> np.ndarray:
    """[n, k, v]: what the k-th byte v of a checksum becomes when n bytes follow."""
    crc = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        crc = np.where(crc & 1, (crc >> 1) ^ np.uint32(0xEDB88320), crc >> 1).astype(np.uint32)
    out = np.empty((SHORT + 1, 4, 256), np.uint32)
    out[0] = np.arange(256, dtype=np.uint32) << (8 * np.arange(4, dtype=np.uint32)[:, None])
    for n in range(SHORT):
        out[n + 1] = (out[n] >> 8) ^ crc[out[n] & 255]
    return out


SHIFTS = _shifts()


def runs(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of a-z and U+00C0 to U+00FF in lower-cased UTF-8, none across texts."""
    inside = LETTER[data]
    lead = np.flatnonzero(data[:-1] == 0xC3)
    lead = lead[(data[lead + 1] & 0xC0) == 0x80]
    inside[lead] = inside[lead + 1] = True
    border = np.zeros(len(data) + 1, bool)
    border[offsets] = True
    starts = np.flatnonzero(inside & (np.append(True, ~inside[:-1])[: len(data)] | border[:-1]))
    ends = np.flatnonzero(inside & (np.append(~inside[1:], True)[: len(data)] | border[1:])) + 1
    return starts, ends


def tally(data: np.ndarray, offsets: np.ndarray, seeds: np.ndarray, one_in: int, counts: dict[str, int]) -> None:
    """Adds the words of these texts to counts. seeds: each text's checksum of doc_id and colon."""
    data = LOWER[data]
    starts, ends = runs(data, offsets)
    if not len(starts):
        return
    size = ends - starts
    hashed = Substrings(data)(starts, ends) ^ size.astype(np.uint64)
    _, first, which, times = np.unique(hashed, return_index=True, return_inverse=True, return_counts=True)
    raw, each = data.tobytes(), list(zip(starts[first].tolist(), ends[first].tolist(), strict=True))
    crc = np.array([zlib.crc32(raw[a:b]) for a, b in each], np.uint32)
    words = [raw[a:b].decode() for a, b in each]
    length = np.array([len(w) for w in words], np.uint32)
    seed = seeds[np.searchsorted(offsets, starts, "right") - 1]
    n = np.minimum(size, SHORT)
    h = crc[which]
    for k in range(4):
        h = h ^ SHIFTS[n, k, (seed >> np.uint32(8 * k)) & np.uint32(255)]
    for i in np.flatnonzero(size > SHORT):
        h[i] = zlib.crc32(raw[starts[i] : ends[i]], int(seed[i]))
    if one_in:
        hit = np.flatnonzero(h % np.uint32(one_in) == 0)
        times = times - np.bincount(which[hit], minlength=len(words))
        place = h[hit] % length[which[hit]]
        changed, again = np.unique(np.stack([which[hit], place.astype(np.int64)]), axis=1, return_counts=True)
        for i, at, m in zip(*changed.tolist(), again.tolist(), strict=True):
            word = words[i][:at] + words[i][at + 1 :]
            counts[word] = counts.get(word, 0) + m
    for word, m in zip(words, times.tolist(), strict=True):
        if m:
            counts[word] = counts.get(word, 0) + m


def vocabulary(docs: DataFrame, least_letters: int = 5, least_times: int = 3, one_in: int = 97, held: int = HELD) -> DataFrame:
    """word and n. one_in: of so many pairs of doc_id and word, one loses the letter that crc32 of ``<doc_id>:<word>`` names; 0: none."""
    prepare(docs.sparkSession)

    def flush(counts: dict[str, int]) -> pa.RecordBatch:
        own = [w for w in counts if len(w) >= least_letters]
        out = pa.RecordBatch.from_pydict({"word": pa.array(own, pa.string()), "n": pa.array([counts[w] for w in own], pa.int64())})
        counts.clear()
        return out

    def each(batches):
        counts: dict[str, int] = {}
        for batch in batches:
            seeds = np.array([zlib.crc32(f"{'' if x is None else x}:".encode()) for x in batch.column(0).to_pylist()], np.uint32)
            for row, offsets, data in text_slices(batch, "text"):
                tally(data, offsets, seeds[row : row + len(offsets) - 1], one_in, counts)
                if len(counts) > held:
                    yield flush(counts)
        yield flush(counts)

    found = arrow(docs.select("doc_id", "text"), each, "word string, n long")
    return found.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least_times)


def entries(words: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """Rows (size, low, high, key, probe, word, n): the two halves of each word's own length, and of words one letter longer."""
    if nodes is None:
        nodes = words.withColumn("letters", F.length("word")).select("word", "n", "letters", F.explode(F.array(*[F.struct((F.col("letters") + more).alias("size"), F.lit(probe).alias("probe")) for more, probe in ((0, False), (0, True), (1, True))])).alias("x"))
        nodes = nodes.select("word", "n", "letters", "x.size", "x.probe", F.lit(0).alias("low"), F.col("x.size").alias("high"))
    else:
        nodes = nodes.withColumn("letters", F.length("word"))
    middle = F.col("low") + F.floor((F.col("high") - F.col("low")) / 2).cast("int")
    halves = nodes.select("word", "n", "letters", "size", "probe", F.explode(F.array(F.struct(middle.alias("low"), "high"), F.struct("low", middle.alias("high")))).alias("y"))
    halves = halves.select("word", "n", "letters", "size", "probe", "y.low", "y.high")
    after = F.col("size") - F.col("high")  # letters of the common end
    key = F.xxhash64("size", "low", "high", F.expr("substring(word, 1, low)"), F.substring("word", F.col("letters") - after + 1, after))
    return halves.select("size", "low", "high", key.alias("key"), "probe", "word", "n")


def letters(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A row of letters for each word, zeros after it, and the lengths."""
    raw = [w.encode("latin-1") for w in words.to_pylist()]
    size = np.array([len(w) for w in raw], np.int64)
    width = int(size.max(initial=0)) + 1
    return np.frombuffer(b"".join(w.ljust(width, b"\0") for w in raw), np.uint8).reshape(len(raw), width), size


def near(own: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Rows (probe, posted) of words that one edit parts, in whole nodes sorted by size, low, high and key. Words of one length come both ways."""
    size, low, high = (own.column(i).to_numpy().astype(np.int64) for i in range(3))
    key, probe = own.column(3).to_numpy(), own.column(4).to_numpy(zero_copy_only=False)
    text, length = letters(own.column(5))
    node = np.cumsum(np.append(0, (key[1:] != key[:-1]) | (size[1:] != size[:-1]) | (low[1:] != low[:-1]) | (high[1:] != high[:-1])))
    n_probes = np.bincount(node, probe)
    useful = (n_probes > 0) & (np.bincount(node, ~probe) > 0) & (np.bincount(node) > 2)  # two rows: a word meets itself
    rows = np.flatnonzero(useful[node])
    end = length - (size - high)  # of the free letters
    free = np.maximum(end - low, 0)[rows]
    # Bigrams of the free letters with a blank before and after them: free + 1 in each word.
    gram_row = np.repeat(rows, free + 1)
    place = np.arange(len(gram_row)) - np.repeat(np.cumsum(free + 1) - (free + 1), free + 1)
    at = low[gram_row] + place
    first = np.where(place > 0, text[gram_row, np.maximum(at - 1, 0)], 0).astype(np.uint64)
    second = np.where(at < end[gram_row], text[gram_row, np.minimum(at, text.shape[1] - 1)], 0).astype(np.uint64)
    alone = (high - low)[gram_row] == 1  # all words of such a node are one edit apart: they share one gram
    gram, place = np.where(alone, np.uint64(0xFFFF), (first << np.uint64(8)) | second), np.where(alone, 0, place).astype(np.uint64)
    own_node = node[gram_row].astype(np.uint64)
    code = lambda more: (own_node << np.uint64(36)) | ((place + np.uint64(more)) << np.uint64(16)) | gram
    posted = ~probe[gram_row]
    order = np.argsort(code(0)[posted], kind="stable")
    keys, members = code(0)[posted][order], gram_row[posted][order]
    hits = []
    asked, longer = ~posted, (length < size)[gram_row]
    for more, who in ((0, asked), (1, asked & longer)):
        wanted, from_ = code(more)[who], gram_row[who]
        a, b = np.searchsorted(keys, wanted), np.searchsorted(keys, wanted, "right")
        count = b - a
        places = np.repeat(a - (np.cumsum(count) - count), count) + np.arange(count.sum())
        hits.append(np.repeat(from_, count) * len(size) + members[places])
    merged = np.sort(np.concatenate(hits), kind="stable")  # postings are sorted runs, which are merged
    edge = np.flatnonzero(np.append(True, merged[1:] != merged[:-1])) if len(merged) else np.empty(0, np.int64)
    common = np.diff(np.append(edge, len(merged)))
    p, q = np.divmod(merged[edge], max(len(size), 1))
    enough = common >= (high - low)[q] - 1  # of high - low + 1 bigrams, one edit spoils two
    p, q = p[enough], q[enough]
    found = [(p[:0], q[:0])]
    step = max(1, (8 << 20) // text.shape[1])
    for i in range(0, len(p), step):
        x, y = p[i : i + step], q[i : i + step]
        differ = text[x] != text[y]
        before = differ.argmax(axis=1)  # letters alike from the start
        shift = (length[y] - length[x])[:, None]
        column = np.arange(text.shape[1])[None, :]
        moved = np.take_along_axis(text[x], np.maximum(column - shift, 0), axis=1)
        fine = ((text[y] == moved) | (column <= before[:, None])).all(axis=1)
        fine &= differ.any(axis=1) & (low[y] <= before) & (before < high[y])  # else another node has the pair
        found.append((x[fine], y[fine]))
    return np.concatenate([x for x, _ in found]), np.concatenate([y for _, y in found])


def whole_nodes(batches, rows: int = CHUNK, most_bytes: int = 32 << 20):
    """Batches of whole nodes, of about so many rows and of words that padded to one length have about so many bytes."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not len(batch):
            continue
        held.append(batch)
        longest = max(int(x.column(0)[len(x) - 1].as_py()) for x in held)  # sorted by size
        n = sum(map(len, held))
        if n >= rows or n * longest >= most_bytes:
            own = pa.concat_batches(held)
            ids = [own.column(i).to_numpy() for i in range(4)]
            edge = np.flatnonzero(np.any([x[1:] != x[:-1] for x in ids], axis=0)) + 1
            if len(edge):
                yield own.slice(0, int(edge[-1]))
                own = own.slice(int(edge[-1]))
            held = [own]
    if held:
        yield pa.concat_batches(held)


def links(nodes: DataFrame) -> DataFrame:
    """Rows (word, other, other_n), both ways, of the words in these nodes that one edit parts."""

    def each(batches):
        for own in whole_nodes(batches):
            p, q = near(own)
            longer = own.column(0).to_numpy()[q] > pc.utf8_length(own.column(5)).to_numpy()[p]
            for a, b in ((p, q), (q[longer], p[longer])):
                yield pa.RecordBatch.from_arrays([own.column(5).take(pa.array(a)), own.column(5).take(pa.array(b)), own.column(6).take(pa.array(b))], ["word", "other", "other_n"])

    dealt = nodes.repartition("size", "low", "high", "key").sortWithinPartitions("size", "low", "high", "key")
    return arrow(dealt.select("size", "low", "high", "key", "probe", "word", "n"), each, "word string, other string, other_n long")


def all_links(words: DataFrame, folder: str, most: int = 512, salts: int = 32) -> DataFrame:
    """links() of all words (word, n). Nodes of more than ``most`` rows are halved until none is left that can be."""
    spark, node = words.sparkSession, ["size", "low", "high", "key"]
    level, number, out = table(entries(words), f"{folder}/nodes-0"), 0, []
    while True:
        large = level.groupBy(*node).count().filter((F.col("count") > most) & (F.col("high") - F.col("low") > 1)).select(*node)
        large = table(large, f"{folder}/large-{number}")
        if large.isEmpty():
            out.append(table(links(level), f"{folder}/links-{number}"))
            break
        # A large node's rows are dealt by salt, too.
        salted = large.withColumn("salt", F.explode(F.array(*map(F.lit, range(salts)))))
        marked = level.withColumn("salt", F.pmod(F.xxhash64("word"), F.lit(salts)).cast("int"))
        out.append(table(links(marked.join(salted, [*node, "salt"], "left_anti").drop("salt")), f"{folder}/links-{number}"))
        halves = entries(words, marked.join(salted, [*node, "salt"], "left_semi").drop("salt"))
        level = table(halves, f"{folder}/nodes-{number + 1}")
        remove(f"{folder}/nodes-{number}")
        number += 1
    remove(f"{folder}/nodes-{number}")
    return spark.read.schema(out[0].schema).parquet(*[f"{folder}/links-{i}" for i in range(number + 1)])


def roots(forms: DataFrame, folder: str) -> DataFrame:
    """word and root of rows (word, form): forms followed to the last, twice as far each round. A word's form is never followed back to it."""
    state, number = table(forms.select("word", F.col("form").alias("root")), f"{folder}/roots-0"), 0
    while True:
        on = state.select(F.col("word").alias("root"), F.col("root").alias("further"))
        number += 1
        new = table(state.join(on, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), f"{folder}/roots-{number}")
        remove(f"{folder}/roots-{number - 1}")
        state = new.select("word", "root")
        if not new.filter("moved").limit(1).count():
            return state


def variants(docs: DataFrame, folder: str, least_letters: int = 5, least_times: int = 3, one_in: int = 97, times: int = 2, most: int = 512) -> DataFrame:
    """word, form, root, n, n_near and form_n of every word of docs (doc_id, text) that is long and common enough.

    form: the commonest word that one edit parts from it, the first in code-point order among equals, if it is at least ``times`` as
    common (2 or more: roots end); root: where forms lead, itself without one; n_near: how many words one edit parts from it.
    """
    words = table(vocabulary(docs, least_letters, least_times, one_in), f"{folder}/words")
    found = all_links(words, folder, most).groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("less"), "other")).alias("best"))
    form_n = -F.col("best.less")
    own = words.join(found, "word", "left").withColumn("taken", form_n >= times * F.col("n"))
    own = table(own.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(F.col("taken"), F.col("best.other")).alias("form"), F.when(F.col("taken"), form_n).alias("form_n")), f"{folder}/forms")
    led = roots(own.filter("form is not null"), folder)
    return own.join(led, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
