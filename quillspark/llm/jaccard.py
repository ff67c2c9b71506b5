"""N-gram Jaccard self-join: documents whose sets of word shingles overlap by ``percent`` of their union or more.

1. First links. Sketches of two hash minima are exchanged; where texts share one, they are compared with the first text of that
   sketch, in their file and then across files. Most near copies are then one component, whatever its size: a label.
2. Blocking without loss. Sizes fall into bands. Two linked sets of at most U shingles differ in at most
   d = 2 U (100 - percent) / (100 + percent) shingles, so if hash ranges cut the sets into m > d parts, m - d parts at least are
   equal in both. Digests of parts of one shingle or none say little; they are left out where the set has fewer than m - d of them.
   Sets of small bands emit as many of their first shingles as must hold a shared one instead. A document emits keys for its own
   band and for those that a larger linked set may fall into. A file sends a key once for each label, and only keys that two labels
   share come back, so that a group of near copies costs a row a file, not a row a pair or a document. Keys with the same documents
   are one group. Files send the bitmap of each document to its groups; where bitmaps allow a link of two labels, documents join a family.
3. Size-banded tiles. A family is sorted into bands of sizes 2 % wide and cut into tiles of bounded count and bytes; tiles are compared
   where their sizes allow a link, small families as one tile. Each tile holds hashed bitmaps, about a bit a shingle: a bit is set
   if an odd number of shingles falls on it, so that the bits in which two differ
   bound the difference from below, and so the overlap from above. Pairs that pass have their sorted arrays intersected,
   unless labels or links found in the tile already join them. Tiles give the edges of a spanning forest, not all pairs.
4. Components of all edges; each document gets the least doc_id of its component.

Equal sets of a file are one entry. Null, empty and blank texts have no shingles and are linked with nothing. Null doc_ids
take part, but don't name a component; a component of such rows only has a null id. Repeated rows are linked copies.
An empty table gives no rows. Shingles are 64-bit hashes. A text of any length is one set, held whole by a task. Columns other than
doc_id and text aren't read, whatever their names; one_of_each returns them as they are.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark.llm.common import LOWER, Substrings, arrow, buckets, deal, grams, mix, packed, release, remove, table, unused, words
from quillspark.llm.graph import Forest, components
from quillspark.llm.store import LAST, TextStore, by_bucket, dump, joined, load, parse, save

RATIO, TILE, SMALL = 1.3, 2048, 64
TILE_SHINGLES = 4 << 20
SEED = np.uint64(0xA0761D6478BD642F)


def bands(most: int) -> np.ndarray:
    """Lower bounds of the bands, past ``most``."""
    out = [1]
    while out[-1] <= most:
        out.append(max(out[-1] + 1, int(out[-1] * RATIO)))
    return np.array(out)


BANDS = bands(1 << 40)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, k: int) -> list[np.ndarray]:
    """Of each text, its distinct shingles in order."""
    starts, ends, first = words(data, offsets)
    hashes = Substrings(data, LOWER)(starts, ends) + (ends - starts).astype(np.uint64)
    found, ptr = grams(hashes, first, k)
    out = []
    for i, n in enumerate(np.diff(first).tolist()):
        if n == 0:
            out.append(np.empty(0, np.uint64))
        elif n < k:
            whole = hashes[first[i] : first[i + 1]]
            out.append(mix(np.array([(whole * np.cumprod(np.full(n, SEED | np.uint64(1)))).sum() + np.uint64(n)], np.uint64)))
        else:
            own = np.sort(found[ptr[i] : ptr[i + 1]])
            out.append(own[np.append(True, own[1:] != own[:-1])])
    return out


def spaces(n: int, percent: int) -> range:
    """The bands for which a set of n shingles emits keys."""
    low, high = np.searchsorted(BANDS, [n, n * 100 // percent], "right") - 1
    return range(int(low), int(high) + 1)


def parts(own: np.ndarray, percent: int) -> list[tuple[int, np.ndarray]]:
    """For each band, the keys by which a set meets all those that it can be linked with."""
    n = len(own)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(mix(own ^ SEED), out=sums[1:])
    out = []
    for band in spaces(n, percent):
        most = int(BANDS[band + 1]) - 1
        if most <= SMALL:
            out.append((band, mix(own[: n + (-n * percent // 100) + 1] ^ mix(np.array([band], np.uint64)))))
            continue
        d = 2 * most * (100 - percent) // (100 + percent)
        m = d + d // 3 + 1
        at = np.searchsorted((own >> np.uint64(32)) * np.uint64(m) >> np.uint64(32), np.arange(m + 1))
        size = np.diff(at)
        least = 2 if (size < 2).sum() < m - d else 1 if (size < 1).sum() < m - d else 0
        which = np.flatnonzero(size >= least)
        out.append((band, mix((sums[at[which + 1]] - sums[at[which]]) ^ mix(which.astype(np.uint64) * np.uint64(1 << 20) + np.uint64(band)))))
    return out


def width(most: int) -> int:
    """64-bit words of the bitmaps that sets of at most so many shingles are compared by: a bit a shingle or more."""
    return int(max(4, 2 ** np.ceil(np.log2(max(most, 1) / 64))))


def bitmap(own: np.ndarray, words64: int = 4) -> np.ndarray:
    """Of each bit, whether an odd number of shingles falls on it."""
    bits = np.bincount((own % np.uint64(64 * words64)).astype(np.int64), minlength=64 * words64) & 1
    return np.packbits(bits.astype(np.uint8)).view(np.uint64)


def sketch(own: np.ndarray) -> np.uint64:
    return mix(np.array([own[0] ^ mix(mix(own ^ SEED).min(keepdims=True))[0]], np.uint64))[0]


def may_link(size_a: np.ndarray, size_b: np.ndarray, differ: np.ndarray, percent: int) -> np.ndarray:
    """Whether sets of these sizes that differ in so many shingles at least can overlap enough."""
    total = size_a + size_b
    return (100 + percent) * (total - differ) >= 2 * percent * total


def meetings(key: np.ndarray, row: np.ndarray, size: np.ndarray, label: np.ndarray, maps: np.ndarray, percent: int, forest: Forest) -> None:
    """Joins in the forest rows of two labels with a common key whose bitmaps allow a link, a key at a time."""
    order = np.lexsort((size[row], key))
    bounds = np.flatnonzero(np.append(True, key[order][1:] != key[order][:-1]))
    for a, b in zip(bounds.tolist(), [*bounds[1:].tolist(), len(order)], strict=True):
        if b - a < 2:
            continue
        own = np.unique(row[order[a:b]])
        own = own[np.argsort(size[own], kind="stable")]
        s, of, m = size[own], label[own], maps[own]
        kinds, counts = np.unique(of, return_counts=True)
        if len(kinds) < 2:
            continue
        # rows of the commonest label meet the others from their side
        for j in np.flatnonzero(of != kinds[counts.argmax()]).tolist():
            i, k = np.searchsorted(s, -(-s[j] * percent // 100)), np.searchsorted(s, s[j] * 100 // percent, "right")
            near = np.flatnonzero(of[i:k] != of[j]) + i
            near = near[may_link(s[near], s[j], np.bitwise_count(m[near] ^ m[j]).sum(1, dtype=np.int64), percent)]
            for x in near.tolist():
                forest.join(int(own[x]), int(own[j]))


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """By sorted-array intersection."""
    return bool(links_of(a, [b], percent)[0])


def links_of(a: np.ndarray, others: list[np.ndarray], percent: int) -> np.ndarray:
    """Which of the sets are linked with a: by intersection of sorted arrays, in one pass."""
    sizes = np.array([len(x) for x in others])
    every = np.concatenate(others)
    same = a[np.minimum(np.searchsorted(a, every), len(a) - 1)] == every
    inner = np.add.reduceat(same.astype(np.int64), np.cumsum(sizes) - sizes)
    return 100 * inner >= percent * (len(a) + sizes - inner)


def tile_links(sets: list[np.ndarray], side: np.ndarray, percent: int, label: np.ndarray | None = None, tested: list | None = None) -> list[tuple[int, int]]:
    """Edges that join all linked sets of one tile (side 0), or of side 0 with side 1, in one forest; sets of a label are joined before.

    tested: gets the number of pairs that pass the bitmaps.
    """
    sizes = np.array([len(x) for x in sets])
    words64 = width(int(sizes.max()))
    forest, out = Forest(len(sets)), []
    if label is not None:
        _, first, which = np.unique(label, return_index=True, return_inverse=True)
        for i, x in enumerate(first[which].tolist()):
            forest.join(i, x)
    order = np.argsort(sizes, kind="stable")
    s, m, which = sizes[order], np.stack([bitmap(sets[i], words64) for i in order.tolist()]), side[order]
    two = len(np.unique(side)) > 1
    for j in range(1, len(order)):
        i = np.searchsorted(s, -(-s[j] * percent // 100))
        if i >= j:
            continue
        differ = np.bitwise_count(m[i:j] ^ m[j]).sum(1, dtype=np.int64)
        pass_ = may_link(s[i:j], s[j], differ, percent)
        if two:
            pass_ &= which[i:j] != which[j]
        near = np.flatnonzero(pass_)
        if tested is not None:
            tested.append(len(near))
        near = order[near[np.argsort(differ[near], kind="stable")] + i].tolist()
        b = int(order[j])
        while near:
            root = forest.find(b)
            some = [x for x in near if forest.find(x) != root]
            some, near = some[:16], some[16:]
            if not some:
                break
            for x in np.array(some)[links_of(sets[b], [sets[x] for x in some], percent)].tolist():
                if forest.join(x, b):
                    out.append((x, b))
    return out


def component_table(docs: DataFrame, folder: str, words_each: int = 3, percent: int = 90) -> DataFrame:
    """doc_id, n_shingles and component_id of every row."""
    rows = labelled(docs, folder, words_each, percent)
    least = table(rows.filter("label is not null").groupBy("label").agg(F.min("doc_id").alias("component_id")), f"{folder}/least")
    return rows.join(least, "label", "left").select("doc_id", "n_shingles", F.when(F.col("label").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def labelled(docs: DataFrame, folder: str, words_each: int, percent: int, digests: bool = False, store: TextStore | None = None) -> DataFrame:
    """doc_id, n_shingles and label of every row: rows of a component have one label, rows without shingles null.

    digests: and md5 of the text. store: where docs' texts go, and stay; place is a row's file and place there.
    """
    spark, keep = docs.sparkSession, store is not None
    store = store or TextStore(f"{folder}/texts")
    files, n = store.append(docs), buckets(docs.sparkSession)
    early = table(first_links(spark, store, files, words_each, percent, digests), f"{folder}/early")
    release(spark)
    joined_early = table(components(early, f"{folder}/first"), f"{folder}/joined")
    place = F.shiftright("node", 32).cast("int").alias("bucket"), F.col("node").bitwiseAND(F.lit(2**32 - 1)).alias("entry")
    known = joined_early.select(*place, "label").unionByName(spark.createDataFrame([(x, None, None) for x in files], "bucket int, entry long, label long"))
    known = deal(known, max(1, store.files))

    def send(batches):
        for file, (entries, labels) in by_file(batches, 2).items():
            label, several = labels_of(store, file, entries, labels)
            keys, band, owners = [], [], []
            for entry, own in entries_of(store, file, np.arange(len(label)), words_each):
                for k, x in parts(own, percent):
                    keys.append(x)
                    band.append(k)
                    owners.append(entry)
            if not keys:
                continue
            sizes = [len(x) for x in keys]
            key, owner, band = np.concatenate(keys), np.repeat(np.array(owners, np.uint32), sizes), np.repeat(np.array(band, np.uint8), sizes)
            if several.any():  # a key once for each label
                order = np.lexsort((owner, label[owner], key))
                same = np.append(False, (key[order][1:] == key[order][:-1]) & (label[owner[order]][1:] == label[owner[order]][:-1]))
                keep = order[~same]
                key, owner, band = key[keep], owner[keep], band[keep]
            for bucket, (k, o, b) in by_bucket((key % np.uint64(n)).astype(np.int64), n, [(key // np.uint64(n)).astype(np.uint32), owner, band]):
                order = np.argsort(k, kind="stable")
                whose = np.unique(o)
                mine = whose[label[whose] != (file << 32) + whose.astype(np.int64)]
                yield bucket, dump([np.diff(k[order], prepend=np.uint32(0)), o[order], b[order], mine, label[mine], whose[several[whose]], np.array([file, bucket], np.int32)])

    def twice(blobs):
        """For each document the groups of two labels that it meets in this bucket: a group is all that have some key, and often many keys have one group."""
        key, owner, band, file, label, many, bucket = [], [], [], [], [], [], 0
        for blob in blobs:
            steps, o, b, mine, other, several, at = parse(blob)
            own = (int(at[0]) << 32) + o.astype(np.int64)
            if len(mine):
                i = np.minimum(np.searchsorted(mine, o), len(mine) - 1)
                own = np.where(mine[i] == o, other[i], own)
            bucket = int(at[1])
            for to, x in zip((key, owner, band, file, label, many), (np.cumsum(steps, dtype=np.uint32), o, b, np.full(len(o), at[0], np.int32), own, np.isin(o, several)), strict=True):
                to.append(x)
        if not key:
            return
        key, owner, band, file, label, many = (np.concatenate(x) for x in (key, owner, band, file, label, many))
        order = np.lexsort((label, key))
        k, l = key[order], label[order]
        heads = np.flatnonzero(np.append(True, k[1:] != k[:-1]))
        sizes = np.diff(np.append(heads, len(order)))
        two = l[heads] != l[heads + sizes - 1]
        node = mix(mix((file[order].astype(np.uint64) << np.uint64(32)) + owner[order]) + band[order])
        lead = np.minimum.reduceat((file[order].astype(np.int64) << 32) + owner[order], heads).astype(np.uint64)
        # groups with one least member go to one bucket, where their documents' bitmaps are sent once
        group = mix(np.add.reduceat(node, heads) + sizes.astype(np.uint64)) // np.uint64(2 * n) * np.uint64(n) + mix(lead) % np.uint64(n)
        group = np.repeat(group, sizes)
        keep = np.repeat(two, sizes)
        hit, group = order[keep], group[keep]
        split = np.where(many[hit], key[hit], 0)  # documents that stand for others need the key
        once = np.lexsort((split, group, owner[hit], file[hit]))
        f, o, g, x = file[hit][once], owner[hit][once], group[once], split[once]
        new = np.append(True, (f[1:] != f[:-1]) | (o[1:] != o[:-1]) | (g[1:] != g[:-1]) | (x[1:] != x[:-1])) if len(once) else np.empty(0, bool)
        hit, group = hit[once][new], g[new]
        rows = [(k, dump([*own, np.full(len(own[0]), bucket, np.int32)])) for k, own in by_bucket(file[hit], store.files, [owner[hit], group, band[hit], key[hit]])]
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in rows], pa.int32()), pa.array([x for _, x in rows], pa.binary())], ["bucket", "blob"])

    def signatures(batches):
        """Bitmaps of the documents with such groups, one to each bucket and band of theirs, with the groups."""
        found: dict[int, list[list[np.ndarray]]] = {}
        given: dict[int, list[tuple]] = {}
        for batch in batches:
            for file, blob, entry, label in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if blob is not None:
                    found.setdefault(file, []).append(parse(blob))
                elif entry is not None:
                    given.setdefault(file, []).append((entry, label))
        for file, blobs in found.items():
            mine = np.array(given.get(file, []), np.int64).reshape(-1, 2)
            label, several = labels_of(store, file, mine[:, 0], mine[:, 1])
            owner, group, band, key, bucket = (np.concatenate(x) for x in zip(*blobs, strict=True))
            owner = owner.astype(np.int64)
            wanted = several[owner]
            # of a label with several documents, all those that have the key
            full = key[wanted].astype(np.uint64) * np.uint64(n) + bucket[wanted].astype(np.uint64)
            tags, tag_label, tag_band, tag_group = full, label[owner[wanted]], band[wanted], group[wanted]
            order = np.argsort(tags, kind="stable")
            tags, tag_label, tag_band, tag_group = tags[order], tag_label[order], tag_band[order], tag_group[order]
            order = np.lexsort((group, band, owner))
            owner, group, band = owner[order], group[order], band[order]
            need = np.union1d(owner, np.flatnonzero(np.isin(label, tag_label)))
            out: dict[tuple[int, int], list[tuple]] = {}
            held = 0
            for entry, own in entries_of(store, file, need, words_each):
                a, b = np.searchsorted(owner, [entry, entry + 1])
                groups: dict[int, list[np.ndarray]] = {}
                for k in np.unique(band[a:b]).tolist():
                    groups.setdefault(k, []).append(group[a:b][band[a:b] == k])
                if several[entry] and len(tags):
                    for k, x in parts(own, percent):
                        x = np.unique(x // np.uint64(n) % np.uint64(2**32) * np.uint64(n) + x % np.uint64(n))
                        lo, hi = np.searchsorted(tags, x), np.searchsorted(tags, x, "right")
                        at = np.concatenate([np.arange(i, j) for i, j in zip(lo[hi > lo].tolist(), hi[hi > lo].tolist(), strict=True)] or [np.empty(0, np.int64)]).astype(np.int64)
                        at = at[(tag_label[at] == label[entry]) & (tag_band[at] == k)]
                        if len(at):
                            groups.setdefault(k, []).append(tag_group[at])
                for k, mine in groups.items():
                    mine = np.unique(np.concatenate(mine))
                    bits = bitmap(own, width(int(BANDS[k + 1])))
                    to = (mine % np.uint64(n)).astype(np.int64)
                    for bucket_ in np.unique(to).tolist():
                        out.setdefault((bucket_, k), []).append(((file << 32) + entry, len(own), int(label[entry]), bits, mine[to == bucket_]))
                        held += len(bits)
                if held > 1 << 20:
                    yield from signed(out)
                    out, held = {}, 0
            yield from signed(out)

    def signed(out):
        for (bucket, band), rows in out.items():
            counts = np.array([len(r[4]) for r in rows], np.int64)
            yield bucket, dump([np.array([band], np.int32), *[np.array([r[j] for r in rows], np.int64) for j in range(3)], counts, np.concatenate([r[4] for r in rows]), np.concatenate([r[3] for r in rows])])

    def meet(blobs):
        """One forest of the documents of this bucket that may be linked."""
        by_band: dict[int, list[list[np.ndarray]]] = {}
        for blob in blobs:
            band, *rest = parse(blob)
            by_band.setdefault(int(band[0]), []).append(rest)
        a, b = [], []
        for band, found in by_band.items():
            node, size, label, counts, key, maps = (np.concatenate(x) for x in zip(*found, strict=True))
            forest = Forest(len(node))
            meetings(key, np.repeat(np.arange(len(node)), counts), size, label, maps.reshape(len(node), -1), percent, forest)
            root = np.array([forest.find(x) for x in range(len(node))], np.int64)
            own = np.flatnonzero(root != np.arange(len(node)))
            a.append(node[own])
            b.append(node[root[own]])
        if a:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], ["a", "b"])

    hits = packed(known, send, twice, "bucket int, blob binary", n).select("bucket", "blob", F.lit(None).cast("long").alias("entry"), F.lit(None).cast("long").alias("label"))
    given = joined_early.select(place[0], F.lit(None).cast("binary").alias("blob"), place[1], "label")
    met = table(packed(deal(hits.unionByName(given), max(1, store.files)), signatures, meet, "a long, b long", n), f"{folder}/met")
    del hits
    release(spark)
    families = table(components(met, f"{folder}/families"), f"{folder}/family")
    members = spark_members(store, files, spark, digests)
    members = table(members, f"{folder}/members")
    entries = members.filter("entry >= 0").groupBy("node").agg(F.first("n_shingles").alias("size"))
    placed = families.join(entries, "node").select("node", F.col("label").alias("family"), "size", F.floor(F.log("size") / F.log(F.lit(1.02))).cast("int").alias("band"))
    placed = table(placed.join(joined_early.select("node", F.col("label").alias("known")), "node", "left").withColumn("known", F.coalesce("known", "node")), f"{folder}/placed")
    share = f"greatest(count(*) / {TILE}, sum(size) / {TILE_SHINGLES})"
    totals = table(placed.groupBy("family", "band").agg(F.expr(share).alias("share")), f"{folder}/totals")
    # bands in turn fill tiles; a band that is more than a tile is cut by hash
    before = F.sum("share").over(Window.partitionBy("family").orderBy("band").rowsBetween(Window.unboundedPreceding, -1))
    whole = F.sum("share").over(Window.partitionBy("family"))
    totals = table(totals.select("family", "band", F.when(whole <= 1, -1).otherwise(F.floor(F.coalesce(before, F.lit(0.0)))).cast("int").alias("tile"), F.ceil("share").cast("int").alias("cuts")), f"{folder}/tilings")
    placed = placed.join(totals, ["family", "band"]).withColumn("cut", F.pmod(F.xxhash64("node"), "cuts").cast("int"))
    placed = table(placed.select("node", "family", "band", "tile", F.when(F.col("tile") < 0, 0).otherwise(F.col("cut")).alias("cut"), "known"), f"{folder}/tiles")
    reach = int(np.ceil(np.log(100 / percent) / np.log(1.02))) + 1
    large = table(placed.filter("tile >= 0").groupBy("family", "tile", "cut").agg(F.min("band").alias("first"), F.max("band").alias("last"), F.min("known").alias("low"), F.max("known").alias("high")), f"{folder}/large")
    other = large.select("family", *[F.col(c).alias(f"{c}2") for c in ("tile", "cut", "first", "last", "low", "high")])
    # tiles meet those of bands within reach; two tiles of one label have nothing to find
    pairs = large.join(other, "family").filter(f"(tile2 > tile or tile2 = tile and cut2 >= cut) and first2 <= last + {reach} and not (low = high and low2 = high2 and low = low2)")
    task = F.xxhash64("family", "tile", "cut", "tile2", "cut2")
    sides = pairs.select("family", "tile", "cut", task.alias("task"), F.lit(0).alias("side")).unionByName(pairs.filter("tile2 > tile or cut2 > cut").select("family", F.col("tile2").alias("tile"), F.col("cut2").alias("cut"), task.alias("task"), F.lit(1).alias("side")))
    wanted = placed.filter("tile < 0").select("node", F.xxhash64("family").alias("task"), F.lit(0).alias("side"), "known").unionByName(placed.filter("tile >= 0").join(sides, ["family", "tile", "cut"]).select("node", "task", "side", "known"))
    wanted = wanted.select(place[0], place[1], "task", "side", "known")

    def ship(batches):
        for file, found in by_file(batches, 4).items():
            entry, *found = found
            order = np.argsort(entry, kind="stable")
            entry, (task, side, label) = entry[order], (x[order] for x in found)
            out, sent = {}, 0
            for e, got in entries_of(store, file, np.unique(entry), words_each):
                a, b = np.searchsorted(entry, [e, e + 1])
                for t, s, x in zip(task[a:b].tolist(), side[a:b].tolist(), label[a:b].tolist(), strict=True):
                    out.setdefault(t % n, []).append((t, s, (file << 32) + e, x, got))
                    sent += len(got)
                if sent > 1 << 20:
                    yield from flush(out)
                    out, sent = {}, 0
            yield from flush(out)

    def flush(out):
        for bucket, rows in out.items():
            yield bucket, dump([np.array([r[j] for r in rows], np.int64) for j in range(4)] + [np.array([len(r[4]) for r in rows], np.int64), np.concatenate([r[4] for r in rows])])

    def compare(blobs):
        task, side, node, label, sizes, sets = joined(blobs, [np.int64] * 5 + [np.uint64])
        if not len(task):
            return
        ends = np.cumsum(sizes)
        order = np.argsort(task, kind="stable")
        bounds = np.flatnonzero(np.append(True, task[order][1:] != task[order][:-1]))
        for a, b in zip(bounds, [*bounds[1:], len(order)], strict=True):
            rows = order[a:b]
            edges = tile_links([sets[ends[r] - sizes[r] : ends[r]] for r in rows], side[rows], percent, label[rows])
            if edges:
                x, y = np.array(edges).T
                yield pa.RecordBatch.from_arrays([pa.array(node[rows[x]]), pa.array(node[rows[y]])], ["a", "b"])

    sent = arrow(deal(wanted, max(1, store.files)), lambda batches: rows_of(ship(batches)), "bucket int, blob binary")
    links = arrow(deal(sent, n), lambda batches: compare([x for b in batches for x in b.column(1).to_pylist()]), "a long, b long")
    links = table(links.unionByName(early), f"{folder}/links")
    labels = components(links, f"{folder}/components")
    rows = members.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    rows = table(rows.select("doc_id", "n_shingles", F.when(F.col("entry") >= 0, F.col("label")).alias("label"), "place", *["md5"] * digests), f"{folder}/labelled")
    if keep:
        store.drop(["members", "sketches"], store.files)
    for name in (*["texts"] * (not keep), "early", "first", "joined", "met", "families", "family", "members", "placed", "totals", "tilings", "tiles", "large", "links", "components"):
        remove(f"{folder}/{name}")
    del sent, known, given
    release(spark)
    return rows


def first_links(spark: SparkSession, store: TextStore, files: list[int], words_each: int, percent: int, digests: bool) -> DataFrame:
    """Writes the members of each file; edges (a, b) between linked documents that share a sketch, stars about its first."""
    n = buckets(spark)

    def send(batches):
        for batch in batches:
            for file in batch.column(0).to_pylist():
                known: dict[bytes, int] = {}
                ids, entries, sizes, sketches, md5 = [], [], [], [], []
                for doc_ids, _, offsets, data, _ in store.read(file):
                    if digests:
                        md5 += [hashlib.md5(memoryview(data)[a:b]).digest() for a, b in zip(offsets, offsets[1:], strict=False)]
                    for doc, own in zip(doc_ids, shingle_sets(data, offsets, words_each), strict=True):
                        digest = own.tobytes() if len(own) < 3 else np.array([own.sum(), mix(own ^ SEED).sum(), len(own)], np.uint64).tobytes()
                        entry = known.setdefault(digest, len(known)) if len(own) else -1
                        if entry == len(sketches):
                            sketches.append(sketch(own))
                        ids.append(doc)
                        entries.append(entry)
                        sizes.append(len(own))
                found = np.array(sketches, np.uint64)
                save(store.side("members", file), [np.array(ids, np.int64), np.array(entries, np.int64), np.array(sizes, np.int64), np.frombuffer(b"".join(md5), np.uint8)])
                save(store.side("sketches", file), [found])
                found = np.unique(found)
                for bucket, own in by_bucket((found % np.uint64(n)).astype(np.int64), n, [found]):
                    yield bucket, dump([*own, np.array([file], np.int32)])

    def shared(blobs):
        found = [parse(x) for x in blobs]
        if not found:
            return
        value, file = np.concatenate([x for x, _ in found]), np.concatenate([np.repeat(f, len(x)) for x, f in found])
        once, of, counts = np.unique(value, return_inverse=True, return_counts=True)
        hit = counts[of] > 1
        rows = [(k, dump(own)) for k, own in by_bucket(file[hit], store.files, [value[hit]])]
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in rows], pa.int32()), pa.array([x for _, x in rows], pa.binary())], ["bucket", "blob"])

    def star(nodes: list[int], sets: list[np.ndarray]) -> tuple[np.ndarray, list[int]]:
        """Edges to the first, and the places of the sets that aren't linked with it."""
        ok = links_of(sets[0], sets[1:], percent) if len(sets) > 1 else np.empty(0, bool)
        rest = np.array(nodes[1:], np.int64)
        return np.stack([rest[ok], np.full(int(ok.sum()), nodes[0], np.int64)]), (np.flatnonzero(~ok) + 1).tolist()

    def ship(batches):
        asked: dict[int, list[np.ndarray]] = {}
        for batch in batches:
            for file, blob in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                asked.setdefault(file, []).extend(parse(blob) if blob else [])
        for file, values in asked.items():
            (own,) = load(store.side("sketches", file))
            once, of, counts = np.unique(own, return_inverse=True, return_counts=True)
            across = np.isin(once, np.concatenate(values)) if values else np.zeros(len(once), bool)
            wanted = np.flatnonzero((across | (counts > 1))[of])
            first: dict[int, tuple[int, np.ndarray]] = {}
            out: dict[int, list[tuple]] = {}
            edges, sent = [], 0
            for entry, got in entries_of(store, file, wanted, words_each):
                value, node = int(own[entry]), (file << 32) + entry
                if value in first and linked(first[value][1], got, percent):
                    edges.append((node, first[value][0]))
                    continue
                if value not in first and counts[of[entry]] > 1:
                    first[value] = node, got
                if across[of[entry]]:
                    out.setdefault(value % n, []).append((value, node, got))
                    sent += len(got)
                if sent > 1 << 20:
                    yield from flush(out)
                    out, sent = {}, 0
            yield from flush(out)
            if edges:
                yield file % n, dump([np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint64), np.array(edges, np.int64).ravel()])

    def flush(out):
        for bucket, rows in out.items():
            yield bucket, dump([np.array([r[0] for r in rows], np.uint64), np.array([r[1] for r in rows], np.int64), np.array([len(r[2]) for r in rows], np.int64), np.concatenate([r[2] for r in rows]), np.empty(0, np.int64)])

    def verify(batches):
        """Each set is compared with the first of its sketch, and goes."""
        first: dict[int, tuple[int, np.ndarray]] = {}
        for batch in batches:
            for blob in batch.column(1).to_pylist():
                value, node, sizes, sets, local = parse(blob)
                ends = np.cumsum(sizes)
                a, b = local[::2].tolist(), local[1::2].tolist()
                groups: dict[int, list[int]] = {}
                for i, v in enumerate(value.tolist()):
                    groups.setdefault(v, []).append(i)
                for v, rows in groups.items():
                    got = [sets[ends[i] - sizes[i] : ends[i]] for i in rows]
                    nodes = node[rows].tolist()
                    if v in first:
                        got, nodes = [first[v][1], *got], [first[v][0], *nodes]
                    else:
                        first[v] = nodes[0], got[0].copy()
                    edges, _ = star(nodes, got)
                    a += edges[0].tolist()
                    b += edges[1].tolist()
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    listed = store.listed(spark, files)
    asked = packed(listed, send, shared, "bucket int, blob binary", n)
    sent = arrow(deal(asked.unionByName(listed), max(1, store.files)), lambda batches: rows_of(ship(batches)), "bucket int, blob binary")
    return arrow(deal(sent, n), verify, "a long, b long")


def by_file(batches, columns: int) -> dict[int, list[np.ndarray]]:
    """The rows of each file, a column each after that of the file; rows of nulls only name a file."""
    found: dict[int, list[list[np.ndarray]]] = {}
    for batch in batches:
        file = batch.column(0).to_numpy()
        some = batch.column(1).is_valid().to_numpy(zero_copy_only=False)
        rest = [c.fill_null(0).to_numpy().astype(np.int64) for c in batch.columns[1:]]
        for f in np.unique(file).tolist():
            found.setdefault(f, []).append([x[(file == f) & some] for x in rest])
    return {f: [np.concatenate(x) for x in zip(*parts, strict=True)] for f, parts in found.items()}


def labels_of(store: TextStore, file: int, entries: np.ndarray, labels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The label of each entry of a file, its own number where it has no other; and whether another entry here has it, too."""
    (own,) = load(store.side("sketches", file))
    label = (file << 32) + np.arange(len(own))
    label[entries] = labels
    _, of, counts = np.unique(label, return_inverse=True, return_counts=True)
    return label, counts[of] > 1


def entries_of(store: TextStore, file: int, wanted: np.ndarray, words_each: int):
    """The sets of these entries of a file."""
    _, of, *_ = load(store.side("members", file))
    first = np.full(int(of.max()) + 1 if len(of) else 0, -1, np.int64)
    rows = np.flatnonzero(of >= 0)[::-1]
    first[of[rows]] = rows
    need = np.zeros(len(of), bool)
    need[first[wanted]] = True
    at = 0
    for ids, _, offsets, data, _ in store.read(file):
        rows = np.flatnonzero(need[at : at + len(ids)])
        if len(rows) < len(ids):
            texts = [data[offsets[i] : offsets[i + 1]] for i in rows.tolist()]
            offsets, data = np.cumsum([0, *map(len, texts)]), np.concatenate(texts) if texts else data[:0]
        yield from zip(of[at + rows].tolist(), shingle_sets(data, offsets, words_each), strict=True)
        at += len(ids)


def rows_of(found):
    for bucket, blob in found:
        yield pa.RecordBatch.from_arrays([pa.array([bucket], pa.int32()), pa.array([blob], pa.binary())], ["bucket", "blob"])


def spark_members(store: TextStore, files: list[int], spark, digests: bool) -> DataFrame:
    """doc_id, node, entry (-1: no shingles), n_shingles, place and, with digests, md5 of every row, in order of place."""
    md5 = ["md5"] * digests

    def read(batches):
        for batch in batches:
            for file in batch.column(0).to_pylist():
                ids, entry, size, digest = load(store.side("members", file))
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64(), mask=ids == LAST), pa.array((file << 32) + entry), pa.array(entry), pa.array(size), pa.array((file << 32) + np.arange(len(ids))), *[pa.Array.from_buffers(pa.binary(16), len(ids), [None, pa.py_buffer(digest)]).cast(pa.binary()) for _ in md5]], ["doc_id", "node", "entry", "n_shingles", "place", *md5])

    return arrow(store.listed(spark, files), read, "doc_id long, node long, entry long, n_shingles long, place long" + ", md5 binary" * digests)


def one_of_each(docs: DataFrame, folder: str, words_each: int = 5, percent: int = 80) -> DataFrame:
    """One row of each component: smallest doc_id, nulls last, of these the smallest md5 of the text. Rows without shingles stay.

    Of rows that have doc_id and text in common, one stays, whatever their other columns are. Texts are read from the operator's own
    files, so they aren't shuffled; the files must be there until the result is written.
    """
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    null = unused(docs, "null")
    stored = docs.select("doc_id", "text", F.struct(*others, F.col("text").isNull().alias(null)).alias("rest"))
    store = TextStore(f"{folder}/texts", rest=True)
    rows = labelled(stored, folder, words_each, percent, digests=True, store=store)
    key = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "md5", "place")
    found = rows.filter("label is not null")
    first = table(found.groupBy("label").agg(F.min(key).alias("first"), F.count("*").alias("n")).filter("n > 1").select("label", F.col("first.place").alias("stays")), f"{folder}/least")
    gone = found.select("label", "place").join(first, "label").filter("place <> stays")
    gone = table(gone.select(F.shiftright("place", 32).cast("int").alias("bucket"), F.col("place").bitwiseAND(F.lit(2**32 - 1)).alias("row")), f"{folder}/gone")
    remove(f"{folder}/labelled")
    spark = docs.sparkSession
    every = gone.unionByName(spark.createDataFrame([(x, None) for x in range(store.files)], "bucket int, row long"))

    def read(batches):
        for file, (lost,) in by_file(batches, 1).items():
            if not store.has(file):
                continue
            at, lost = 0, np.sort(lost)
            for _, batch in store.batches(file):
                keep = np.ones(len(batch), bool)
                a, b = np.searchsorted(lost, [at, at + len(batch)])
                keep[lost[a:b] - at] = False
                at += len(batch)
                batch = batch.filter(pa.array(keep))
                text = pc.if_else(batch.column(3).field(null), None, batch.column(1).cast(pa.string()))
                yield pa.RecordBatch.from_arrays([batch.column(0), text, batch.column(3)], ["doc_id", "text", "rest"])

    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), stored.schema["rest"]])
    kept = arrow(deal(every, max(1, store.files)), read, schema)
    return kept.select(*[F.col(c).cast(docs.schema[c].dataType).alias(c) if c in ("doc_id", "text") else F.col("rest").getField(c).alias(c) for c in docs.columns])
