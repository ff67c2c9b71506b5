"""Benchmark decontamination with DataFrame and SQL functions only.

A window is a run of as many words as an item has, or the whole document where that has fewer words; it is contaminated if the weighted
Jaccard similarity of its word shingles to the item's (weights: how often each occurs) is ``percent`` or more.

1. Where to look, exactly. An item of m shingles and a window of v so similar share at least c = ceil((m + v) percent / (100 + percent))
   of them; v is m, or in a shorter document m percent / 100 at least. A word that a window
   lacks costs it every shingle over that word; so of a few long words of the item, spread such that lacking them all would cost more
   than m - c shingles, one must be in the window. These anchors are looked up in the words of every whole document, first by a bitmap of
   fixed size, then by a join. A hit tells a place and a number of words, not an item: nothing that is similar enough is lost.
2. All windows of that many words about the place get SimHash fingerprints of 63 bits. Bits are counted by running sums, three counters
   to a number, so a window costs the same whatever its size; overlapping hits are looked at once, in segments of bounded size.
3. Fingerprints find items of as many words by blocks: of RADIUS + 1 blocks, one at least is equal in any two fingerprints that differ in
   RADIUS bits or fewer. At the threshold fingerprints differ in 9.6 bits on average (standard deviation 2.9).
4. Pairs within RADIUS are verified exactly, by joins on their shingles. Documents shorter than an item have one window; those that an
   anchor of the item is in are verified at once, more anchors being needed as they may lack more.

Items are taken in parts of ITEMS, a scan of the corpus each, which bounds what is broadcast (some anchors and RADIUS + 1 blocks an item)
whatever the benchmark. Items may have up to 2^21 shingles, which a counter holds.

Words are runs of letters and digits in lower case. Items under five words are one shingle of all; items without words match
nothing, nor do null or empty texts. Repeated items and rows give one row for each doc_id and item_id, that of the most similar window,
first by place. Null ids are ids of their own. Texts of any length are split whole by their task. Empty tables give no rows. Columns
other than doc_id, item_id and text aren't read; ``clean`` returns them as they are, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.llm.common import release, table, unused

RADIUS, ITEMS = 20, 50_000
WORDS = r"[^\p{L}\p{N}]+"
#: Numbers with three counters each, of as many bits: together 63 counters, one a bit of a fingerprint.
NUMBERS, COUNTER = 21, 21
ONES = 1 | 1 << COUNTER | 1 << 2 * COUNTER
#: The first bits of the RADIUS + 1 blocks of three bits.
STARTS = sum(1 << 3 * i for i in range(RADIUS + 1))


def words(text: str) -> Column:
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), WORDS), "")


SHINGLES = "transform(sequence(1, greatest(size({w}) - k + 1, 1)), i -> xxhash64(slice({w}, i, k)))"
SPREAD = f"shiftrightunsigned({{h}}, {{j}}) & {ONES}L"
#: The fingerprint from counters d(j) of the bits j, j + 21 and j + 42.
FINGERPRINT = (
    f"aggregate(sequence(0, {NUMBERS - 1}), 0L, (acc, j) -> acc | element_at(transform(array({{d}}), d -> "
    + " | ".join(f"if(2 * (shiftrightunsigned(d, {COUNTER * i}) & {(1 << COUNTER) - 1}L) > m, shiftleft(1L, j + {NUMBERS * i}), 0L)" for i in range(3))
    + "), 1))"
)


def items(benchmark: DataFrame, shingle: int, percent: int) -> DataFrame:
    """item_id, w, n words, k words a shingle, m shingles (own), need of them, and how few a whole document shorter than the item may share."""
    rows = benchmark.select(F.col("item_id").cast("long"), words("text").alias("w")).distinct().filter("size(w) > 0")
    rows = rows.select("*", F.expr("size(w)").alias("n"), F.expr(f"least(size(w), {shingle})").alias("k"))
    rows = rows.withColumn("m", F.expr("n - k + 1")).withColumn("need", F.expr(f"int(ceil(2 * m * {percent} / {100 + percent}))")).withColumn("fewest", F.expr(f"int(ceil(m * {percent} / 100))"))
    return rows.withColumn("own", F.expr(SHINGLES.format(w="w"))).withColumn("item", F.xxhash64("item_id", "w"))


def anchors(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """anchor, n and k of windows of the items' sizes; anchor and item for documents that have fewer words."""
    long = placed(rows, "need").select("anchor", "n", "k").distinct()
    return long, placed(rows.filter("fewest < m"), "fewest").select("anchor", "item", F.col("n").alias("most"), "k", "m").distinct()


def placed(rows: DataFrame, least: str) -> DataFrame:
    """Long words of each item, one in each of q stretches, k places apart and covered by k shingles where any may be lacking."""
    rows = rows.withColumn("least", F.col(least)).withColumn("q", F.expr("(m - least) div k + 1"))
    each = rows.select("*", F.posexplode("w").alias("p", "anchor")).withColumn("part", F.expr("int(p * q div n)"))
    low, high = "int(ceil(part * n / q)) + k div 2", "int(ceil((part + 1) * n / q)) - 1 - k div 2"
    inner = each.filter(f"least = m or m < k and p between n - k and k - 1 or p between greatest(k - 1, {low}) and least(n - k, {high})")
    best = F.max_by("anchor", F.struct(F.length("anchor"), F.col("p")))
    return inner.groupBy("item", "n", "k", "m", "part").agg(best.alias("anchor"))


def hits(docs: DataFrame, names: DataFrame) -> DataFrame:
    """Each place of a word that may be an anchor, with the words of its document. A byte for each slot of hashes, 16 slots an anchor, says which may be."""
    slots = 1 << min(24, max(10, (16 * names.count() - 1).bit_length()))
    slot = "int(pmod(xxhash64({}), " + f"{slots}))"
    taken = bytearray(slots)
    for (x,) in names.select(F.expr(slot.format("anchor"))).distinct().toLocalIterator():  # some anchors each of ITEMS items
        taken[x] = 1
    own = docs.select("doc_id", F.xxhash64("text").alias("which"), words("text").alias("dw"))
    maybe = F.transform("dw", lambda x, i: F.when(F.substring(F.lit(taken), F.pmod(F.xxhash64(x), F.lit(slots)).cast("int") + 1, F.lit(1)) == F.lit(b"\1"), i))
    found = own.withColumn("hits", F.array_compact(maybe))
    return found.filter("size(hits) > 0").select("doc_id", "which", "dw", F.explode("hits").alias("at")).withColumn("anchor", F.expr("dw[at]"))


KEY = ["doc_id", "which", "n", "segment"]


def stretches(found: DataFrame, folder: str) -> DataFrame:
    """For each run of places about hits, in segments of 4 n places and what a window needs beyond: the first place, the shingles and the fingerprints of the windows."""
    found = found.filter("size(dw) >= n").withColumn("low", F.expr("greatest(at - n + 1, 0)")).select("doc_id", "which", "n", "k", "low", F.expr("slice(dw, low + 1, at + n - low)").alias("region"))
    found = table(found.withColumn("found", F.expr(SHINGLES.format(w="region"))).drop("region"), f"{folder}-regions")  # or the optimizer would put the expression where it is read
    rows = found.select("doc_id", "which", "n", F.expr("n - k + 1").alias("m"), "low", F.posexplode("found").alias("i", "h")).withColumn("p", F.expr("low + i")).drop("low", "i")
    rows = rows.withColumn("segment", F.explode(F.expr("if(p % (4 * n) < m - 1 and p >= 4 * n, array(p div (4 * n), p div (4 * n) - 1), array(p div (4 * n)))")))
    order = Window.partitionBy(*KEY).orderBy("p")
    rows = rows.withColumn("before", F.lag("p").over(order)).filter("before is null or before <> p")
    sums = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("run", F.col("p") - F.row_number().over(order))
    rows = rows.select(*KEY, "m", "run", "p", "h", *[F.sum(F.expr(SPREAD.format(h="h", j=j))).over(sums).alias(f"c{j}") for j in range(NUMBERS)])
    each = F.struct("p", "h", F.array(*[f"c{j}" for j in range(NUMBERS)]).alias("c"))
    runs = rows.groupBy(*KEY, "run").agg(F.first("m").alias("m"), F.array_sort(F.collect_list(each)).alias("a")).filter("size(a) >= m")
    counter = f"a[s + m - 1].c[j] - a[s].c[j] + ({SPREAD.format(h='a[s].h', j='j')})"
    prints = F.expr(f"transform(sequence(0, size(a) - m), s -> {FINGERPRINT.format(d=counter)})")
    return table(runs.select(*KEY, "run", "m", F.expr("a[0].p").alias("first"), F.expr("transform(a, x -> x.h)").alias("shingles"), prints.alias("prints")), f"{folder}-stretches")


def windows(found: DataFrame) -> DataFrame:
    """Place and fingerprint of each window."""
    return found.select(*KEY, "run", "first", F.posexplode("prints").alias("s", "print")).select(*KEY, "run", F.expr("first + s").alias("start"), "print")


def blocks(fingerprint: str) -> Column:
    return F.array(*[F.struct(F.lit(i).alias("block"), F.shiftrightunsigned(F.col(fingerprint), 3 * i).bitwiseAND(F.lit(7)).alias("value")) for i in range(RADIUS + 1)])


def nearby(prints: DataFrame, rows: DataFrame) -> DataFrame:
    """Windows with the items of as many words that they differ from in RADIUS bits or fewer: found by a block in which they are equal, the first of these."""
    counter = f"aggregate(own, 0L, (t, h) -> t + ({SPREAD.format(h='h', j='j')}))"
    index = rows.select("item", F.col("n").alias("of"), F.expr(FINGERPRINT.format(d=counter)).alias("own_print")).dropDuplicates(["item"])
    index = index.select("*", F.inline(blocks("own_print")).alias("own_block", "own_value"))
    each = prints.select("*", F.inline(blocks("print")))
    x = F.col("print").bitwiseXOR(F.col("own_print"))
    equal = F.bitwise_not(x.bitwiseOR(F.shiftrightunsigned(x, 1)).bitwiseOR(F.shiftrightunsigned(x, 2))).bitwiseAND(F.lit(STARTS))
    first = equal.bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("block") * 3) - 1) == 0
    same = (F.col("n") == F.col("of")) & (F.col("block") == F.col("own_block")) & (F.col("value") == F.col("own_value"))
    return each.join(F.broadcast(index), same & (F.bit_count(x) <= RADIUS) & first).select(*KEY, "run", "start", "item")  # RADIUS + 1 rows each of ITEMS items


def verified(pairs: DataFrame, rows: DataFrame, percent: int) -> DataFrame:
    """pairs: doc_id, which, item, start, n_words, v and the shingles (win) of windows; the similarity to the item of those that have enough."""
    key = ["doc_id", "which", "item", "start", "n_words", "v"]
    own = rows.dropDuplicates(["item"]).select("item", "item_id", "m", F.explode("own").alias("h")).groupBy("item", "item_id", "m", "h").agg(F.count("*").alias("times"))
    each = pairs.select(*key, F.explode("win").alias("h")).groupBy(*key, "h").agg(F.count("*").alias("n"))
    both = each.join(own, ["item", "h"]).groupBy(*key, "item_id", "m").agg(F.sum(F.least("n", "times")).alias("c"))
    return both.filter(f"100 * c >= {percent} * (m + v - c)").select("doc_id", "item_id", "start", "n_words", F.expr("c / (m + v - c)").cast("double").alias("similarity"))


def contaminated(docs: DataFrame, benchmark: DataFrame, folder: str, shingle: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, item_id, start_word, n_words and similarity of the most similar window, for each pair that has one."""
    return matches(docs.select(F.col("doc_id").cast("long"), "text"), benchmark, folder, shingle, percent)


def matches(docs: DataFrame, benchmark: DataFrame, folder: str, shingle: int, percent: int) -> DataFrame:
    """The same for a doc_id of any type."""
    every = table(items(benchmark, shingle, percent), f"{folder}/items")
    parts = max(1, -(-every.count() // ITEMS))
    best = None
    for part in range(parts):
        rows = every.filter(F.pmod(F.col("item"), F.lit(parts)) == part) if parts > 1 else every
        long, short = (table(x, f"{folder}/{name}-{part}") for x, name in zip(anchors(rows), ("anchors", "short"), strict=True))
        found = hits(docs, long.select("anchor").unionByName(short.select("anchor")).distinct())
        # some anchors each of ITEMS items; a hit's words are cut to what its windows need where it is found
        places = found.join(F.broadcast(long), "anchor")
        whole = found.join(F.broadcast(short), "anchor").filter(f"size(dw) < most and 100 * (size(dw) - k + 1) >= {percent} * m")
        whole = table(whole.select("doc_id", "which", "item", "k", "dw").dropDuplicates(["doc_id", "which", "item"]), f"{folder}/whole-{part}")
        whole = whole.select("doc_id", "which", "item", F.lit(0).alias("start"), F.expr("size(dw)").alias("n_words"), F.expr("size(dw) - k + 1").alias("v"), F.expr(SHINGLES.format(w="dw")).alias("win"))
        runs = stretches(places, f"{folder}/near-{part}")
        near = table(nearby(windows(runs), rows), f"{folder}/pairs-{part}")
        found = verified(joined(near, runs).unionByName(whole), rows, percent)
        found = found.groupBy("doc_id", "item_id").agg(F.max(F.struct("similarity", (-F.col("start")).alias("back"), F.col("n_words"))).alias("best"))
        best = found if best is None else best.unionByName(found)
    release(docs.sparkSession)
    best = best if parts == 1 else best.groupBy("doc_id", "item_id").agg(F.max("best").alias("best"))
    return best.select("doc_id", "item_id", (-F.col("best.back")).cast("long").alias("start_word"), F.col("best.n_words").cast("long").alias("n_words"), "best.similarity")


def joined(near: DataFrame, runs: DataFrame) -> DataFrame:
    """The pairs with their windows' shingles."""
    own = runs.select(*[F.col(c).alias(f"of_{c}") for c in [*KEY, "run"]], "m", "first", "shingles")
    same = F.lit(True)
    for c in [*KEY, "run"]:
        same = same & F.col(c).eqNullSafe(F.col(f"of_{c}"))
    return near.join(own, same).select("doc_id", "which", "item", "start", F.col("n").alias("n_words"), F.col("m").alias("v"), F.expr("slice(shingles, start - first + 1, m)").alias("win"))


def clean(docs: DataFrame, benchmark: DataFrame, folder: str, shingle: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs whose text has no contaminated window. Rows are judged by their texts, so null and repeated doc_ids each stay or go."""
    key, name = F.md5(F.col("text").cast("binary")), unused(docs, "found")
    found = table(matches(docs.select(key.alias("doc_id"), "text"), benchmark, folder, shingle, percent).select(F.col("doc_id").alias(name)).distinct(), f"{folder}/found")
    return docs.join(found, key == F.col(name), "left_anti")
