"""Mixing sources to target weights: complete epochs first, then a weighted sample of whole documents up to the last word of a budget.

Targets share out a budget of words by the sources' weights; a source stops at ``most`` times its size, and what is over is shared out
again. What a target asks for beyond complete epochs is sampled without replacement: each document draws an exponential key whose
rate is its quality, and documents are taken in ascending order of keys until the budget ends, within a document at that.
Keys follow from seed, doc_id and text, so reruns agree. Texts are read once; only numbers are sorted, in ranges of (source, key) that
split a large source over tasks, with running sums in each range and a table of the ranges' totals.

Null texts have size 0 and nothing is taken of them; null sources are one source, the last; null doc_ids and repeated rows are rows like
others. Extra columns are carried by ``mixed`` and not looked at by ``mix``. Empty tables give no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.llm.common import arrow, prepare, table, text_slices, unused, words
from quillspark.llm.textstats import count


def measured(docs: DataFrame, seed: int) -> DataFrame:
    """row (kept), doc_id, source, draw (a 64-bit hash), size in words and quality: the shares of words not in repeated windows and of plain characters."""

    def each(batches):
        for batch in batches:
            for row, offsets, data in text_slices(batch, "text"):
                n = len(offsets) - 1
                c = count(data, offsets)
                fresh, plain = (np.maximum(0.05, 1 - bad / np.maximum(all_, 1)) for bad, all_ in ((c.n_repeat_words, c.n_words), (c.n_symbols, c.word_chars)))
                yield pa.RecordBatch.from_arrays([*[batch.column(i).slice(row, n) for i in range(4)], pa.array(c.n_words.astype(np.int64)), pa.array(fresh * plain)], ["row", "doc_id", "source", "draw", "size", "quality"])

    own = docs.select("row", F.col("doc_id").cast("long"), F.col("source").cast("string"), F.xxhash64(F.lit(seed), "doc_id", "text").alias("draw"), "text")
    return arrow(own, each, "row long, doc_id long, source string, draw long, size long, quality double")


def running(df: DataFrame, order: list[Column], group: str, value: str, folder: str) -> DataFrame:
    """df, with ``before``: the sum of value over the rows of its group that come earlier. Rows of a group must be neighbours in order."""
    names, kinds = df.columns, ", ".join(f"{n} {t}" for n, t in df.dtypes)
    g, v = names.index(group), names.index(value)

    def each(batches):
        from pyspark import TaskContext

        part, last, total = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            if not len(batch):
                continue
            groups, values = (batch.column(i).to_numpy(zero_copy_only=False) for i in (g, v))
            sums = np.cumsum(values) - values
            start = np.append(True, groups[1:] != groups[:-1])
            base = np.where(start, sums, 0)
            if last is not None and groups[0] == last:
                base[0] -= total
            at = np.maximum.accumulate(np.where(start, np.arange(len(groups)), 0))
            before = sums - base[at]
            last, total = groups[-1], int(before[-1] + values[-1])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(before.astype(np.int64)), pa.array(np.full(len(batch), part, np.int32))], [*names, "before", "part"])

    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    own = table(arrow(ranged, each, f"{kinds}, before long, part int"), folder)
    earlier = Window.partitionBy(group).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row a range and group
    totals = own.groupBy(group, "part").agg(F.max(F.col("before") + F.col(value)).alias("_sum")).withColumn("_earlier", F.coalesce(F.sum("_sum").over(earlier), F.lit(0))).drop("_sum")
    return own.join(totals, [group, "part"]).withColumn("before", F.col("before") + F.col("_earlier")).drop("_earlier", "part")


def targets(sizes: DataFrame, budget: float, most: float) -> DataFrame:
    """sizes (weight, source_size, ...) with target: shares of budget by weight, at most ``most`` times source_size, what is over shared again."""
    own = sizes.withColumn("_cap", F.col("source_size") * F.lit(float(most)))
    total = own.agg(F.sum("weight")).first()[0]
    level, full = budget / total if total else 0.0, -1
    while True:  # sources that are full stay so: as many rounds as there are sources at most, and few in practice
        is_full = F.col("_cap") <= F.lit(level) * F.col("weight")
        now, taken, left = own.agg(F.count_if(is_full), F.coalesce(F.sum(F.when(is_full, F.col("_cap"))), F.lit(0.0)), F.coalesce(F.sum(F.when(~is_full, F.col("weight"))), F.lit(0.0))).first()
        if now == full or not left:
            break
        full, level = now, max(level, (budget - taken) / left)
    return own.withColumn("target", F.least("_cap", F.lit(level) * F.col("weight"))).drop("_cap")


def mix(docs: DataFrame, folder: str, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0, seed: int = 1) -> DataFrame:
    """row, doc_id, source, size, source_size, target (the source's) and taken of each row of docs (doc_id, source, text; row if there).

    Sources by code point, null last, have these weights in turn; together they take ``share`` times all words.
    """
    prepare(docs.sparkSession)
    if "row" not in docs.columns:
        docs = docs.select("doc_id", "source", "text", F.monotonically_increasing_id().alias("row"))
    sized = table(measured(docs, seed), f"{folder}/sized")
    sources = table(sized.groupBy("source").agg(F.sum("size").alias("source_size")).withColumns({"all": F.lit(0), "one": F.lit(1).cast("long")}), f"{folder}/sources")
    numbered = running(sources, [F.col("source").asc_nulls_last()], "all", "one", f"{folder}/numbered").select("source", "source_size", F.col("before").alias("number"))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("number") % len(weights) + 1).cast("int"))
    words_ = sources.agg(F.sum("source_size")).first()[0] or 0
    goals = table(targets(table(numbered.withColumn("weight", weight), f"{folder}/weighted"), share * words_, most), f"{folder}/goals")
    uniform = (F.shiftrightunsigned("draw", 11).cast("double") + 0.5) / float(2**53)
    keyed = sized.join(goals, sized["source"].eqNullSafe(goals["source"])).select("row", "doc_id", sized["source"], "number", "size", "source_size", "target", (-F.log(uniform) / F.col("quality")).alias("key"))
    placed = running(keyed, [F.col("number"), F.col("key"), F.col("row")], "number", "size", f"{folder}/placed")
    wanted = F.floor(F.col("target") + 0.5)
    epochs = F.when(F.col("source_size") > 0, F.floor(wanted / F.greatest(F.col("source_size"), F.lit(1)))).otherwise(0)
    rest = wanted - epochs * F.col("source_size") - F.col("before")
    taken = epochs * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), rest))
    return placed.select("row", "doc_id", "source", "size", "source_size", "target", taken.cast("long").alias("taken"))


def mixed(docs: DataFrame, folder: str, **how) -> DataFrame:
    """The mix itself: a row for each copy of a document, with its columns and ``copy`` (from 0); the last may have the first words only."""
    row, copy = unused(docs, "row"), unused(docs, "copy")
    kept = table(docs.withColumn(row, F.monotonically_increasing_id()), f"{folder}/rows")
    planned = mix(kept.select("doc_id", "source", "text", F.col(row).alias("row")), folder, **how).filter("taken > 0")
    last = F.ceil(F.col("taken") / F.col("size")).cast("int") - 1
    copies = planned.select(F.col("row").alias(row), "taken", "size", F.explode(F.sequence(F.lit(0), last)).alias(copy))
    least = unused(docs, "words_")
    copies = copies.select(row, copy, F.least("size", F.col("taken") - F.col(copy) * F.col("size")).alias(least))
    own = kept.join(copies, row).drop(row).select(*docs.columns, copy, least)
    at, names = own.columns.index("text"), [*docs.columns, copy]

    def each(batches):
        for batch in batches:
            limit = batch.column(len(names)).to_numpy()
            for row, offsets, data in text_slices(batch, "text"):
                n = len(offsets) - 1
                _, ends, first = words(data, offsets)
                end = np.where(limit[row : row + n] < np.diff(first), ends[np.minimum(first[:-1] + limit[row : row + n], len(ends)) - 1], offsets[1:])
                texts = pa.array([data[a:b].tobytes().decode() for a, b in zip(offsets[:-1], end, strict=True)], pa.string())
                yield pa.RecordBatch.from_arrays([texts if i == at else batch.column(i).slice(row, n) for i in range(len(names))], names)

    return arrow(own, each, own.drop(least).schema)
