"""Hilbert-curve ordering of documents, cut into shards of near equal row counts.

Each dimension is quantised by its own quantiles into 2^bits cells (strings by the 7 bytes after those that all have in common, whose order
is the strings'), the cells give an index on a Hilbert curve, and rows are range-partitioned and sorted by it. A shard is a
run of ranks, so its files span a small box of every dimension, which minimum and maximum statistics can prune. Whole rows
are shuffled once and written sorted; ranks come from counts of partitions, and a second pass writes the shards, a folder of
Parquet files each, with all columns of the documents. What is returned is computed from these files.

Nulls fall into the lowest cell. Ties on the curve are ordered by text checksum, doc_id and size; repeated rows get
ranks of their own. An empty table gives no rows. Texts of any length are moved with their rows. The documents' other columns are kept;
where they have the name of curve, shard or slot, these get underscores.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import buckets, release, remove, table


def is_text(df: DataFrame, column: str) -> bool:
    return df.schema[column].dataType.typeName() == "string"


def common(df: DataFrame, columns: list[str]) -> dict[str, int]:
    """How many bytes all of a string column's values start with: those that the least and the greatest have in common."""
    texts = [c for c in columns if is_text(df, c)]
    if not texts:
        return {}
    ends = df.agg(*[f(F.encode(F.col(c), "UTF-8")) for c in texts for f in (F.min, F.max)]).first()
    pairs = {c: (bytes(ends[2 * i] or b""), bytes(ends[2 * i + 1] or b"")) for i, c in enumerate(texts)}
    return {c: next((k for k, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b))) for c, (a, b) in pairs.items()}


def ordinal(df: DataFrame, column: str, skip: int = 0) -> Column:
    """A long in the order of the column's values; of strings, as far as the 7 bytes after the first ``skip`` tell."""
    if is_text(df, column):
        return F.conv(F.rpad(F.hex(F.substring(F.encode(F.col(column), "UTF-8"), skip + 1, 7)), 14, "0"), 16, 10).cast("long")
    return F.col(column).cast("long")


def cell(column: str, bounds: list[int], bits: int) -> Column:
    """How many of the bounds the value reaches, spread over all cells, so that a dimension of few values counts like others; 0 for null."""
    reached = F.filter(F.array(*[F.lit(v).cast("long") for v in bounds]), lambda v: F.col(column) >= v)
    return F.when(F.col(column).isNull() | F.lit(not bounds), 0).otherwise(F.floor(F.array_size(reached) * (2**bits - 1) / max(len(bounds), 1))).cast("long")


def hilbert(cells: list[Column], bits: int) -> Column:
    """The index on the curve of as many bits a dimension: axes are turned to the transposed index, whose bits are interleaved.

    Written as one SQL fold over the bits, so that expressions don't double with each step.
    """
    n = len(cells)
    x = F.array(*cells)

    def turned(state: Column, q: Column) -> Column:
        low = q - 1

        def axis(s: Column, i: Column) -> Column:
            first, own = F.get(s, F.lit(0)), F.get(s, i)
            swap = F.when(own.bitwiseAND(q) != 0, F.lit(0).cast("long")).otherwise(first.bitwiseXOR(own).bitwiseAND(low))
            head = F.when(own.bitwiseAND(q) != 0, first.bitwiseXOR(low)).otherwise(first.bitwiseXOR(swap))
            return F.transform(s, lambda v, k: F.when(k == 0, head).when(k == i, v.bitwiseXOR(swap)).otherwise(v))

        return F.aggregate(F.sequence(F.lit(0), F.lit(n - 1)), state, axis)

    high = F.array(*[F.lit(1 << b).cast("long") for b in range(bits - 1, 0, -1)]) if bits > 1 else F.array().cast("array<long>")
    x = F.aggregate(high, x, turned)
    x = F.aggregate(F.sequence(F.lit(1), F.lit(n - 1)), x, lambda s, i: F.transform(s, lambda v, k: F.when(k == i, v.bitwiseXOR(F.get(s, i - 1))).otherwise(v))) if n > 1 else x

    def turn(x: Column) -> Column:
        last = F.get(x, F.lit(n - 1))
        return reduce(lambda a, b: a.bitwiseXOR(F.when(last.bitwiseAND(F.lit(1 << b)) != 0, F.lit((1 << b) - 1).cast("long")).otherwise(F.lit(0).cast("long"))), range(bits - 1, 0, -1), F.lit(0).cast("long"))

    def interleaved(y: Column) -> Column:
        return F.aggregate(F.array(*[F.lit(b) for b in range(bits - 1, -1, -1)]), F.lit(0).cast("long"), lambda acc, b: F.aggregate(y, acc, lambda a, v: F.shiftleft(a, 1).bitwiseOR(F.call_function("shiftright", v, b).bitwiseAND(F.lit(1)))))

    return once(x, lambda x: once(turn(x), lambda t: once(F.transform(x, lambda v: v.bitwiseXOR(t)), interleaved)))


def once(value: Column, body) -> Column:
    """body(value), with value evaluated once however often body names it."""
    return F.get(F.transform(F.array(value), lambda v: body(v)), F.lit(0))


def hilbert_shards(docs: DataFrame, dimensions: list[str], folder: str, shards: int = 16, bits: int = 5) -> DataFrame:
    """Writes the shards; doc_id, size, text_crc32, curve, shard, slot of every row in their files. Shards' counts differ by one at most."""
    rows, names = write_shards(docs, dimensions, folder, shards, bits)
    return rows.select(F.col("doc_id").cast("long"), size(), crc(), *[F.col(own).alias(name) for name, own in names.items()])


def size() -> Column:
    return (F.octet_length(F.coalesce("text", F.lit(""))).cast("long") + 1).alias("size")


def crc() -> Column:
    return F.crc32(F.encode(F.coalesce("text", F.lit("")), "UTF-8")).alias("text_crc32")


def write_shards(docs: DataFrame, dimensions: list[str], folder: str, shards: int, bits: int) -> tuple[DataFrame, dict[str, str]]:
    """The documents read back from a folder of Parquet files a shard, in curve order, and the names there of curve, shard and slot."""
    spark, taken, names = docs.sparkSession, {c.lower() for c in docs.columns}, {}
    for name in ("curve", "shard", "slot"):
        names[name] = name
        while names[name] in taken:
            names[name] += "_"
    steps = [k / 2**bits for k in range(1, 2**bits)]
    at = [f"at_{i}" for i in range(len(dimensions))]
    skip = common(docs, dimensions)
    ordinals = [ordinal(docs, c, skip.get(c, 0)).alias(a) for c, a in zip(dimensions, at, strict=True)]
    bounds = docs.select(*ordinals).agg(*[F.percentile_approx(c, steps, 10_000).alias(c) for c in at]).first()  # 2^bits - 1 longs a dimension
    cells = [cell(c, sorted(set(bounds[c] or [])), bits) for c in at]
    # the place in the input parts repeated rows; it also keeps the optimizer from putting the ordinals into the cells
    rows = docs.select(F.struct(*docs.columns).alias("doc"), F.col("doc_id").cast("long").alias("doc_id"), size(), crc(), *ordinals, F.monotonically_increasing_id().alias("place"))
    order = ["curve", "text_crc32", "doc_id", "size", "place"]
    rows = rows.select("doc", hilbert(cells, bits).alias("curve"), *order[1:])
    ranked = rows.repartitionByRange(buckets(spark), *order).sortWithinPartitions(*order).select("doc", "curve", F.monotonically_increasing_id().alias("row"))
    ranked = table(ranked.withColumn("part", F.shiftright("row", 33).cast("int")), f"{folder}/ranked")
    release(spark)
    counts = sorted(map(tuple, ranked.groupBy("part").agg(F.count("*").alias("n")).collect()))  # one row a partition
    total, firsts = 0, []
    for part, n in counts:
        firsts.append((part, total))
        total += n
    first = F.broadcast(spark.createDataFrame(firsts, "part int, first long"))  # one row a partition
    rank = F.col("first") + F.col("row").bitwiseAND(F.lit((1 << 33) - 1))
    ranked = ranked.join(first, "part").withColumn("rank", rank)
    ranked = ranked.withColumn("shard", F.expr(f"int(rank * {shards} div {max(total, 1)})")).withColumn("slot", F.expr(f"rank - (shard * {total} + {shards - 1}) div {shards}"))
    whole = ranked.select(*[F.col("doc")[c].alias(c) for c in docs.columns], *[F.col(name).alias(own) for name, own in names.items()])
    whole.sortWithinPartitions(names["shard"], names["slot"]).write.mode("overwrite").partitionBy(names["shard"]).parquet(f"{folder}/shards")
    remove(f"{folder}/ranked")
    return spark.read.schema(whole.schema).parquet(f"{folder}/shards"), names
