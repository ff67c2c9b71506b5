"""Folder trees as intervals: every row's place in a depth-first walk, and its last descendant's, whatever the depth.

The walk enters and leaves each row once, which makes a list: a row's entry is followed by its first child's, its exit by its next sibling's
entry or its parent's exit. Pointer jumping ranks the list in log2 of its length rounds, each of which joins and writes it. Subtrees are
ranges of places then, so no row carries its ancestors.
"""

from __future__ import annotations

from itertools import count

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.shared import table


def _siblings(nodes: DataFrame, order: list[str], folder: str) -> DataFrame:
    """uuid, up, and the next sibling's uuid by order; ``first`` marks first ones. Ranges of rows, so that a folder with many rows is many tasks'."""
    parts = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = table(nodes.repartitionByRange(parts, "up", *order, "uuid").withColumn("part", F.spark_partition_id()), f"{folder}/sorted")
    within = Window.partitionBy("part").orderBy("up", *order, "uuid")
    own = dealt.select("uuid", "up", "part", F.lead(F.struct("up", "uuid")).over(within).alias("after"), F.lag(F.struct("up")).over(within).alias("before"), F.row_number().over(within).alias("n"))
    place = F.struct("up", *order, "uuid")
    ends = dealt.groupBy("part").agg(F.min_by(F.struct("up", "uuid"), place).alias("head"), F.max_by(F.struct("up"), place).alias("tail"))  # a row a part
    by_part = Window.orderBy("part")
    ends = ends.select("part", F.lead("head").over(by_part).alias("next_head"), F.lag("tail").over(by_part).alias("last_tail"))
    own = own.join(F.broadcast(ends), "part")
    after, before = F.coalesce("after", "next_head"), F.coalesce("before", "last_tail")
    return own.select("uuid", "up", F.when(after["up"].eqNullSafe(F.col("up")), after["uuid"]).alias("sibling"), (before.isNull() | ~before["up"].eqNullSafe(F.col("up"))).alias("first"))


def intervals(nodes: DataFrame, folder: str, order: Column | None = None, tops_last: Column | None = None) -> DataFrame:
    """nodes (uuid, parent, name) with place (from 0), last (place of the last descendant, its own where it has none) and depth (from 0).

    Siblings are in ``order`` (by default lower(name)), then by uuid. Rows whose parent is null or no node are tops; those for which ``tops_last`` is
    true come after the others. Rows on or below a cycle have no top and no row. uuids are distinct, and null ones have no row.
    """
    own = nodes.filter("uuid is not null")
    known = own.select(F.col("uuid").alias("there"))
    own = own.join(known, F.col("parent") == F.col("there"), "left")
    top = F.col("there").isNull()
    late = F.coalesce(tops_last, F.lit(False)) if tops_last is not None else F.lit(False)
    own = own.withColumn("up", F.col("there")).withColumn("late", top & late).withColumn("key", F.lower("name") if order is None else order).drop("there")
    own = table(own, f"{folder}/nodes")
    linked = table(_siblings(own.select("uuid", "up", "late", "key"), ["late", "key"], folder), f"{folder}/siblings")
    child = linked.filter("first and up is not null").select(F.col("up").alias("of"), F.col("uuid").alias("child"))
    enter = linked.join(child, F.col("uuid") == F.col("of"), "left").select("uuid", F.lit(True).alias("enter"), F.coalesce("child", "uuid").alias("to"), F.col("child").isNotNull().alias("to_enter"))
    leave = linked.select("uuid", F.lit(False).alias("enter"), F.coalesce("sibling", "up").alias("to"), F.col("sibling").isNotNull().alias("to_enter"))
    # enters and depth are summed from a row of the list to the one that it points to, exclusive
    state = enter.unionByName(leave).select("uuid", "enter", "to", "to_enter", F.when(F.col("enter"), 1).otherwise(0).cast("long").alias("enters"), F.when(F.col("enter"), 1).otherwise(-1).cast("long").alias("deep"))
    left = None
    for number in count():
        state = table(state, f"{folder}/round-{number}")
        before, left = left, state.filter("to is not null").count()
        if not left or left == before:  # some row reaches the end in every round, but for those of cycles
            break
        ahead = state.select(F.col("uuid").alias("u"), F.col("enter").alias("e"), F.col("to").alias("t"), F.col("to_enter").alias("te"), F.col("enters").alias("n"), F.col("deep").alias("d"))
        state = state.join(ahead, (F.col("to") == F.col("u")) & (F.col("to_enter") == F.col("e")), "left")
        state = state.select("uuid", "enter", F.col("t").alias("to"), F.col("te").alias("to_enter"), (F.col("enters") + F.coalesce("n", F.lit(0))).alias("enters"), (F.col("deep") + F.coalesce("d", F.lit(0))).alias("deep"))
    ranked = state.filter("to is null")
    total = ranked.agg(F.coalesce(F.max("enters"), F.lit(0)).alias("total"))
    both = ranked.groupBy("uuid").agg(F.max(F.when(F.col("enter"), F.col("enters"))).alias("from_here"), F.max(F.when(~F.col("enter"), F.col("enters"))).alias("beyond"), F.max(F.when(F.col("enter"), -F.col("deep"))).alias("depth"))
    placed = both.join(F.broadcast(total)).select("uuid", (F.col("total") - F.col("from_here")).alias("place"), (F.col("total") - F.col("beyond") - 1).alias("last"), "depth")  # one row
    return own.drop("up", "late", "key").join(placed, "uuid")


def below(tree: DataFrame, roots: DataFrame) -> DataFrame:
    """The rows of a tree of intervals in the subtrees of roots (uuid), themselves included, each once: places where more subtrees began than ended.

    Begins and ends are summed up by ranges of places, so neither a join of ranges nor one task with all rows is needed.
    """
    parts = int(tree.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spans = tree.join(roots.select("uuid").distinct(), "uuid", "left_semi").select("place", "last")
    ends = spans.select(F.col("place").alias("at"), F.lit(1).alias("n")).unionByName(spans.select((F.col("last") + 1).alias("at"), F.lit(-1).alias("n")))
    size = tree.agg((F.coalesce(F.max("place"), F.lit(0)) / parts + 1).cast("long").alias("size"))
    own = tree.join(ends.groupBy("at").agg(F.sum("n").alias("n")), F.col("place") == F.col("at"), "left").withColumn("n", F.coalesce("n", F.lit(0)))
    own = own.join(F.broadcast(size)).withColumn("part", F.floor(F.col("place") / F.col("size")))  # size is one row
    sums = own.groupBy("part").agg(F.sum("n").alias("s")).select("part", (F.sum("s").over(Window.orderBy("part")) - F.col("s")).alias("base"))  # a row a part
    began = F.sum("n").over(Window.partitionBy("part").orderBy("place")) + F.col("base")
    return own.join(F.broadcast(sums), "part").withColumn("open", began).filter("open > 0").select(*tree.columns)
