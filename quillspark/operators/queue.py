"""Pending changes admitted in order, a few at a time, to what handles them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspark.shared import filesystem, table


def admit(pending: DataFrame, order: list[str], folder: str, size: int = 10) -> DataFrame:
    """pending with place (from 0, by order) and batch: place / size. Order must tell all rows apart. Written, so that a place stays.

    Ranges of the order are sorted apart and numbered from the sum of the ranges before, so no task has all rows.
    """
    parts = int(pending.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = table(pending.repartitionByRange(parts, *order).withColumn("part", F.spark_partition_id()), f"{folder}/dealt")
    sizes = dealt.groupBy("part").agg(F.count("*").alias("n"))  # a row a part
    before = sizes.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    place = F.row_number().over(Window.partitionBy("part").orderBy(*order)) - 1 + F.col("before")
    own = dealt.join(F.broadcast(before), "part").withColumn("place", place).drop("part", "before")
    return table(own.withColumn("batch", F.floor(F.col("place") / size)), f"{folder}/admitted")


def drain(admitted: DataFrame, folder: str, handle: Callable[[DataFrame, int], None], most: int | None = None) -> int:
    """Hands the batches that aren't done to handle(rows, number) in order, at most ``most`` of them now; how many it handed out.

    A batch is done when handle returns. One that was stopped is handed out again under its number, which a sink may name its job by.
    """
    spark = admitted.sparkSession
    last = admitted.agg(F.max("batch")).first()[0]
    system, path = filesystem(spark, f"{folder}/done")
    done = max((int(x.getPath().getName()) for x in system.listStatus(path)), default=-1) if system.exists(path) else -1
    end = -1 if last is None else last if most is None else min(last, done + most)
    for number in range(done + 1, end + 1):
        handle(admitted.filter(F.col("batch") == number).orderBy("place"), number)
        system.create(filesystem(spark, f"{folder}/done/{number}")[1], True).close()
    return max(0, end - done)
