"""A sink to a remote service as a Spark data source: tasks send, leave receipts in the shared folder, and the driver commits.

A job has a name of its own (a batch id of a stream, say). A task that fails half way has left a receipt of each request that it sent; the task that
is run again in its place, or the whole job under the same name, reads them and goes on after them. What was sent in the one request
whose receipt is missing is asked of the service by content hash (``Target.check_duplicate``); a service that can't tell gets at most that
request twice. Speculative tasks would send side by side, so jobs are refused where ``spark.speculation`` is set.
"""

from __future__ import annotations

import json
import sys
import time
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark import TaskContext, cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from quillspark.shared import filesystem
from quillspark.sources.targets import RESULTS, Rate, Target, batches

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers needn't have this package

NAMES = [x.split()[0] for x in RESULTS.split(", ")]


@dataclass
class Sent(WriterCommitMessage):
    part: int
    sent: int
    known: int


class Sender(DataSourceArrowWriter):
    """Sends the rows of a task that no receipt of its part has; other columns than content_hash are the item."""

    def __init__(self, target: Target, where: str, parallel: int, rate: Rate | None):
        self.target, self.where, self.parallel, self.rate = target, where, parallel, rate

    def result(self, row: dict) -> tuple:
        """What becomes of an item: refused, known to the service, or sent."""
        h = row["content_hash"]
        if (why := self.target.validate(row)) is not None:
            return (h, self.target.name, "failed", None, why)
        if (have := self.target.check_duplicate(h)) is not None:
            return (h, self.target.name, "skipped", have, None)
        return (h, self.target.name, *self.target.sync(h, row))

    def write(self, iterator: Iterator) -> Sent:
        from pyarrow import fs

        part = TaskContext.get().partitionId()
        system, top = fs.FileSystem.from_uri(self.where)
        own, mine, n, sent = f"{top}/part-{part:05d}", uuid.uuid4().hex, 0, 0
        system.create_dir(own, recursive=True)
        known: set[str] = set()
        for info in system.get_file_info(fs.FileSelector(own)):
            if info.path.endswith(".json"):
                with system.open_input_stream(info.path) as f:
                    known |= {json.loads(x)["content_hash"] for x in f.read().splitlines()}
        new = (row for b in iterator for row in b.to_pylist() if row["content_hash"] not in known)
        for request in batches(new, self.rate.batch if self.rate else 1000):
            began = time.monotonic()
            lines = [json.dumps(dict(zip(NAMES, self.result(row), strict=True))) for row in request]
            with system.open_output_stream(f"{own}/{mine}-{n}.part") as f:
                f.write("\n".join(lines).encode())
            system.move(f"{own}/{mine}-{n}.part", f"{own}/{mine}-{n}.json")  # names of an attempt's own, so a move never meets a file
            n, sent = n + 1, sent + len(lines)
            if self.rate:
                time.sleep(max(0.0, self.rate.pause(self.parallel) - (time.monotonic() - began)))
        return Sent(part, sent, len(known))

    def commit(self, messages) -> None:
        from pyarrow import fs

        system, top = fs.FileSystem.from_uri(self.where)
        done = [m for m in messages if m is not None]
        with system.open_output_stream(f"{top}/_committed") as f:
            f.write(json.dumps({"sent": sum(m.sent for m in done), "known": sum(m.known for m in done)}).encode())

    def abort(self, messages) -> None:
        """Receipts stay: what was sent can't be called back, and the job's next run needs them."""


def _source(target: Target, where: str, parallel: int, rate: Rate | None) -> type[DataSource]:
    class Sink(DataSource):
        @classmethod
        def name(cls) -> str:
            return "sync_sink"

        def writer(self, schema, overwrite: bool) -> Sender:
            return Sender(target, where, parallel, rate)

    return Sink


def _committed(spark: SparkSession, uri: str) -> bool:
    system, path = filesystem(spark, f"{uri}/_committed")
    return system.exists(path)


def results(spark: SparkSession, folder: str, job: str = "*") -> DataFrame:
    """One result a content_hash and target of the jobs of a folder, unfinished ones too: a success if there was one."""
    system, path = filesystem(spark, f"{folder}/{job}/part-*/*.json")
    if not system.globStatus(path):
        return spark.createDataFrame([], RESULTS)
    found = spark.read.schema(RESULTS).json(f"{folder}/{job}/part-*/*.json")
    rank = F.struct((F.col("status") == "success").cast("int"), (F.col("status") == "skipped").cast("int"), "external_id", "error")
    best = F.max_by(F.struct("status", "external_id", "error"), rank)
    return found.groupBy("content_hash", "target").agg(best.alias("r")).select("content_hash", "target", "r.*")


def deliver(items: DataFrame, target: Target, folder: str, job: str, parallel: int = 3, rate: Rate | None = None) -> DataFrame:
    """Sends each distinct content_hash of items that no job of the folder has sent with success, and returns the job's results.

    A job that is committed sends nothing; one that isn't goes on. Null hashes aren't sent. Of rows with equal hashes any one is the item. Parallel
    tasks share the rate. Failed items fail for their job and are sent again by jobs of other names.
    """
    spark, where = items.sparkSession, f"{folder}/{job}"
    if spark.conf.get("spark.speculation", "false") == "true":
        raise ValueError("spark.speculation is set: two attempts of a task would send the same items")
    if not _committed(spark, where):
        done = results(spark, folder).filter(F.col("status").isin("success", "skipped") & (F.col("target") == target.name)).select("content_hash")
        new = items.filter("content_hash is not null").dropDuplicates(["content_hash"]).join(done, "content_hash", "left_anti")
        spark.dataSource.register(_source(target, where, parallel, rate))
        new.repartition(parallel, "content_hash").write.format("sync_sink").mode("append").save()
    return results(spark, folder, job)


def deliver_stream(items: DataFrame, target: Target, folder: str, checkpoint: str, parallel: int = 3, rate: Rate | None = None):
    """Starts a query that delivers each micro-batch under its batch id: a batch that is replayed after a stop goes on where it stood."""

    def each(batch: DataFrame, number: int) -> None:
        deliver(batch, target, folder, f"batch-{number:09d}", parallel, rate)

    return items.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def unified(items: DataFrame, target: Target, folder: str, job: str, **how) -> DataFrame:
    """items (item_id, content_hash, and ``same``: whether their last success has this hash) with what became of each: same ones are skipped and not sent."""
    own = items.select("item_id", "content_hash", F.coalesce("same", F.lit(False)).alias("same"))
    deliver(items.filter(~F.coalesce("same", F.lit(False))), target, folder, job, **how)
    sent = results(items.sparkSession, folder).filter(F.col("target") == target.name).select("content_hash", "status", "external_id")
    same = F.col("same")
    return own.join(sent, "content_hash", "left").select("item_id", F.when(same, "skipped").otherwise(F.col("status")).alias("status"), F.when(~same, F.col("external_id")).alias("external_id"))
