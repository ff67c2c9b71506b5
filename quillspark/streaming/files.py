"""File events as a stream: a cooldown for each key, and routing by kind."""

from __future__ import annotations

import sys
from collections.abc import Callable

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from quillspark import shared
from quillspark.sources.listing import listing

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers needn't have this package


def file_events(spark: SparkSession, folder: str, pattern: str = "*.rm", per_trigger: int = 100) -> DataFrame:
    """path and ts of files as they appear; the file source knows no deletions."""
    stream = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", per_trigger)
    return stream.load(folder).select("path", F.col("modificationTime").alias("ts"))


def listed_events(spark: SparkSession, folder: str, pattern: str = "*.rm", per_trigger: int = 1000) -> DataFrame:
    """path and ts of the files that are there now, as a stream over their listing, whose files are counted by ``per_trigger``: the driver sees no file's status.

    For a folder that is caught up with; ``file_events`` follows one in which files appear.
    """
    rows = listing(spark, folder, pattern).select("path", F.col("modificationTime").alias("ts"))
    where = shared.folder(spark, "file-events")
    return spark.readStream.schema(shared.table(rows, where).schema).option("maxFilesPerTrigger", per_trigger).parquet(where)


def passing(times: list[pd.Timestamp], last: pd.Timestamp | None, gap: pd.Timedelta) -> tuple[list[bool], pd.Timestamp | None]:
    """Which of the times in order come ``gap`` or more after the one that passed before, and the last that passed."""
    out = []
    for t in times:
        out.append(last is None or t - last >= gap)
        last = t if out[-1] else last
    return out, last


def cooldown(events: DataFrame, key: str, gap_seconds: float = 5.0, keep_factor: int = 10) -> DataFrame:
    """key and ts of the events of a stream that come ``gap_seconds`` or more after the last one of their key that passed.

    Late events count as they come, against the last that passed. Keys quiet for ``keep_factor`` gaps are forgotten. Null keys are one key.
    """
    gap = pd.Timedelta(seconds=gap_seconds)

    def run(group, parts, state):
        if state.hasTimedOut:
            state.remove()
            return
        rows = pd.concat(list(parts)).sort_values("ts", kind="stable")
        last = pd.Timestamp(state.get[0], unit="us") if state.exists else None
        keep, last = passing([t.tz_localize(None) for t in rows["ts"]], last, gap)
        state.update((last.value // 1000,))
        state.setTimeoutDuration(int(gap_seconds * keep_factor * 1000))
        yield rows.loc[keep, [key, "ts"]]

    schema = f"{key} {events.schema[key].dataType.simpleString()}, ts timestamp"
    return events.select(key, "ts").groupBy(key).applyInPandasWithState(run, schema, "last long", "append", GroupStateTimeout.ProcessingTimeTimeout)


def stored_changes(changes: DataFrame, keys: list[str], at: str, order: str, gap_ms: int = 300_000) -> DataFrame:
    """The changes of a table that are stored: a change within ``gap_ms`` of the last *stored* one of its key isn't. Null keys always are.

    A batch form of the cooldown: partitions in order of key and time, one state for the key at hand, so a hot key costs time, not memory.
    """
    whole = F.lit(True)
    for k in keys:
        whole = whole & F.col(k).isNotNull()
    rows = changes.select(*keys, at, order)
    dealt = rows.filter(whole).repartition(*keys).sortWithinPartitions(*keys, at, order)

    def run(batches):
        current, last = None, None
        for b in batches:
            keep = []
            for *k, t in zip(*[b[c] for c in keys], b[at], strict=True):
                if k != current:
                    current, last = k, None
                keep.append(last is None or t - last > gap_ms)
                last = t if keep[-1] else last
            yield b[keep]

    return dealt.mapInPandas(run, rows.schema).unionByName(rows.filter(~whole))


def route(events: DataFrame, kinds: DataFrame, key: str, to: dict[str, Callable[[DataFrame], None]], checkpoint: str):
    """Starts a query that hands each micro-batch's events to the sinks of their document_type; a type may have several names in ``to`` joined by |."""

    def each(batch: DataFrame, _: int) -> None:
        joined = batch.join(kinds, key).persist()
        try:
            for names, sink in to.items():
                sink(joined.filter(F.col("document_type").isin(names.split("|"))))
        finally:
            joined.unpersist()

    return events.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def catch_up(pending: DataFrame, cap: int = 10, force: bool = False) -> DataFrame:
    """pending if it has at most ``cap`` rows or is forced, else none of it: a guard against a flood at the start."""
    over = pending.limit(cap + 1).count() > cap
    return pending if force or not over else pending.limit(0)


def debounced(events: DataFrame, key: str, quiet_seconds: int = 30, late_seconds: int = 60) -> DataFrame:
    """key, first and last time and number of the events of a burst: one row once the key has been quiet. Works on streams and tables.

    An event that comes ``quiet_seconds`` after the one before begins a burst of its own; Spark joins sessions that touch, so theirs end a microsecond earlier.
    """
    bursts = events.withWatermark("ts", f"{late_seconds} seconds").groupBy(F.session_window("ts", f"{quiet_seconds * 1_000_000 - 1} microseconds"), key)
    return bursts.agg(F.min("ts").alias("first"), F.max("ts").alias("last"), F.count("*").alias("n")).drop("session_window")


def budget(pages: Column) -> Column:
    """Seconds that a notebook may take. Null pages count as none."""
    return F.lit(120) + 150 * F.coalesce(pages, F.lit(0))
