"""Events that come a while after the last of their key that passed, in order of event time, as keyed state of a stream.

A micro-batch's rows are held in state until the watermark has passed them, and then judged in order of time, so the result doesn't depend on how
rows fall into micro-batches: it is that of the same rows in one table. Timers of event time wake a key when its next row is due, and once more when
it has been quiet for long, to forget it. State lives in RocksDB and is restored from the query's checkpoint.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from quillspark.shared import folder

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers needn't have this package

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Spaced(StatefulProcessor):
    """gap_us: microseconds that must have gone since the last row that passed; strict: and more. keep_us: quiet time after which a key is forgotten."""

    def __init__(self, keys: list[str], gap_us: int, strict: bool, keep_us: int):
        self.keys, self.gap, self.keep = keys, gap_us + strict, keep_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "at long")
        self.held = handle.getListState("held", "at long, tie long")

    def _wake(self, us: int) -> None:
        self.handle.registerTimer(-(-us // 1000))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new = [x for b in rows for x in zip(b.iloc[:, -2].tolist(), b.iloc[:, -1].tolist(), strict=True)]
        if not self.held.exists():
            self._wake(min(new)[0])
        else:
            first = min(x[0] for x in self.held.get())
            if min(new)[0] < first:
                self._wake(min(new)[0])
        self.held.appendList(new)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        until = timerValues.getCurrentWatermarkInMs() * 1000
        held = sorted(self.held.get()) if self.held.exists() else []
        last = self.last.get()[0] if self.last.exists() else None
        due, out = [x for x in held if x[0] <= until], []
        for at, tie in due:
            if last is None or at - last >= self.gap:
                last = at
                out.append((*key, at, tie))
        if due:
            self.held.clear()
            if held[len(due) :]:
                self.held.put(held[len(due) :])
                self._wake(held[len(due)][0])
            self.last.update((last,))
            self._wake(last + self.keep)
        elif not held and last is not None and last + self.keep <= until:
            self.last.clear()
        if out:
            yield pd.DataFrame(out, columns=[*self.keys, "at_us", "tie_no"])

    def close(self) -> None:
        pass


def spaced(events: DataFrame, keys: list[str], at: str, tie: str, gap_us: int, strict: bool = False, late: str = "1 hour", keep_factor: int = 10) -> DataFrame:
    """keys, at and tie of the rows of a stream (at: timestamp, tie: long) that come ``gap_us`` or more (strict: more) after the last one of their key that passed; the first of a key passes.

    Rows of one time are in order of tie. Rows that are later than the watermark (``late``) are dropped; so are rows with a null time; null keys are keys
    like others. Keys quiet for ``keep_factor`` gaps are forgotten, which changes nothing, as their next row passes in any case.
    """
    spark = events.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    own = events.filter(F.col(at).isNotNull()).withWatermark(at, late).select(*keys, at, F.unix_micros(at).alias("at_us"), F.col(tie).cast("long").alias("tie_no"))
    schema = T.StructType([*[events.schema[k] for k in keys], T.StructField("at_us", T.LongType()), T.StructField("tie_no", T.LongType())])
    done = own.groupBy(*keys).transformWithStateInPandas(Spaced(keys, gap_us, strict, gap_us * max(1, keep_factor)), schema, "append", "EventTime")
    return done.select(*keys, F.timestamp_micros("at_us").alias(at), F.col("tie_no").alias(tie))


def apart(events: DataFrame, keys: list[str], at: str, tie: str, gap_us: int, strict: bool = False, late: str = "1 hour") -> DataFrame:
    """What ``spaced`` returns, by session windows without Python: for many keys, where a row may wait until its key has been quiet for the gap.

    A row that comes the gap after the one before passes whatever passed earlier, so only the rows of one session decide on each other. State holds open sessions.
    """
    gap = gap_us + strict
    row = F.struct(F.unix_micros(at).alias("at_us"), F.col(tie).cast("long").alias("tie_no"))
    own = events.filter(F.col(at).isNotNull()).withWatermark(at, late).select(*keys, at, row.alias("_row"))
    rows = own.groupBy(F.session_window(at, f"{gap} microseconds").alias("_session"), *keys).agg(F.array_sort(F.collect_list("_row")).alias("_rows"))
    later = F.expr(f"aggregate(_rows, slice(_rows, 1, 1), (a, r) -> if(r.at_us - element_at(a, -1).at_us >= {gap}, concat(a, array(r)), a))")
    return rows.select(*keys, F.explode(F.when(F.size("_rows") == 1, F.col("_rows")).otherwise(later)).alias("_row")).select(*keys, F.timestamp_micros("_row.at_us").alias(at), F.col("_row.tie_no").alias(tie))


def replayed(spark: SparkSession, rows: DataFrame, at: str, run, gap_us: int, batches: int = 4) -> DataFrame:
    """What run(stream, late) gives for the rows as a stream of several micro-batches, and a last row that moves the watermark beyond them.

    Rows fall into micro-batches in any order, so late is the time from the first row to the last, whatever that is.
    """
    where, tasks = folder(spark, "replay"), spark.sparkContext.defaultParallelism
    rows.repartition(batches * tasks).write.parquet(f"{where}/in")
    own = spark.read.schema(rows.schema).parquet(f"{where}/in")
    first, last = own.agg(F.unix_micros(F.min(at)), F.unix_micros(F.max(at))).first()  # one row
    late = 1 + ((last or 0) - (first or 0)) // 1_000_000
    end = F.timestamp_micros(F.lit((last or 0) + (late + 86_400) * 1_000_000 + 10 * gap_us))
    nulls = [F.lit(None).cast(f.dataType).alias(f.name) if f.name != at else end.alias(at) for f in rows.schema]

    def step() -> None:
        stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", tasks).parquet(f"{where}/in")
        run(stream, f"{late} seconds").writeStream.format("parquet").option("path", f"{where}/out").option("checkpointLocation", f"{where}/state").trigger(availableNow=True).start().awaitTermination()

    step()
    if last is not None:
        spark.range(1).select(*nulls).write.mode("append").parquet(f"{where}/in")
        step()  # starts again from the checkpoint
    return spark.read.schema(run(spark.readStream.schema(rows.schema).parquet(f"{where}/in"), f"{late} seconds").schema).parquet(f"{where}/out")
