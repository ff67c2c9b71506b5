"""A table as a log of its changes: a batch writes as many rows as it changes, and a reader takes the last row of each key.

Batches lie in folders ``at=<twice their number>/bucket=<hash of the key>``, so the rows of some keys are read from their buckets alone.
``compact`` writes the rows that hold after a batch into the odd folder after it; older ones are no longer read. A folder counts once Spark has
committed it (``_SUCCESS``), and a batch that is written again replaces itself, so a writer that is stopped starts its batch anew. One writer at a time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark.shared import filesystem, remove


class ChangeLog:
    """Null keys are keys like others. Batches have ascending numbers from 0. schema: the columns, key among them; none named at, bucket or gone."""

    def __init__(self, spark: SparkSession, folder: str, key: list[str], schema: T.StructType | str, buckets: int = 64):
        self.schema = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
        self.spark, self.folder, self.key, self.buckets = spark, folder, key, buckets
        self.columns = [f.name for f in self.schema]
        if not set(key) <= set(self.columns) or {"at", "bucket", "gone"} & set(self.columns):
            raise ValueError(f"not the columns of a log with key {key}: {self.columns}")

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.key), F.lit(self.buckets)).cast("int")

    def _places(self, before: int | None) -> list[int]:
        """The newest whole compaction and the whole batches after it, of those before batch ``before``."""
        system, path = filesystem(self.spark, self.folder)
        if not system.exists(path):
            return []
        found = [x.getPath() for x in system.listStatus(path) if x.getPath().getName().startswith("at=")]
        numbers = sorted(int(p.getName()[3:]) for p in found if system.exists(filesystem(self.spark, f"{p.toString()}/_SUCCESS")[1]))
        numbers = [n for n in numbers if before is None or n < 2 * before]
        base = max((n for n in numbers if n % 2), default=-1)
        return [n for n in numbers if n >= base]

    def last(self) -> int:
        """The newest whole batch, -1 where there is none."""
        return max(self._places(None), default=-2) // 2

    def _rows(self, before: int | None) -> DataFrame:
        schema = T.StructType([*self.schema.fields, T.StructField("gone", T.BooleanType()), T.StructField("at", T.LongType()), T.StructField("bucket", T.IntegerType())])
        places = self._places(before)
        if not places:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).option("basePath", self.folder).parquet(*[f"{self.folder}/at={n}" for n in places])

    def _last(self, rows: DataFrame) -> DataFrame:
        last = F.max_by(F.struct(*self.columns, "gone"), "at")
        return rows.groupBy("bucket", *self.key).agg(last.alias("r")).select("r.*").filter("not gone").drop("gone")

    def _write(self, rows: DataFrame, place: int) -> None:
        dealt = rows.withColumn("bucket", self._bucket()).select(*self.columns, "gone", "bucket")
        dealt.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.folder}/at={place}")

    def put(self, rows: DataFrame, batch: int, *order: Column, gone: Column | None = None) -> None:
        """Rows replace those with their key; of several of one key, the last by order. Where ``gone`` is true, the key's row goes."""
        own = rows.withColumn("gone", F.coalesce(gone, F.lit(False)) if gone is not None else F.lit(False)).select(*[F.col(f.name).cast(f.dataType) for f in self.schema], "gone", *[o.alias(f"__o{i}") for i, o in enumerate(order)])
        if order:
            best = F.max_by(F.struct(*self.columns, "gone"), F.struct(*[f"__o{i}" for i in range(len(order))]))
            own = own.groupBy(*self.key).agg(best.alias("r")).select("r.*")
        self._write(own, 2 * batch)

    def view(self, before: int | None = None) -> DataFrame:
        """The rows that hold, after all batches or after those before one."""
        return self._last(self._rows(before))

    def of(self, keys: DataFrame, before: int | None = None) -> DataFrame:
        """Those of some keys: only their buckets are read, whose numbers the driver knows."""
        wanted = keys.select(*self.key).distinct()
        touched = [r[0] for r in wanted.select(self._bucket()).distinct().collect()]  # no more than there are buckets
        own = self._rows(before).filter(F.col("bucket").isin(touched)) if touched else self._rows(before).limit(0)
        same = F.lit(True)
        for c in self.key:
            same = same & own[c].eqNullSafe(F.col(f"__{c}"))
        return self._last(own.join(wanted.select(*[F.col(c).alias(f"__{c}") for c in self.key]), same, "left_semi"))

    def compact(self, batch: int) -> None:
        """Writes what holds after a batch in one folder, and deletes the folders before it."""
        old = [n for n in self._places(batch + 1) if n <= 2 * batch]
        self._write(self.view(batch + 1).withColumn("gone", F.lit(False)), 2 * batch + 1)
        for n in old:
            remove(self.spark, f"{self.folder}/at={n}")
