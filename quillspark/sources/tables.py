"""Tables that change: each change writes a new version as Parquet, and a reader takes the newest whole one.

Changes are joins and unions over the current version, so they run as plans and never update a row in place. A version is whole once
Spark has committed it (``_SUCCESS``); a job that fails leaves the version before.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.shared import filesystem


class VersionedTable:
    """Null keys are values like others. Column names of changes must be the table's."""

    def __init__(self, spark: SparkSession, folder: str, key: list[str], schema: str):
        self.spark, self.folder, self.key, self.schema = spark, folder, key, schema

    def version(self) -> int:
        system, path = filesystem(self.spark, self.folder)
        if not system.exists(path):
            return 0
        names = [(x.getPath().getName(), x.getPath().toString()) for x in system.listStatus(path)]
        done = [int(n[2:]) for n, p in names if n.startswith("v-") and system.exists(filesystem(self.spark, f"{p}/_SUCCESS")[1])]
        return max(done, default=0)

    def read(self) -> DataFrame:
        number = self.version()
        if not number:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(f"{self.folder}/v-{number:06d}")

    def overwrite(self, rows: DataFrame) -> None:
        rows.select(*self.read().columns).write.mode("overwrite").parquet(f"{self.folder}/v-{self.version() + 1:06d}")

    def append(self, rows: DataFrame) -> None:
        self.overwrite(self.read().unionByName(rows))

    def _one(self, rows: DataFrame, order: tuple[Column, ...], last: bool) -> DataFrame:
        """One row of each key: the first or last by order; summed before the shuffle."""
        best = (F.max_by if last else F.min_by)(F.struct(*rows.columns), F.struct(*order))
        return rows.groupBy(*self.key).agg(best.alias("r")).select("r.*")

    def _without(self, keys: DataFrame, on: list[str]) -> DataFrame:
        own, other = self.read(), keys.select(*[F.col(c).alias(f"__{c}") for c in on]).distinct()
        same = F.lit(True)
        for c in on:
            same = same & F.col(c).eqNullSafe(F.col(f"__{c}"))
        return own.join(other, same, "left_anti")

    def insert_or_ignore(self, rows: DataFrame, *order: Column) -> None:
        """Rows whose key is new; of several, the first by order."""
        own = self.read().select(*[F.col(c).alias(f"__{c}") for c in self.key])
        same = F.lit(True)
        for c in self.key:
            same = same & F.col(c).eqNullSafe(F.col(f"__{c}"))
        self.append(self._one(rows, order, last=False).join(own, same, "left_anti"))

    def upsert(self, rows: DataFrame, *order: Column) -> None:
        """Rows replace those with their key; of several, the last by order stays."""
        new = self._one(rows, order, last=True)
        self.overwrite(self._without(new, self.key).unionByName(new))

    def replace_partition(self, rows: DataFrame, by: list[str]) -> None:
        """All rows with the values that rows has in ``by`` go, and rows come."""
        self.overwrite(self._without(rows, by).unionByName(rows))

    def update(self, where: Column, **values: Column) -> None:
        self.overwrite(self.read().select(*[F.when(where, values[c]).otherwise(F.col(c)).alias(c) if c in values else F.col(c) for c in self.read().columns]))

    def delete(self, where: Column) -> None:
        """Rows for which it is null stay."""
        self.overwrite(self.read().filter(~F.coalesce(where, F.lit(False))))

    def cascade(self, parents: DataFrame, child: str, parent: str) -> None:
        """Rows whose parent isn't there go; null has none."""
        own = parents.select(F.col(parent).alias("__parent")).distinct()
        self.overwrite(self.read().join(own, F.col(child) == F.col("__parent"), "left_semi").unionByName(self.read().filter(F.col(child).isNull())))
