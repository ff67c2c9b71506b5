"""What changes in a folder between scans: files created, modified, deleted and renamed, which a file stream can't tell.

A scan lists the folder by Spark and joins it with the files known before, which a log holds. Only files that are new or look changed are read, for
their SHA-256. The changes are written before the log is, so a scan that is stopped between goes on with the changes that it wrote. The folders of changes
are a stream's source: each is written once. Empty files aren't seen, as in Spark's source: a file that becomes empty is deleted.
"""

from __future__ import annotations

import hashlib
import sys

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark.shared import filesystem, table
from quillspark.sources.listing import listing, tasks
from quillspark.sources.log import ChangeLog

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers needn't have this package

FILES = "path string, length bigint, modified_ms bigint, hash string"
CHANGES = f"kind string, old_path string, {FILES}"


def digest(path: str) -> str | None:
    """SHA-256 of a file, read by blocks; null if it went meanwhile."""
    from pyarrow import fs

    if path.startswith("file:"):  # as the listing writes it, not escaped
        system, own = fs.LocalFileSystem(), f"/{path.removeprefix('file:').lstrip('/')}"
    else:
        system, own = fs.FileSystem.from_uri(path)
    found = hashlib.sha256()
    try:
        with system.open_input_stream(own) as f:
            while block := f.read(1 << 22):
                found.update(block)
    except FileNotFoundError:
        return None
    return found.hexdigest()


def with_digest(files: DataFrame) -> DataFrame:
    """files (path and others) with the hash of each, dealt to all tasks."""

    def run(batches):
        import pyarrow as pa

        for b in batches:
            yield b.append_column("hash", pa.array([digest(p) for p in b["path"].to_pylist()], pa.string()))

    return files.repartition(tasks(files.sparkSession)).mapInArrow(run, T.StructType([*files.schema.fields, T.StructField("hash", T.StringType())]))


class Watch:
    """state: a folder for the log and the changes. pattern: names that are looked at, in all folders below."""

    def __init__(self, spark: SparkSession, folder: str, state: str, pattern: str = "*.rm", buckets: int = 64):
        self.spark, self.folder, self.state, self.pattern = spark, folder, state, pattern
        self.known = ChangeLog(spark, f"{state}/known", ["path"], FILES, buckets)

    def _listing(self) -> DataFrame:
        found = listing(self.spark, self.folder, self.pattern)
        return found.select("path", "length", F.unix_millis("modificationTime").alias("modified_ms"))

    def _whole(self, uri: str) -> bool:
        system, path = filesystem(self.spark, f"{uri}/_SUCCESS")
        return system.exists(path)

    def _diff(self, number: int) -> DataFrame:
        own = f"{self.state}/work-{number}"
        was = self.known.view(number).select(F.col("path").alias("old"), F.col("length").alias("old_length"), F.col("modified_ms").alias("old_ms"), F.col("hash").alias("old_hash"))
        both = self._listing().join(was, F.col("path") == F.col("old"), "full")
        both = table(both.filter("old is null or path is null or length <> old_length or modified_ms <> old_ms"), f"{own}/both")
        there = table(with_digest(both.filter("path is not null")).filter("hash is not null"), f"{own}/hashed")
        gone = both.filter("path is null")
        new = there.filter("old is null")
        # a file that went and one that came are one that was renamed if no others have their content
        once = lambda rows, h, p: rows.groupBy(F.col(h).alias("h")).agg(F.count("*").alias("n"), F.min(p).alias(p)).filter("n = 1").drop("n")
        moved = table(once(gone, "old_hash", "old").join(once(new, "hash", "path"), "h").select(F.col("old").alias("old_path"), F.col("path").alias("new_path")), f"{own}/moved")
        created = new.drop("old").join(moved, F.col("path") == F.col("new_path"), "left").select(F.when(F.col("old_path").isNull(), "created").otherwise("renamed").alias("kind"), "old_path", "path", "length", "modified_ms", "hash")
        changed = there.filter("old is not null").select(F.when(F.col("hash") == F.col("old_hash"), "touched").otherwise("modified").alias("kind"), F.lit(None).cast("string").alias("old_path"), "path", "length", "modified_ms", "hash")
        deleted = gone.join(moved, F.col("old") == F.col("old_path"), "left_anti").select(F.lit("deleted").alias("kind"), F.lit(None).cast("string").alias("old_path"), F.col("old").alias("path"), F.col("old_length").alias("length"), F.col("old_ms").alias("modified_ms"), F.col("old_hash").alias("hash"))
        return created.unionByName(changed).unionByName(deleted)

    def scan(self) -> int:
        """Looks at the folder once; the scan's number, from 0."""
        number = self.known.last() + 1
        where = f"{self.state}/changes/scan={number}"
        if not self._whole(where):
            self._diff(number).write.mode("overwrite").parquet(where)
        found = self.changes(number, True)
        there = found.select(*[x.split()[0] for x in FILES.split(", ")], (F.col("kind") == "deleted").alias("out"))
        left = found.filter("kind = 'renamed'").select(F.col("old_path").alias("path"), "length", "modified_ms", "hash", F.lit(True).alias("out"))
        self.known.put(there.unionByName(left), number, F.col("out").cast("int") * -1, gone=F.col("out"))
        return number

    def changes(self, number: int, touched: bool = False) -> DataFrame:
        """kind, old_path (of renamed ones) and the file; of those touched only, content as before, if asked."""
        found = self.spark.read.schema(CHANGES).parquet(f"{self.state}/changes/scan={number}")
        return found if touched else found.filter("kind <> 'touched'")

    def stream(self, per_trigger: int = 100) -> DataFrame:
        """The changes of all scans as a stream, with the scan's number."""
        found = self.spark.readStream.schema(f"{CHANGES}, scan int").option("maxFilesPerTrigger", per_trigger).parquet(f"{self.state}/changes")
        return found.filter("kind <> 'touched'")
