"""Files of a folder, listed and read by tasks: the driver learns of each level of folders only whether there is a next one.

Spark's own file sources list on the driver, which holds a status of every file for each read, and start a task for each folder.
"""

from __future__ import annotations

import sys
from fnmatch import fnmatchcase

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.shared import folder as shared
from quillspark.shared import table

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers needn't have this package

ENTRIES = "path string, folder boolean, length long, modified_us long"
LISTED = "path string, modificationTime timestamp, length long"
COLUMNS = [x.split()[0] for x in ENTRIES.split(", ")]
ENTRY_ROWS = 10_000
ROWS, BYTES = 1000, 16 << 20  # of contents that a task sends on at once


def opened(uri: str):
    """Arrow's file system of a folder, its path there, and how Spark writes it."""
    from pyarrow import fs

    uri = uri.rstrip("/")
    if uri.startswith("/"):
        return fs.LocalFileSystem(), uri, f"file:{uri}"
    if uri.startswith("file:/") and not uri.startswith("file://"):
        uri = f"file://{uri.removeprefix('file:')}"
    system, top = fs.FileSystem.from_uri(uri)
    return system, top, f"file:{top}" if uri.startswith("file:") else uri


def tasks(spark: SparkSession) -> int:
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)


def entries(batches, folder: str, patterns: tuple[str, ...]):
    """What folders (path, below the folder) hold, many folders in a batch, and one with many entries in several."""
    from pyarrow import fs

    system, top, _ = opened(folder)
    out = []
    for b in batches:
        for at in b["path"]:
            for i in system.get_file_info(fs.FileSelector(top + at)):
                name, deeper = i.base_name, i.type == fs.FileType.Directory
                if not name.startswith((".", "_")) and (deeper or (i.size and any(fnmatchcase(name, p) for p in patterns))):
                    out.append((f"{at}/{name}", deeper, i.size or 0, (i.mtime_ns or 0) // 1000))
                    if len(out) == ENTRY_ROWS:
                        yield pd.DataFrame(out, columns=COLUMNS)
                        out = []
    if out:
        yield pd.DataFrame(out, columns=COLUMNS)


def listing(spark: SparkSession, folder: str, *patterns: str, deep: bool = True) -> DataFrame:
    """path, modificationTime and length of the files whose names match one of the patterns (none: all).

    As in Spark's sources, empty files and names that begin with . or _ are left out.
    """
    where, levels = shared(spark, "listing"), []

    def look(batches):
        return entries(batches, folder, patterns or ("*",))

    level = spark.range(1, numPartitions=1).select(F.lit("").alias("path"))  # one folder needs one task
    while True:
        levels.append(table(level.mapInPandas(look, ENTRIES), f"{where}/{len(levels)}"))
        level = levels[-1].filter("folder").select("path").repartition(tasks(spark))
        if not deep or level.isEmpty():
            break
    found = levels[0]
    for more in levels[1:]:
        found = found.unionByName(more)
    return found.filter("not folder").select(F.concat(F.lit(opened(folder)[2]), "path").alias("path"), F.timestamp_micros("modified_us").alias("modificationTime"), "length")


def read(listed: DataFrame, folder: str) -> DataFrame:
    """The files of a listing of the folder with their contents, dealt to all tasks."""

    def run(batches):
        system, top, shown = opened(folder)
        for b in batches:
            first, contents, size = 0, [], 0
            for i, path in enumerate(b["path"]):
                with system.open_input_stream(top + path[len(shown) :]) as f:
                    contents.append(f.read())
                size += len(contents[-1])
                if size >= BYTES or len(contents) == ROWS or i + 1 == len(b):
                    yield b.iloc[first : i + 1].assign(content=contents)
                    first, contents, size = i + 1, [], 0

    own = listed.select("path", "modificationTime", "length")
    return own.repartition(tasks(listed.sparkSession)).mapInPandas(run, f"{LISTED}, content binary")
