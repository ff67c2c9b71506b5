"""The folder that driver and executors share, and tables written there: lineage ends at a written table, and a lost executor loses nothing."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def base(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where that is unset, a temporary folder if the master is local, else ValueError: executors wouldn't see it."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir is unset: it must name a folder that driver and executors share")
        found = Path(tempfile.mkdtemp(prefix="quillspark-")).as_uri()
        atexit.register(shutil.rmtree, found.removeprefix("file://"), True)
        spark.conf.set("spark.checkpoint.dir", found)
    if found.startswith("/"):
        found = f"file://{found}"
    elif found.startswith("file:/") and not found.startswith("file://"):
        found = f"file://{found.removeprefix('file:')}"
    return found.rstrip("/")


def filesystem(spark: SparkSession, uri: str):
    """Hadoop's file system of a path, and the path."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(uri)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path


def remove(spark: SparkSession, uri: str) -> None:
    system, path = filesystem(spark, uri)
    system.delete(path, True)


def _tidy(spark: SparkSession, uri: str) -> None:
    try:
        remove(spark, uri)
    except Exception:  # the session has ended before the driver's Python
        shutil.rmtree(uri.removeprefix("file://"), True)


def folder(spark: SparkSession, name: str) -> str:
    """A name of its own below the shared folder; it goes when the driver's Python ends."""
    uri = f"{base(spark)}/quillspark/{name}-{uuid.uuid4().hex}"
    atexit.register(_tidy, spark, uri)
    return uri


def table(df: DataFrame, uri: str) -> DataFrame:
    """Writes df and reads it back."""
    df.write.mode("overwrite").parquet(uri)
    return df.sparkSession.read.schema(df.schema).parquet(uri)
