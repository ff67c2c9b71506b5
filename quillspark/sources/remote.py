"""Lists that come a page at a time, dumps of SQLite databases, and configuration."""

from __future__ import annotations

import json
import os
import sqlite3
import sys
from collections.abc import Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers needn't have this package


def follow(fetch, start: str | None = None) -> Iterator[dict]:
    """The results of all pages: fetch(cursor) gives results, has_more and next_cursor."""
    cursor = start
    while True:
        page = fetch(cursor)
        yield from page["results"]
        if not page.get("has_more"):
            return
        cursor = page["next_cursor"]


class PagedLists(DataSource):
    """``paged_lists``: a row for each result of the lists in folder ``path``; list L is L-0.json, whose next_cursor names the next file.

    Lists are partitions; a list's pages follow each other, so one task reads them in turn. ``path`` is read through Arrow's file systems.
    """

    @classmethod
    def name(cls) -> str:
        return "paged_lists"

    def schema(self) -> str:
        return "list string, at int, id string, title string"

    def reader(self, schema) -> DataSourceReader:
        return _PagedReader(self.options["path"])


class _PagedReader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self):
        from pyarrow import fs

        system, root = fs.FileSystem.from_uri(self.path)
        names = [x.base_name for x in system.get_file_info(fs.FileSelector(root)) if x.base_name.endswith("-0.json")]
        return [InputPartition(n.removesuffix("-0.json")) for n in sorted(names)]

    def read(self, partition):
        from pyarrow import fs

        system, root = fs.FileSystem.from_uri(self.path)

        def fetch(cursor):
            with system.open_input_stream(f"{root}/{cursor or f'{partition.value}-0.json'}") as source:
                return json.loads(source.read())

        for at, row in enumerate(follow(fetch)):
            yield partition.value, at, row.get("id"), row.get("title")


def sqlite_table(spark: SparkSession, paths: str, query: str, schema: str) -> DataFrame:
    """The rows of a query over each of the database files, one file a task. Files that aren't databases have none."""

    def run(parts):
        for b in parts:
            for content in b["content"]:
                con = sqlite3.connect(":memory:")
                try:
                    con.deserialize(bytes(content))
                    yield pd.read_sql_query(query, con)
                except (sqlite3.DatabaseError, pd.errors.DatabaseError):
                    continue
                finally:
                    con.close()

    return spark.read.format("binaryFile").load(paths).select("content").mapInPandas(run, schema)


#: Where each old name of a setting went.
MOVED = {"device.source_directory": "device.sync_directory"}


def merged(a: dict, b: dict) -> dict:
    """b over a, at every depth."""
    out = dict(a)
    for k, v in b.items():
        out[k] = merged(out[k], v) if isinstance(v, dict) and isinstance(out.get(k), dict) else v
    return out


class Config:
    """Defaults, then settings from a file (a mapping), then the environment's; names have dots."""

    def __init__(self, defaults: dict, settings: dict | None = None, env: dict[str, str] | None = None, moved: dict[str, str] | None = None):
        self.values = merged(defaults, settings or {})
        for old, new in (MOVED if moved is None else moved).items():
            if self.get(old) is not None and (settings or {}) and self.get(new) == _get(defaults, new):
                self.set(new, self.get(old))
        for variable, name in (env or {}).items():
            if os.environ.get(variable):
                self.set(name, os.environ[variable])

    def get(self, name: str, default=None):
        found = _get(self.values, name)
        return default if found is None else found

    def set(self, name: str, value) -> None:
        *path, last = name.split(".")
        at = self.values
        for k in path:
            at = at.setdefault(k, {})
        at[last] = value


def _get(values: dict, name: str):
    for k in name.split("."):
        if not isinstance(values, dict) or k not in values:
            return None
        values = values[k]
    return values
