"""Folder trees by pointer jumping: each round doubles how many ancestors a row knows, so a tree of depth n takes log2 n joins."""

from __future__ import annotations

from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.shared import table


def lineage(nodes: DataFrame, folder: str) -> DataFrame:
    """nodes (uuid, parent, name) with names and uuids from the top down to each row, and ``over``: the parent of the top row, null or not a node.

    Each round is written. Rows on or below a cycle have no top and no row; in a tree some row finds its top in every round, so the first
    round in which none does is the last.
    """
    known = nodes.select(F.col("uuid").alias("there"))
    state = nodes.select("uuid", "parent", "name").join(known, F.col("parent") == F.col("there"), "left")
    state = state.select("uuid", F.col("there").alias("up"), F.when(F.col("there").isNull(), F.col("parent")).alias("over"), F.array("name").alias("names"), F.array("uuid").alias("uuids"))
    before = None
    for number in count():
        state = table(state, f"{folder}/round-{number}")
        left = state.filter("up is not null").count()
        if not left or left == before:
            return state.filter("up is null").drop("up")
        before = left
        above = state.select(F.col("uuid").alias("at"), F.col("up").alias("higher"), F.col("over").alias("top"), F.col("names").alias("head"), F.col("uuids").alias("heads"))
        joined = state.join(above, F.col("up") == F.col("at"), "left")
        found = F.col("at").isNotNull()
        state = joined.select("uuid", F.col("higher").alias("up"), F.when(found, F.col("top")).otherwise(F.col("over")).alias("over"), F.when(found, F.concat("head", "names")).otherwise(F.col("names")).alias("names"), F.when(found, F.concat("heads", "uuids")).otherwise(F.col("uuids")).alias("uuids"))


def path(trash: str = "🗑️ Trash/", lost: str = "📁 ") -> Column:
    """Of a lineage; tops in the trash and those without their folder are marked."""
    mark = F.when(F.col("over").isNull(), F.lit("")).when(F.col("over") == "trash", F.lit(trash)).otherwise(F.lit(lost))
    return F.concat(mark, F.array_join("names", "/"))


def tags(full_path: Column) -> Column:
    """The folders of a path: all parts that aren't blank, but the last."""
    parts = F.filter(F.transform(F.split(full_path, "/"), lambda x: F.trim(x)), lambda x: x != "")
    return F.when(full_path.isNull(), F.array().cast("array<string>")).otherwise(F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0))))


def file_name(name: Column) -> Column:
    """Without characters that file systems don't take, of 255 at most."""
    safe = F.regexp_replace(F.regexp_replace(name, r'[<>:"/\\|?*]', "_"), r"[\x00-\x1f\x7f]", "")
    safe = F.regexp_replace(safe, r"^[ .]+|[ .]+$", "")
    return F.substring(F.when(safe == "", "untitled").otherwise(safe), 1, 255)


def output_path(full_path: Column, name: Column, extension: str = ".md") -> Column:
    """Below the notebook's folders, or the name alone where it has none."""
    parts = F.transform(F.filter(F.split(full_path, "/"), lambda x: x != ""), file_name)
    return F.concat(F.when(F.contains(full_path, F.lit("/")), F.array_join(parts, "/")).otherwise(file_name(name)), F.lit(extension))
