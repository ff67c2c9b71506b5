"""File sinks: texts, highlights and todos as text, Markdown, JSON or CSV. Each writes a folder of part files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def export(df: DataFrame, path: str, kind: str) -> None:
    """csv with a header, or json lines; parts follow df's partitions."""
    if kind not in ("csv", "json"):
        raise ValueError(f"csv or json, not {kind}")
    writer = df.write.mode("overwrite")
    writer.option("header", True).option("escape", '"').csv(path) if kind == "csv" else writer.json(path)


def page_texts(pages: DataFrame, path: str, markdown: bool = True) -> None:
    """A text for each notebook, below notebook_uuid=...: its pages in order, under headings or separators."""
    head = F.concat(F.lit("## Page " if markdown else "--- Page "), F.col("page_number"), F.lit("" if markdown else " ---"))
    page = F.struct("page_number", F.concat_ws("\n\n", head, F.coalesce("text", F.lit(""))).alias("t"))
    whole = pages.groupBy("notebook_uuid").agg(F.sort_array(F.collect_list(page)).alias("p")).select("notebook_uuid", F.array_join(F.col("p.t"), "\n\n").alias("value"))
    whole.write.mode("overwrite").partitionBy("notebook_uuid").text(path)


def todo_list(todos: DataFrame) -> DataFrame:
    """Lines of a Markdown list, at: pending todos by id, then completed ones, each part with its heading and count."""
    counts = todos.groupBy("completed").count()
    heads = counts.select(F.col("completed").alias("part"), F.lit(-1).cast("long").alias("id"), F.concat(F.when(F.col("completed"), "## Completed (").otherwise("## Pending ("), F.col("count"), F.lit(")")).alias("line"))
    lines = todos.select(F.col("completed").alias("part"), F.col("id").cast("long"), F.concat(F.when(F.col("completed"), "- [x] ").otherwise("- [ ] "), F.coalesce("text", F.lit(""))).alias("line"))
    return heads.unionByName(lines).orderBy("part", "id").select("part", "id", "line")
