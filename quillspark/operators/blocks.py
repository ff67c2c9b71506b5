"""Markdown as a stream of blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: What a line of each kind looks like.
CHECKBOX, BULLET, NUMBER, RULE = r"^-\s*\[([ xX])\]\s+(.+)$", r"^[-*]\s+(.+)$", r"^\d+\.\s+(.+)$", r"^---+$"


def blocks(pages: DataFrame, key: str, text: str = "text", most: int = 100) -> DataFrame:
    """key, block (from 1), kind, level, content and checked of each non-blank line, at most ``most`` a page, in order.

    Null, empty and blank texts have one paragraph that says so. ``most`` is the operator's own limit.
    """
    lines = pages.select(key, F.posexplode_outer(F.split(text, "\n")).alias("_at", "_raw")).withColumn("_l", F.coalesce(F.regexp_replace("_raw", r"^\s+|\s+$", ""), F.lit("")))
    full = lines.withColumn("_any", F.max(F.length("_l") > 0).over(Window.partitionBy(key))).filter("_l <> '' or (not _any and coalesce(_at, 0) = 0)")
    full = full.withColumn("block", F.row_number().over(Window.partitionBy(key).orderBy("_at"))).filter(F.col("block") <= most)
    line, cases = F.col("_l"), [("heading", F.col("_l").startswith("#")), ("divider", F.col("_l").rlike(RULE)), ("checkbox", F.col("_l").rlike(CHECKBOX)), ("bullet", F.col("_l").rlike(BULLET)), ("numbered", F.col("_l").rlike(NUMBER))]
    kind = F.lit("paragraph")
    for name, test in reversed(cases):
        kind = F.when(test, name).otherwise(kind)
    full = full.withColumn("kind", kind)
    hashes = F.length(F.regexp_extract(line, "^(#+)", 1))
    content = F.when(F.col("kind") == "heading", F.trim(F.regexp_replace(line, "^#+", "")))
    for name, pattern, group in (("checkbox", CHECKBOX, 2), ("bullet", BULLET, 1), ("numbered", NUMBER, 1)):
        content = content.when(F.col("kind") == name, F.trim(F.regexp_extract(line, pattern, group)))
    content = content.when(F.col("kind") == "divider", "").when(line == "", "(No content to display)").otherwise(line)
    checked = F.when(F.col("kind") == "checkbox", F.lower(F.regexp_extract(line, CHECKBOX, 1)) == "x")
    return full.select(key, "block", "kind", F.when(F.col("kind") == "heading", F.least(hashes, F.lit(3))).alias("level"), content.alias("content"), checked.alias("checked"))


def rich_text(content: Column) -> Column:
    """Runs (text, bold, italic) between ** and *: an array of structs."""
    runs = F.regexp_extract_all(content, F.lit(r"(?s)(\*\*.*?\*\*|\*.*?\*|[^*]+|\*+)"), 1)
    bold, italic = (lambda r: r.rlike(r"(?s)^\*\*.+\*\*$")), (lambda r: r.rlike(r"(?s)^\*[^*]+\*$"))
    return F.transform(runs, lambda r: F.struct(F.when(bold(r), F.substr(r, F.lit(3), F.length(r) - 4)).when(italic(r), F.substr(r, F.lit(2), F.length(r) - 2)).otherwise(r).alias("text"), bold(r).alias("bold"), italic(r).alias("italic")))


def block_structs(pages: DataFrame, key: str, text: str = "text", most: int = 100) -> DataFrame:
    """key and its blocks in order: type, level, rich_text (runs) and checked."""
    own = blocks(pages, key, text, most).withColumn("rich_text", rich_text(F.col("content")))
    each = F.struct("block", F.col("kind").alias("type"), "level", "rich_text", "checked")
    return own.groupBy(key).agg(F.array_sort(F.collect_list(each)).alias("b")).select(key, F.transform("b", lambda x: x.dropFields("block")).alias("blocks"))


def layout(notebooks: DataFrame, pages: DataFrame, most: int = 50) -> DataFrame:
    """notebook_uuid, at, kind and content of a notebook's blocks: heading, summary, a warning where pages are left out, divider, newest pages first.

    notebooks: notebook_uuid, name, full_path, modified (a day), tags (joined by commas); null parts have no place in the summary.
    """
    total = pages.groupBy("notebook_uuid").agg(F.count("*").alias("total"))
    own = notebooks.join(total, "notebook_uuid", "left").withColumn("total", F.coalesce("total", F.lit(0)))
    over = F.col("total") > most
    parts = F.array(F.concat(F.lit("Total pages: "), "total"), F.concat(F.lit("UUID: "), F.substring("notebook_uuid", 1, 8), F.lit("...")), F.concat(F.lit("Path: "), F.nullif("full_path", F.lit(""))), F.concat(F.lit("Modified: "), "modified"), F.concat(F.lit("Tags: "), F.nullif("tags", F.lit(""))), F.when(over, F.lit(f"Showing latest {most} pages (truncated)")))
    warning = F.when(over, F.concat(F.lit("⚠️ This notebook has "), "total", F.lit(f" pages, but only the latest {most} are shown")))
    heads = F.array(F.struct(F.lit("heading").alias("kind"), F.concat(F.lit("📓 "), "name").alias("content")), *[F.struct(F.lit(kind).alias("kind"), c.alias("content")) for kind, c in (("paragraph", F.array_join(F.array_compact(parts), " | ")), ("callout", warning), ("divider", F.lit("")))])
    first = own.select("notebook_uuid", F.posexplode(heads).alias("at", "b")).select("notebook_uuid", "at", "b.kind", "b.content").filter("content is not null")
    rank = F.row_number().over(Window.partitionBy("notebook_uuid").orderBy(F.col("page_number").desc()))
    toggles = pages.withColumn("n", rank).filter(F.col("n") <= most).select("notebook_uuid", (F.col("n") + 3).alias("at"), F.lit("toggle").alias("kind"), F.concat(F.lit("📄 Page "), "page_number").alias("content"))
    return first.unionByName(toggles)


def blank_pages(blocks: DataFrame) -> DataFrame:
    """notebook, page and preview of the toggles of pages one of whose paragraphs says that it is blank; the first such paragraph.

    blocks: notebook, title of a toggle, children (array of type and text).
    """
    page = F.regexp_extract("title", r"📄 Page (\d+)", 1).try_cast("int")
    says = F.filter("children", lambda c: (c["type"] == "paragraph") & (c["text"].contains("This appears to be a blank") | c["text"].contains("completely empty page")))
    return blocks.select("notebook", page.alias("page"), F.get(says, F.lit(0))["text"].alias("found")).filter("page is not null and found is not null").select("notebook", "page", F.substring("found", 1, 80).alias("preview"))
