"""A device's folder of notebooks: sidecar files, page lists, templates, documents and page files.

What is read from files is joined by merging: Spark takes it for as small as the listing that names the files, and would send it all through the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.sources.listing import listing, opened, read

SIDECAR = "visibleName string, parent string, type string, lastModified string, lastOpened string, lastOpenedPage int, deleted boolean, pinned boolean, synced boolean, version int, createdTime string, source string"
CONTENT = "fileType string, formatVersion int, pageCount int, pages array<string>, cPages struct<pages: array<struct<id: string, deleted: struct<value: int>, redir: struct<value: int>>>>, documentMetadata struct<authors: string, publisher: string, publicationDate: string>"


def files(spark: SparkSession, folder: str, pattern: str, deep: bool = True, listed: DataFrame | None = None) -> DataFrame:
    """path, modificationTime, length and content; ``listing`` has all but the contents. listed: one of the folder that has more files, not listed again."""
    return read(listing(spark, folder, pattern, deep=deep) if listed is None else named(listed, pattern), folder)


def named(listed: DataFrame, pattern: str) -> DataFrame:
    """Those of a listing whose names match a pattern of a star and an ending."""
    return listed.filter(F.endswith("path", F.lit(pattern.removeprefix("*"))))


def stem() -> Column:
    return F.regexp_extract("path", r"([^/]*)\.[^./]*$", 1)


def _json(df: DataFrame, schema: str) -> DataFrame:
    return df.select(stem().alias("uuid"), F.from_json(F.decode("content", "UTF-8"), schema, {"mode": "PERMISSIVE"}).alias("j"), F.try_parse_json(F.decode("content", "UTF-8")).isNotNull().alias("_good")).filter("_good").drop("_good")


def sidecars(spark: SparkSession, folder: str, deep: bool = False, listed: DataFrame | None = None) -> DataFrame:
    """A row for each *.metadata file with its defaults; an empty parent is null. Files that aren't JSON have no row."""
    j = _json(files(spark, folder, "*.metadata", deep, listed), SIDECAR)
    flags = [F.coalesce(f"j.{c}", F.lit(False)).alias(c) for c in ("deleted", "pinned", "synced")]
    return j.select("uuid", F.coalesce("j.visibleName", F.lit("Unknown")).alias("visible_name"), F.nullif(F.col("j.parent"), F.lit("")).alias("parent"), F.coalesce("j.type", F.lit("Unknown")).alias("item_type"), "j.lastModified", "j.lastOpened", "j.lastOpenedPage", *flags, "j.version")


def contents(spark: SparkSession, folder: str, listed: DataFrame | None = None) -> DataFrame:
    """uuid and j: the .content files that are JSON."""
    return _json(files(spark, folder, "*.content", listed=listed), CONTENT)


def notebooks(spark: SparkSession, folder: str, exclude: list[str] | None = None) -> DataFrame:
    """Documents, at any depth, that have a .content file and aren't excluded by name."""
    listed = listing(spark, folder, "*.metadata", "*.content")
    docs = sidecars(spark, folder, listed=listed).filter(F.col("item_type") == "DocumentType")
    docs = docs.filter(~F.col("visible_name").isin(exclude)) if exclude else docs
    return docs.join(named(listed, "*.content").select(stem().alias("uuid")), "uuid", "left_semi")


def page_ids() -> Column:
    """The pages of j: of version 2 those not deleted, else the plain list; null where neither is there."""
    live = F.filter("j.cPages.pages", lambda p: p["deleted"].isNull())
    return F.coalesce(F.when(F.col("j.formatVersion") == 1, F.col("j.pages")), F.transform(live, lambda p: p["id"]), F.col("j.pages"))


def pages(spark: SparkSession, folder: str, listed: DataFrame | None = None) -> DataFrame:
    """uuid, page_number (from 1), page_uuid."""
    return contents(spark, folder, listed).select("uuid", F.posexplode(page_ids()).alias("page_number", "page_uuid")).withColumn("page_number", F.col("page_number") + 1)


def page_counts(spark: SparkSession, folder: str) -> DataFrame:
    return contents(spark, folder).select("uuid", F.coalesce("j.pageCount", F.size(page_ids()), F.lit(0)).alias("pages"))


def page_map(spark: SparkSession, folder: str, listed: DataFrame | None = None) -> DataFrame:
    """uuid, page_uuid and the page of the PDF that it shows (from 0); pages of one's own have none."""
    return contents(spark, folder, listed).select("uuid", F.explode("j.cPages.pages").alias("p")).select("uuid", F.col("p.id").alias("page_uuid"), F.col("p.redir.value").alias("pdf_page")).filter("pdf_page is not null")


def kinds(spark: SparkSession, folder: str) -> DataFrame:
    """uuid and document_type of every sidecar: without .content folder; otherwise by file type."""
    listed = listing(spark, folder, "*.metadata", "*.content")
    there = named(listed, "*.content").select(stem().alias("uuid"), F.lit(True).alias("_there"))
    kind = F.col("j.fileType")
    name = F.when(F.col("_there").isNull(), "folder").when(kind.isin("", "notebook"), "notebook").when(kind.isin("pdf", "epub"), kind).otherwise("unknown")
    own = listed.filter(F.col("path") == F.concat(F.lit(f"{opened(folder)[2]}/"), F.substring_index("path", "/", -1)))  # not those below
    return sidecars(spark, folder, listed=own).select("uuid").join(there, "uuid", "left").join(contents(spark, folder, listed).hint("merge"), "uuid", "left").select("uuid", name.alias("document_type"))


def metadata(spark: SparkSession, folder: str) -> DataFrame:
    """authors (a list is joined by commas), publisher, and publication_date as a day where it is one, as it is otherwise."""
    d = F.col("j.documentMetadata")
    authors = F.coalesce(F.array_join(F.from_json(d["authors"], "array<string>"), ", "), F.nullif(d["authors"], F.lit("")))
    day = F.date_format(F.try_to_timestamp(d["publicationDate"]), "yyyy-MM-dd")
    return contents(spark, folder).select("uuid", authors.alias("authors"), F.trim(d["publisher"]).alias("publisher"), F.coalesce(day, d["publicationDate"]).alias("publication_date"))


def templates(spark: SparkSession, folder: str) -> DataFrame:
    """uuid and the templates of its pages, in order."""
    return files(spark, folder, "*.pagedata").select(stem().alias("uuid"), F.filter(F.split(F.decode("content", "UTF-8"), r"\s+"), lambda x: x != "").alias("templates"))


def strokes(spark: SparkSession, folder: str, least: int = 100) -> DataFrame:
    """Page files of ``least`` bytes or more: notebook, page, length; contents aren't read."""
    parts = F.split("path", "/")
    return listing(spark, folder, "*.rm").filter(F.col("length") >= least).select(F.element_at(parts, -2).alias("uuid"), stem().alias("page_uuid"), "length")


def stroke_hashes(spark: SparkSession, folder: str) -> DataFrame:
    return files(spark, folder, "*.rm").select(stem().alias("page_uuid"), F.sha2("content", 256).alias("hash"))


def printable_runs(spark: SparkSession, folder: str, least: int = 15, listed: DataFrame | None = None) -> DataFrame:
    """page_uuid, at, run: what page files hold of printable ASCII."""
    text = F.decode("content", "ISO-8859-1")
    return files(spark, folder, "*.rm", listed=listed).select(stem().alias("page_uuid"), F.posexplode(F.regexp_extract_all(text, F.lit(f"([ -~]{{{least},}})"), 1)).alias("at", "run"))


def page_hashes(spark: SparkSession, folder: str, least: int = 0) -> DataFrame:
    """page_uuid and hash of every listed page: SHA-256 of its file, or MD5 of its number and name where it has none of ``least`` bytes or more."""
    listed = listing(spark, folder, "*.content", "*.rm")
    own = F.md5(F.concat_ws(":", F.lit("page"), F.col("page_number").cast("string"), F.col("page_uuid")))
    there = read(named(listed, "*.rm").filter(F.col("length") >= least), folder).select(stem().alias("page_uuid"), F.sha2("content", 256).alias("hash"))
    return pages(spark, folder, listed).join(there.hint("merge"), "page_uuid", "left").select("page_uuid", F.coalesce("hash", own).alias("hash"))


def legacy_sentences(spark: SparkSession, folder: str, words: int = 3, letters: float = 0.6, symbols: float = 0.2) -> DataFrame:
    """page_uuid, pdf_page and a row for each run of a page file that is mostly text; pages with a side file ``<page>-metadata.json`` are left out."""
    listed = listing(spark, folder, "*-metadata.json", "*.rm", "*.content")
    there = named(listed, "*-metadata.json").select(F.regexp_extract("path", r"([^/]*)-metadata\.json$", 1).alias("page_uuid"))
    runs = printable_runs(spark, folder, 1, listed).join(there, "page_uuid", "left_anti")
    text = F.trim(F.replace("run", F.lit("l!"), F.lit("")))
    own = runs.select("page_uuid", text.alias("sentence")).filter("sentence <> '' and not sentence like 'reMarkable .lines file, version=_'")
    size = F.greatest(F.length("sentence"), F.lit(1))
    count = lambda pattern: F.length(F.regexp_replace("sentence", pattern, ""))
    good = (count(r"[^\p{L}]") / size > letters) & (F.size(F.split(F.col("sentence"), r"\s+")) >= words) & (count(r"[\p{L}\p{N}\s]") / size < symbols)
    return own.filter(good).join(page_map(spark, folder, listed).select("page_uuid", "pdf_page").hint("merge"), "page_uuid", "left").select("page_uuid", "sentence", "pdf_page")


def allowed(spark: SparkSession, path: str) -> DataFrame:
    """The lines of a list, without blank ones and comments."""
    return spark.read.text(path).select(F.trim("value").alias("line")).filter("line <> '' and line not like '#%'")
