"""Highlights found again in page texts: exact containment, then windows of words by edit similarity."""

from __future__ import annotations

import re
import sys
from collections.abc import Iterable

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.operators.windows import best, common_subsequence, partial_ratio, ratio, spans, strands  # noqa: F401
from quillspark.shared import folder, table

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers needn't have this package


def normalise(text: Column) -> Column:
    return F.trim(F.lower(F.regexp_replace(text, "[ \\t\\n\\r]+", " ")))


SENT_BYTES = 32 << 20  # of needles that are broadcast
TOGETHER = 2048  # pairs of needles and texts that are combed at once


def _pieces(text: Column, most: int) -> Column:
    """All strings of up to ``most`` characters of the words of an array."""
    starts = lambda w: F.sequence(F.lit(1), F.length(w))
    each = lambda w: F.flatten(F.transform(starts(w), lambda i: F.transform(F.sequence(F.lit(1), F.least(F.lit(most), F.length(w) - i + 1)), lambda k: w.substr(i, k))))
    return F.flatten(F.transform(F.array_distinct(text), each))


def _seams(w: Column, most: int) -> Column:
    """Up to ``most`` characters on either side of each blank."""
    ends = lambda x: F.transform(F.sequence(F.lit(1), F.least(F.lit(most), F.length(x))), lambda k: F.right(x, k))
    heads = lambda x: F.transform(F.sequence(F.lit(1), F.least(F.lit(most), F.length(x))), lambda k: F.left(x, k))
    pair = lambda a, b: F.flatten(F.transform(ends(a), lambda x: F.transform(heads(b), lambda y: F.concat_ws(" ", x, y))))
    return F.flatten(F.zip_with(F.slice(w, 1, F.greatest(F.size(w) - 1, F.lit(0))), F.slice(w, 2, F.greatest(F.size(w) - 1, F.lit(0))), pair))


def contained(needles: DataFrame, texts: DataFrame, needle_id: str, text_id: str, words: int = 3) -> DataFrame:
    """Pairs (text_id, needle_id, at): the normalised needle is in the normalised text from character ``at`` (1 first).

    Pairs meet by one key a needle, and are then verified: the needle's words but the first and last are whole words of the text, so long needles meet by
    ``words`` of them in a row and others by their second one; two words meet by the characters about their blank, one by its first three
    characters. Needles of SENT_BYTES at most are sent to the texts, which then aren't shuffled; more are joined by key. Null and empty: no pair. Ids of each side are distinct.
    """
    n = needles.select(F.col(needle_id), normalise(F.col("text")).alias("_needle")).filter("_needle <> ''").withColumn("_w", F.split("_needle", " "))
    n = n.withColumn("_n", F.size("_w")).withColumn("_kind", F.when(F.col("_n") >= words + 2, "row").when(F.col("_n") > 2, "word").when(F.col("_n") == 2, "seam").otherwise("piece"))
    cores = texts.sparkSession.sparkContext.defaultParallelism
    if texts.rdd.getNumPartitions() < cores:  # a small table in one file: much work for few bytes
        texts = texts.select(text_id, "text").repartition(cores)
    t = texts.select(F.col(text_id), normalise(F.col("text")).alias("_text")).filter("_text <> ''").withColumn("_words", F.split("_text", " "))
    w = F.col("_words")
    shifted = lambda k: F.slice(w, k + 1, F.greatest(F.size(w) - words + 1, F.lit(0)))
    in_a_row = shifted(0)
    for k in range(1, words):
        in_a_row = F.zip_with(in_a_row, shifted(k), lambda a, b: F.concat(a, F.lit(" "), b))
    first, second = F.col("_w")[0], F.col("_w")[1]
    keys = {
        "row": (F.array_join(F.slice("_w", 2, words), " "), in_a_row),
        "word": (second, w),
        "seam": (F.concat_ws(" ", F.right(first, F.least(F.lit(2), F.length(first))), F.left(second, F.least(F.lit(2), F.length(second)))), _seams(w, 2)),
        "piece": (F.left(first, F.least(F.lit(3), F.length(first))), _pieces(w, 3)),
    }
    size = {k: b for k, b in n.groupBy("_kind").agg(F.sum(F.octet_length("_needle") + 100)).collect()}  # four rows at most
    found = []
    for kind in [k for k in keys if k in size]:
        own = n.filter(F.col("_kind") == kind).select(needle_id, "_needle", keys[kind][0].alias("_key"))
        met = t.select(text_id, "_text", F.explode(F.array_distinct(keys[kind][1])).alias("_key"))
        if size[kind] <= SENT_BYTES:
            met = met.join(F.broadcast(own), "_key")
        else:
            met = met.select(text_id, "_key").join(own.select(needle_id, "_key"), "_key").select(text_id, needle_id)
            met = met.join(own, needle_id).join(t, text_id)
        found.append(met.withColumn("at", F.instr("_text", F.col("_needle"))).filter("at > 0").select(text_id, needle_id, "at"))
    if not found:
        return t.limit(0).select(text_id, F.lit(None).cast(n.schema[needle_id].dataType).alias(needle_id), F.lit(0).alias("at"))
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def word_span(text: str, first: int, last: int) -> tuple[int, int]:
    """Characters of text from its word ``first`` to before word ``last``; past the last word: to the end."""
    spans = [m.span() for m in re.finditer(r"\S+", text)]
    return spans[first][0], spans[last - 1][1] if last < len(spans) else len(text)


def to_sentence(text: str, start: int, end: int) -> tuple[int, int]:
    """Widened to whole sentences, with closing quotes."""
    before = [m.end() for m in re.finditer(r"[.!?…][\"'”’)]*\s+", text[:start])]
    after = re.compile(r"[.!?…][\"'”’)]*(?=\s|$)").search(text, max(start, end - 1))
    return (before[-1] if before else 0), (after.end() if after else len(text))


Found = tuple[int, str | None, int | None, int | None, int, int]


def located(needle: str | None, text: str | None, threshold: int, longer: tuple[int, ...] = (5, 10)) -> Found:
    """Score, found text, its characters in text, windows and scored windows; found is null under the threshold."""
    return located_all([needle], [text], threshold, longer)[0]


def located_all(needles: Iterable[str | None], texts: Iterable[str | None], threshold: int, longer: tuple[int, ...] = (5, 10)) -> list[Found]:
    """``located`` of pairs, of which TOGETHER are combed at once."""
    pairs, out = list(zip(needles, texts, strict=True)), []
    for k in range(0, len(pairs), TOGETHER):
        some = [tuple(" ".join((x or "").split()).lower() for x in pair) for pair in pairs[k : k + TOGETHER]]
        combed = strands([("", "") if n in t else (n, t) for n, t in some])
        out += [_located(n, t, text, threshold, longer, stops) for (n, t), (_, text), stops in zip(some, pairs[k : k + TOGETHER], combed, strict=True)]
    return out


def _located(n: str, t: str, text: str | None, threshold: int, longer: tuple[int, ...], stops: np.ndarray | None) -> Found:
    got = best(n, t, threshold, longer, stops=stops)
    if got.exact:  # offsets of the normalised text, as the original is cut
        return 100, text[got.start : got.end], got.start, got.end, 0, 0
    if not got.score:
        return 0, None, None, None, got.windows, got.verified
    start, end = to_sentence(text, *word_span(text, got.first, got.last))
    return got.score, text[start:end], start, end, got.windows, got.verified


def match(needle: str | None, text: str | None, threshold: int, longer: tuple[int, ...] = (5, 10)) -> tuple[int, str | None]:
    return located(needle, text, threshold, longer)[:2]


FOUND = "score int, found string, start int, end int, windows long, verified long"


def page_search(highlights: DataFrame, pages: DataFrame, book: str, reach: int = 2, threshold: int = 65) -> DataFrame:
    """Each highlight's page, score and text: of its page, the next, the one before and so on, the first with ``threshold``.

    highlights: id, book, page_number, text; pages: book, page_number, text. start and end are the characters found, windows how many there
    were on the pages looked at and verified how many of them were scored. Unknown pages (null, 0) and those not found have no row. The pages about a highlight's own
    are only joined to highlights that aren't found on it; a page's text goes to its highlights and is not shuffled again.
    """
    kind = highlights.schema["id"].dataType.simpleString()

    def run(batches):
        for b in batches:
            got = located_all(b["needle"], b["text"], threshold)
            out = pd.DataFrame(got, columns=["score", "found", "start", "end", "windows", "verified"]).astype({"start": "Int32", "end": "Int32"})
            yield pd.concat([b[["id", "order", "page"]].reset_index(drop=True), out], axis=1)

    def on(wanted: DataFrame, offsets: list[int]) -> DataFrame:
        there = wanted.select("id", book, "needle", "page_number", F.posexplode(F.array(*map(F.lit, offsets))).alias("order", "_by"))
        there = there.withColumn("page_number", F.col("page_number") + F.col("_by"))
        # Much work for few bytes: the number of tasks is given, so that small partitions aren't merged.
        dealt, theirs = (x.repartition(tasks, book, "page_number") for x in (there, pages.select(book, "page_number", "text")))
        pairs = dealt.join(theirs, [book, "page_number"])
        return pairs.select("id", "order", F.col("page_number").cast("long").alias("page"), "needle", "text").mapInPandas(run, f"id {kind}, order int, page long, {FOUND}")

    def first(found: DataFrame) -> DataFrame:
        top = F.min_by(F.struct("page", "score", "found", "start", "end"), F.col("order")).alias("_b")
        return found.filter("found is not null").groupBy("id").agg(top).select("id", "_b.*").join(found.groupBy("id").agg(F.sum("windows").alias("windows"), F.sum("verified").alias("verified")), "id")

    spark = highlights.sparkSession
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    wanted = highlights.filter("page_number > 0").select("id", book, F.col("text").alias("needle"), "page_number")
    own = table(on(wanted, [0]), folder(spark, "own-pages"))
    others = [s * k for k in range(1, reach + 1) for s in (1, -1)]
    if not others:
        return first(own)
    left = wanted.join(own.filter("found is not null"), "id", "left_anti")
    return first(own).unionByName(first(table(on(left, others), folder(spark, "other-pages"))))


LEVELS, CONTEXT = (0.10, 0.15, 0.20, 0.30), 500


def lowered(text: str) -> str:
    """In lower case, of the same length."""
    out = text.lower()
    return out if len(out) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


def about(at: float, length: int, window: float) -> tuple[int, int]:
    """The part of a book around a position from 0 to 1."""
    middle, half = int(at * length), int(window * length) // 2
    return max(0, middle - half), min(length, middle + half)


def segments(books: DataFrame, book: str, size: int, reach: int) -> DataFrame:
    """book, segment, base, length (of the book) and text: the book's characters, with single blanks, from a little before each segment to ``reach`` and a little after it."""
    kind = books.schema[book].dataType.simpleString()

    def cut(batches):
        for b in batches:
            for key, text in zip(b[book], b["text"], strict=True):
                own = " ".join((text or "").split())
                for i in range(0, len(own), size):
                    base = max(0, i - CONTEXT)
                    yield pd.DataFrame({book: [key], "segment": [i // size], "base": [base], "length": [len(own)], "text": [own[base : i + size + reach + CONTEXT]]})

    return books.select(book, "text").mapInPandas(cut, f"{book} {kind}, segment int, base long, length long, text string")


def parts(at: float, segment: int, base: int, length: int, lower: str, size: int, reach: int) -> list[tuple[int, int, int, bool]]:
    """(level, begin, end, cut) of the parts of a book in a segment, of whole words; cut: the part goes on after the segment."""
    low, high = segment * size, (segment + 1) * size
    stop, out = length if base + len(lower) == length else high + reach, []
    for level, window in enumerate(LEVELS):
        x, y = about(at, length, window)
        inside = x <= low  # else the part begins here, with its first whole word
        begin, end = (low if inside else x) - base, min(y, stop) - base
        if end <= 0 or max(x, low) >= min(y, high):
            continue
        if inside:
            begin = lower.rfind(" ", 0, begin) + 1
        elif begin and lower[begin - 1] != " ":
            begin = lower.find(" ", begin) + 1 or len(lower)
        if end < len(lower) and lower[end] != " ":
            end = max(0, lower.rfind(" ", 0, end))
        out.append((level, begin, end, y > stop))
    return out


def in_segment(needle: str, own_parts: list[tuple[int, int, int, bool]], segment: int, base: int, text: str, lower: str, size: int, threshold: int, from_: int = 0, stops: np.ndarray | None = None) -> list[tuple]:
    """(level, kind, order, score, found, start, end, windows, verified) of what a segment has: kind 0 to 2 the best there, 3 counts; 4: the segment is too short for the needle.

    stops: strands of the needle and the segment's text from ``from_``, which all parts are in.
    """
    low, high = segment * size, (segment + 1) * size
    longer, out, done = (5, 10, 20), [], {}
    for level, begin, end, cut in own_parts:
        if (begin, end) not in done:
            own = lower[begin:end].rstrip(" ")
            starts = spans(own)[0] if own else []
            begun = sum(low - base <= s + begin < high - base for s in starts)
            before = sum(s + begin < low - base for s in starts)
            if cut and begun and before + begun - 1 + len(needle.split()) + max(longer) > len(starts):
                return [(0, 4, 0, 0, None, 0, 0, 0, 0)]
            theirs = None if stops is None else stops[begin - from_ : begin - from_ + len(own)] - (begin - from_)
            done[begin, end] = best(needle, own, threshold, longer, lambda a, b, begin=begin: (a + begin >= low - base) & (a + begin < high - base), theirs)
            out.append((level, 3, 0, 0, None, 0, 0, done[begin, end].windows, done[begin, end].verified))
        got = done[begin, end]
        if got.score:
            start, end = got.start + begin, got.end + begin
            place = start + base, end + base
            if not got.exact:
                near = max(0, start - CONTEXT)
                a, b = to_sentence(text[near : end + CONTEXT], start - near, end - near)
                start, end = near + a, near + b
            out.append((level, 0 if got.exact else 1 + bool(got.longer), got.longer, got.score, text[start:end], *place, 0, 0))
    return out


def in_segments(rows: list[tuple], size: int, reach: int, threshold: int) -> list[list[tuple]]:
    """What ``in_segment`` says of each needle, at, segment, base, length and text; needles and the widest parts of theirs are combed, TOGETHER at once."""
    if len(rows) > TOGETHER:
        return [x for k in range(0, len(rows), TOGETHER) for x in in_segments(rows[k : k + TOGETHER], size, reach, threshold)]
    own = []
    for needle, at, segment, base, length, text in rows:
        lower = lowered(text)
        there = parts(at, segment, base, length, lower, size, reach)
        begin, end = min((p[1] for p in there), default=0), max((p[2] for p in there), default=0)
        own.append((needle, there, segment, base, text, lower, size, threshold, begin, end))
    combed = strands([(x[0], x[5][x[8] : x[9]]) for x in own])
    return [in_segment(*x[:-1], stops) for x, stops in zip(own, combed, strict=True)]


def book_search(highlights: DataFrame, books: DataFrame, book: str, threshold: int = 85, size: int = 4096, reach: int = 4096) -> DataFrame:
    """id, score, found, start, end, windows and verified of the highlights whose text is in its book around page / pages.

    highlights: id, book, page_number, pages, text; books: book, text. The part of a book about that place is looked at, 10 % of it,
    else 15, 20 and 30; words that it cuts aren't in it. The first level whose best place has the threshold counts, if the first 100 characters of its sentences and of the
    highlight are alike by 70. start and end are the place's characters in the book's text with single blanks. Books are cut into segments, which highlights join by number; no
    text longer than a segment is shuffled, but for books of highlights that are longer than ``reach``. Null texts and unknown pages have no row.
    """
    spark, kind = highlights.sparkSession, highlights.schema["id"].dataType.simpleString()
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    known = highlights.filter("page_number > 0 and pages > 0 and text is not null").select("id", book, F.col("text").alias("needle"), (F.col("page_number").cast("double") / F.col("pages")).alias("at"))
    columns = ["level", "kind", "order", "score", "found", "start", "end", "windows", "verified"]
    schema = f"id {kind}, level int, kind int, `order` int, score int, found string, start long, end long, windows long, verified long"

    def search(size: int, reach: int, wanted: DataFrame, books: DataFrame, name: str) -> DataFrame:
        cut = table(segments(books, book, size, reach), folder(spark, f"{name}-segments"))

        def run(batches):
            for b in batches:
                rows = []
                needles = [" ".join(x.split()) for x in b["needle"]]
                all_ = in_segments(list(zip(map(lowered, needles), *(b[c] for c in ("at", "segment", "base", "length", "text")), strict=True)), size, reach, threshold)
                for key, needle, own in zip(b["id"], needles, all_, strict=True):
                    for found in own:
                        rows.append((key, *found, found[4] is not None and ratio(needle[:100].lower(), found[4][:100].lower()) >= 70))
                yield pd.DataFrame(rows, columns=["id", *columns, "alike"])

        lengths = cut.filter("segment = 0").select(book, "length")
        middle, half = F.floor(F.col("at") * F.col("length")), F.floor(F.floor(F.col("length") * LEVELS[-1]) / 2)
        low, high = F.greatest(F.lit(0), middle - half), F.least(F.col("length"), middle + half)
        there = wanted.join(lengths, book).withColumn("low", low).withColumn("high", high).filter("low < high")
        there = there.select("id", book, "needle", "at", F.explode(F.sequence(F.floor(F.col("low") / size).cast("int"), F.floor((F.col("high") - 1) / size).cast("int"))).alias("segment"))
        dealt, theirs = (x.repartition(tasks, book, "segment") for x in (there, cut))
        pairs = dealt.join(theirs, [book, "segment"]).select("id", "needle", "at", "segment", "base", "length", "text")
        return table(pairs.mapInPandas(run, f"{schema}, alike boolean"), folder(spark, name))

    found = search(size, reach, known, books, "places")
    short = found.filter("kind = 4").select("id").distinct()
    if not short.isEmpty():  # in one segment, as long as its book
        long = known.join(short, "id", "left_semi")
        theirs = books.join(long.select(book).distinct(), book, "left_semi")
        found = found.join(short, "id", "left_anti").unionByName(search(2**30, 0, long, theirs, "long-places"))
    order = F.struct("kind", F.when(F.col("kind") == 0, 0).otherwise(-F.col("score")), F.when(F.col("kind") == 2, F.col("order")).otherwise(0), "start")
    top = found.filter("kind < 3").groupBy("id", "level").agg(F.min_by(F.struct("score", "found", "start", "end", "alike"), order).alias("_b")).filter("_b.alike")
    top = top.groupBy("id").agg(F.min_by("_b", "level").alias("_b")).select("id", "_b.score", "_b.found", "_b.start", "_b.end")
    return top.join(found.groupBy("id").agg(F.sum("windows").alias("windows"), F.sum("verified").alias("verified")), "id")


def two_stage(highlights: DataFrame, pages: DataFrame, books: DataFrame, book: str) -> DataFrame:
    """All highlights (id, book, page_number, text) with text, original_text, corrected and confidence.

    First they are looked for on the pages about theirs; what is found there is then looked for in the book's own text, if it is in ``books``.
    """
    last = pages.groupBy(book).agg(F.max("page_number").alias("pages"))
    first = page_search(highlights, pages, book)
    found = highlights.select("id", book, "page_number").join(first.select("id", F.col("found").alias("text")), "id").join(last, book)
    second = book_search(found, books, book)
    own = highlights.join(first.select("id", F.col("found").alias("page_text"), F.col("score").alias("page_score")), "id", "left").join(second.select("id", F.col("found").alias("book_text"), F.col("score").alias("book_score")), "id", "left")
    corrected = F.col("page_text").isNotNull()
    return own.select("id", F.coalesce("book_text", "page_text", "text").alias("text"), F.when(corrected, F.col("text")).alias("original_text"), corrected.alias("corrected"), (F.coalesce("book_score", "page_score") / 100.0).alias("confidence"))


def rematch(highlights: DataFrame, books: DataFrame, book: str, fallback: int = 317) -> DataFrame:
    """id and the new corrected_text and confidence of stored highlights (id, book, page_number, original_text, corrected_text) that a search of their books changes."""
    total = highlights.groupBy(book).agg(F.coalesce(F.max("page_number"), F.lit(fallback)).alias("pages"))
    wanted = highlights.select("id", book, "page_number", F.coalesce("original_text", "corrected_text").alias("text")).join(total, book)
    got = book_search(wanted, books, book, threshold=65).filter("score >= 85")
    return got.join(highlights.select("id", "corrected_text"), "id").filter(~F.col("found").eqNullSafe(F.col("corrected_text"))).select("id", F.col("found").alias("corrected_text"), (F.col("score") / 100.0).alias("confidence"))
