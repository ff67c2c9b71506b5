"""Dates in page texts, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The patterns of dates, in order of trust.
PAGE_DATES = [
    r"\*\*Date:\s*(\d{1,2}[-/.]\d{1,2}[-/.]\d{4})\*\*",
    r"Date:\s*(\d{1,2}[-/.]\d{1,2}[-/.]\d{4})",
    r"[⌐\[\(┌└╔╚]\s*(\d{1,2}[-/.]\d{1,2}[-/.]\d{4})\s*[┘\]\)┐┘╗╝]",
    r"[⌐\[\(┌└╔╚]\s*(\d{1,2}[-/.]\d{1,2}[-/.]\d{2})\s*[┘\]\)┐┘╗╝]",
    r"[⌐\[\(┌]?\s*(\d{1,2}[-/.]\d{1,2}[-/.]\d{4})\s*[┘\]\)┐]?",
    r"[⌐\[\(┌]?\s*(\d{1,2}[-/.]\d{1,2}[-/.]\d{2})\s*[┘\]\)┐]?",
    r"\b(\d{1,2}[-/.]\d{1,2}[-/.]\d{4})\b",
    r"\b(\d{1,2}[-/.]\d{1,2}[-/.]\d{2})\b",
]
#: Patterns of real calendar dates, in order, each with its format.
CALENDAR_DATES = [
    (r"\*\*Date:\s*(\d{1,2}-\d{1,2}-\d{4})\*\*", "d-M-yyyy"),
    (r"Date:\s*(\d{1,2}-\d{1,2}-\d{4})", "d-M-yyyy"),
    (r"(?m)^\*\*(\d{1,2}-\d{1,2}-\d{4})\*\*", "d-M-yyyy"),
    (r"(\d{1,2}-\d{1,2}-\d{4})", "d-M-yyyy"),
    (r"\*\*Date:\s*(\d{1,2}/\d{1,2}/\d{4})\*\*", "d/M/yyyy"),
    (r"(\d{1,2}/\d{1,2}/\d{4})", "d/M/yyyy"),
]


def normal_date(raw: Column) -> Column:
    """dd-mm-yyyy; null where the numbers can't be a date. Days of a month aren't checked. Years of two digits up to 30 are of this century."""
    parts = F.when(raw.contains("-"), F.split(raw, "-")).when(raw.contains("/"), F.split(raw, "/")).otherwise(F.split(raw, r"\."))
    day, month, year = (F.get(parts, F.lit(i)) for i in range(3))
    year = F.when(F.length(year) != 2, year).when(year.try_cast("int") <= 30, F.concat(F.lit("20"), year)).otherwise(F.concat(F.lit("19"), year))
    valid = (F.size(parts) == 3) & day.try_cast("int").between(1, 31) & month.try_cast("int").between(1, 12) & year.try_cast("int").between(1900, 2100)
    return F.when(valid, F.concat_ws("-", F.lpad(day, 2, "0"), F.lpad(month, 2, "0"), year))


def page_date(text: Column) -> Column:
    """The first valid date by the order of patterns, then of places. Null text: null."""
    found = F.concat(*[F.regexp_extract_all(text, F.lit(p), 1) for p in PAGE_DATES])
    return F.get(F.filter(F.transform(found, normal_date), lambda x: x.isNotNull()), F.lit(0))


def page_dates(text: Column) -> Column:
    """All valid dates, each once, in the order of page_date. Null text: null."""
    found = F.concat(*[F.regexp_extract_all(text, F.lit(p), 1) for p in PAGE_DATES])
    return F.array_distinct(F.filter(F.transform(found, normal_date), lambda x: x.isNotNull()))


def calendar_date(text: Column) -> Column:
    """The first pattern's first match that is a day of the calendar, as a date."""
    return F.coalesce(*[F.try_to_timestamp(F.regexp_extract(text, p, 1), F.lit(f)).cast("date") for p, f in CALENDAR_DATES])
