"""SHA-256 of records as Python's json module writes them: sorted keys, ", " and ": ", ASCII only, shortest floats."""

from __future__ import annotations

import hashlib
import json
import sys
from collections.abc import Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers needn't have this package


@F.pandas_udf(T.StringType())
def _digest(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for column in parts:
        yield column.map(lambda x: hashlib.sha256(json.dumps(json.loads(x), sort_keys=True, ensure_ascii=True).encode()).hexdigest())


def record_hash(**fields: Column) -> Column:
    """Of any record; null fields are left out before, so give them a value."""
    return _digest(F.to_json(F.struct(*[c.alias(k) for k, c in fields.items()])))


def _text(c: Column) -> Column:
    return F.coalesce(F.trim(c), F.lit(""))


def notebook_hash(title: Column, author: Column, text: Column, page_count: Column) -> Column:
    return record_hash(title=_text(title), author=_text(author), text_content=_text(text), page_count=F.coalesce(page_count, F.lit(0)), type=F.lit("notebook"))


def page_hash(notebook_uuid: Column, page_number: Column, text: Column, confidence: Column) -> Column:
    return record_hash(notebook_uuid=F.coalesce(notebook_uuid, F.lit("")), page_number=F.coalesce(page_number, F.lit(0)), text=_text(text), confidence=F.coalesce(confidence, F.lit(0.0)), type=F.lit("page_text"))


def todo_hash(text: Column, notebook_uuid: Column, page_number: Column) -> Column:
    return record_hash(text=_text(text), notebook_uuid=F.coalesce(notebook_uuid, F.lit("")), page_number=page_number, type=F.lit("todo"))


def highlight_hash(text: Column, corrected_text: Column, source_file: Column, page_number: Column) -> Column:
    return record_hash(text=_text(text), corrected_text=_text(corrected_text), source_file=F.coalesce(source_file, F.lit("")), page_number=page_number, type=F.lit("highlight"))
