"""Every relational query against the same question asked of DuckDB."""

import math
from collections import Counter
from pathlib import Path

import duckdb
import pytest

from quillspark.plans import registry


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for p in Path(sf).iterdir():
        con.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


def plain(x):
    return round(x, 9) if isinstance(x, float) and not math.isnan(x) else x


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_against_duckdb(spark, sf, duck, name):
    if name not in registry.oracle_sql():
        first, again = (Counter(map(str, registry.queries()[name](spark, sf).collect())) for _ in range(2))
        assert first == again and first  # what they return is held against plain Python in test_notes.py and test_more.py
        return
    got = registry.queries()[name](spark, sf)
    want = duck.sql(registry.oracle_sql()[name])
    order = sorted(got.columns)
    assert order == sorted(want.columns)
    rows = lambda columns, all_: Counter(tuple(plain(dict(zip(columns, r, strict=True))[c]) for c in order) for r in all_)
    assert rows(got.columns, map(tuple, got.collect())) == rows(want.columns, want.fetchall())
