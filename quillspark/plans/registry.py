"""All queries of the notes engine, with SQL for the oracle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quillspark.plans import changes, devices, logs, more, notes, oracles, relational, streams
from quillspark.plans.adapters import run, to_duckdb, with_domain

SQL = relational.SQL | changes.SQL
FUNCTIONS = notes.QUERIES | devices.QUERIES | more.QUERIES | streams.QUERIES | logs.QUERIES


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: lambda spark, sf_dir, sql=with_domain(v): run(spark, sf_dir, sql) for k, v in SQL.items() if k not in FUNCTIONS} | FUNCTIONS


def oracle_sql() -> dict[str, str]:
    """Asked in another way where there is one (oracles.py, and all that isn't SQL in Spark); else the query's own SQL, so that two engines agree."""
    same = {k: to_duckdb(with_domain(v)) for k, v in SQL.items()}
    return same | {k: with_domain(v) for k, v in (notes.ORACLE | devices.ORACLE | more.ORACLE | logs.ORACLE | oracles.SQL).items()}
