"""Queries that replay tables through streams with keyed state."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.plans.adapters import run, with_domain
from quillspark.streaming import spaced


def r2_cooldown(spark, sf_dir):
    """Events of a user that come six hours or more after the last one that passed."""
    own = run(spark, sf_dir, "SELECT user_id, event_id, ts FROM events").withColumn("ts", F.timestamp_micros(F.expr("timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', ts)")))
    passed = spaced.replayed(spark, own, "ts", lambda stream, late: spaced.apart(stream, ["user_id"], "ts", "event_id", 21_600_000_000, late=late), 21_600_000_000)
    return passed.select("user_id", "event_id")


def r3_lock(spark, sf_dir):
    """Of a notebook's changes, those that find it unlocked: five seconds after the last that did."""
    own = run(spark, sf_dir, with_domain("SELECT notebook_uuid, id, synced_ms FROM d_sync")).select("notebook_uuid", "id", F.timestamp_millis("synced_ms").alias("ts"))
    passed = spaced.replayed(spark, own, "ts", lambda stream, late: spaced.apart(stream, ["notebook_uuid"], "ts", "id", 5_000_000, late=late), 5_000_000)
    return passed.select("notebook_uuid", F.unix_millis("ts").alias("at_ms"))


def g1_dedup_stream(spark, sf_dir):
    """g1_dedup as a stream: changes more than five minutes after the last stored one of their key. Those without a whole key have no state."""
    own = run(spark, sf_dir, with_domain("SELECT source_table, source_id, operation, hash_after, id, changed_ms FROM d_log")).withColumn("ts", F.timestamp_millis("changed_ms"))
    keys = ["source_table", "source_id", "operation", "hash_after"]
    whole = own.filter(" and ".join(f"{k} is not null" for k in keys)).select(*keys, "id", "ts")
    stored = spaced.replayed(spark, whole, "ts", lambda stream, late: spaced.apart(stream, keys, "ts", "id", 300_000_000, strict=True, late=late), 300_000_000)
    return stored.select("id").unionByName(own.filter(" or ".join(f"{k} is null" for k in keys)).select("id"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (r2_cooldown, r3_lock, g1_dedup_stream)}
