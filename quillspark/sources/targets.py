"""Sinks to remote services, and a mock one: a target says what becomes of each item, Spark hands the items out.

``sync`` is idempotent by content hash: equal items are sent once, and those that a table of earlier results has are skipped. Items are dealt to as
many tasks as connections are allowed, and each sends its batches no faster than its share of the rate.
"""

from __future__ import annotations

import hashlib
import sys
import time
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers needn't have this package

RESULTS = "content_hash string, target string, status string, external_id string, error string"


class Target:
    """What a service must do; a subclass is pickled to the workers, so it opens connections when it first sends."""

    name = "target"

    def sync(self, content_hash: str, item: dict) -> tuple[str, str | None, str | None]:
        """status (success or failed), external_id, error."""
        raise NotImplementedError

    def check_duplicate(self, content_hash: str) -> str | None:
        return None

    def update(self, external_id: str, item: dict) -> tuple[str, str | None, str | None]:
        raise NotImplementedError

    def delete(self, external_id: str) -> tuple[str, str | None, str | None]:
        raise NotImplementedError

    def info(self) -> dict:
        return {"target_name": self.name, "connected": True}

    def validate(self, item: dict) -> str | None:
        """Why an item can't be sent, or None."""
        return None


@dataclass
class MockTarget(Target):
    """Stores nothing. An item fails if its hash's hash is among the first ``fail_rate`` of all, so that reruns agree."""

    name: str = "mock"
    fail_rate: float = 0.0

    def sync(self, content_hash, item):
        if int(hashlib.md5(content_hash.encode()).hexdigest()[:8], 16) % 1000 < 1000 * self.fail_rate:
            return "failed", None, f"Mock failure (rate: {self.fail_rate})"
        return "success", f"mock_{content_hash[:12]}", None

    def update(self, external_id, item):
        known = external_id.startswith("mock_")
        return ("success", external_id, None) if known else ("failed", None, f"Mock item {external_id} not found")

    def delete(self, external_id):
        return self.update(external_id, {})

    def info(self):
        return super().info() | {"fail_rate": self.fail_rate}


@dataclass
class Rate:
    """Fixed values are the defaults: requests a minute less those held back, and items a request."""

    per_minute: int = 240
    reserve: int = 5
    batch: int = 50

    def pause(self, parallel: int) -> float:
        """Seconds between the requests of one of ``parallel`` senders."""
        return 60 * parallel / (self.per_minute - self.reserve)


def batches(rows: Iterator[dict], size: int) -> Iterator[list[dict]]:
    held: list[dict] = []
    for row in rows:
        held.append(row)
        if len(held) == size:
            yield held
            held = []
    if held:
        yield held


def sync(items: DataFrame, target: Target, done: DataFrame | None = None, parallel: int = 3, rate: Rate | None = None) -> DataFrame:
    """A result for each distinct content_hash of items (other columns are the item) that ``done`` has no success of. Null hashes aren't sent.

    Lazy: write the result once, as reading it sends again. rate: None sends as fast as it goes, as a mock may.
    """
    new = items.filter("content_hash is not null").dropDuplicates(["content_hash"])
    if done is not None:
        new = new.join(done.filter((F.col("status") == "success") & (F.col("target") == target.name)), "content_hash", "left_anti")

    def send(parts):
        rows = (dict(zip(b.columns, r, strict=True)) for b in parts for r in b.itertuples(index=False, name=None))
        for own in batches(rows, rate.batch if rate else 1000):
            began, out = time.monotonic(), []
            for row in own:
                h = row["content_hash"]
                if (why := target.validate(row)) is not None:
                    out.append((h, target.name, "failed", None, why))
                elif (have := target.check_duplicate(h)) is not None:
                    out.append((h, target.name, "skipped", have, None))
                else:
                    out.append((h, target.name, *target.sync(h, row)))
            if rate:
                time.sleep(max(0.0, rate.pause(parallel) - (time.monotonic() - began)))
            yield pd.DataFrame(out, columns=["content_hash", "target", "status", "external_id", "error"])

    return new.repartition(parallel, "content_hash").mapInPandas(send, RESULTS)
