"""What needs a sync, kept up with the changes: a batch reads the pages that it touches, retracts them from their notebook's counts and adds them anew."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.shared import table
from quillspark.sources.log import ChangeLog

STATE = "page_uuid string, notebook_uuid string, text_hash string, meant boolean, synced_hash string, synced_ms bigint, synced_id bigint"
COUNTS = "notebook_uuid string, state string, pages bigint"


def state_of(text_hash: Column, synced_hash: Column) -> Column:
    """Null for a page that isn't there."""
    return F.when(text_hash.isNull(), None).when(synced_hash.isNull(), "NEVER_SYNCED").when(synced_hash != text_hash, "STALE").otherwise("UP_TO_DATE")


class Pending:
    """Two logs below a folder: pages with the hash of their text and of their last success, and counts by notebook and state.

    A batch is written to the first, then to the second, both from what held before it, so one that is stopped between is run again under its number.
    """

    def __init__(self, spark: SparkSession, folder: str, buckets: int = 64):
        self.folder = folder
        self.pages = ChangeLog(spark, f"{folder}/pages", ["page_uuid"], STATE, buckets)
        self.counts_log = ChangeLog(spark, f"{folder}/counts", ["notebook_uuid", "state"], COUNTS, buckets)

    def apply(self, pages: DataFrame, syncs: DataFrame, batch: int) -> None:
        """pages: page_uuid, notebook_uuid, text_hash (null: deleted), meant (worth a sync), updated_ms; syncs: page_uuid, content_hash, synced_ms, id of successes.

        The last row of a page by updated_ms counts, in a batch; over batches, the later batch. Of successes the newest counts, by synced_ms and id,
        in whatever batch it comes. Null page_uuids are left out.
        """
        page = pages.filter("page_uuid is not null").groupBy("page_uuid").agg(F.max_by(F.struct("notebook_uuid", "text_hash", "meant"), F.struct("updated_ms", "text_hash")).alias("p"))
        sync = syncs.filter("page_uuid is not null").groupBy("page_uuid").agg(F.max(F.struct("synced_ms", "id", "content_hash")).alias("s"))
        change = table(page.join(sync, "page_uuid", "full"), f"{self.folder}/change-{batch}")
        old = self.pages.of(change, batch).select("page_uuid", F.struct(*[f.name for f in self.pages.schema][1:]).alias("o"))
        both = change.join(old, "page_uuid", "left")
        newer = F.col("s").isNotNull() & (F.col("o.synced_ms").isNull() | (F.struct("s.synced_ms", "s.id") >= F.struct(F.col("o.synced_ms").alias("synced_ms"), F.col("o.synced_id").alias("id"))))
        from_page = lambda c: F.when(F.col("p").isNotNull(), F.col(f"p.{c}")).otherwise(F.col(f"o.{c}"))
        from_sync = lambda new, c: F.when(newer, F.col(f"s.{new}")).otherwise(F.col(f"o.{c}"))
        new = both.select("page_uuid", *[from_page(c).alias(c) for c in ("notebook_uuid", "text_hash", "meant")], from_sync("content_hash", "synced_hash").alias("synced_hash"), from_sync("synced_ms", "synced_ms").alias("synced_ms"), from_sync("id", "synced_id").alias("synced_id"), F.col("o.notebook_uuid").alias("old_nb"), state_of(F.col("o.text_hash"), F.col("o.synced_hash")).alias("old_state"))
        new = table(new, f"{self.folder}/new-{batch}")
        self.pages.put(new, batch)
        add = new.select("notebook_uuid", state_of(F.col("text_hash"), F.col("synced_hash")).alias("state"), F.lit(1).alias("n"))
        retract = new.select(F.col("old_nb").alias("notebook_uuid"), F.col("old_state").alias("state"), F.lit(-1).alias("n"))
        delta = add.unionByName(retract).filter("state is not null").groupBy("notebook_uuid", "state").agg(F.sum("n").alias("n")).filter("n <> 0")
        delta = table(delta, f"{self.folder}/delta-{batch}")
        had = self.counts_log.of(delta, batch).select(F.col("notebook_uuid").alias("nb"), F.col("state").alias("st"), "pages")
        total = delta.join(had, F.col("notebook_uuid").eqNullSafe(F.col("nb")) & (F.col("state") == F.col("st")), "left")
        total = total.select("notebook_uuid", "state", (F.coalesce("pages", F.lit(0)) + F.col("n")).alias("pages"))
        self.counts_log.put(total, batch, gone=F.col("pages") == 0)

    def compact(self, batch: int) -> None:
        self.pages.compact(batch)
        self.counts_log.compact(batch)

    def counts(self) -> DataFrame:
        return self.counts_log.view()

    def plan(self) -> DataFrame:
        """page_uuid and why of the pages worth a sync that miss one."""
        state = state_of(F.col("text_hash"), F.col("synced_hash"))
        return self.pages.view().filter("meant").select("page_uuid", F.when(state == "NEVER_SYNCED", "missing").when(state == "STALE", "stale").alias("why")).filter("why is not null")
