"""Feeds as streams: files that arrive are parsed, merged into memberships, and expired in micro-batches."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.window import Window

from tamarack.operators.joins import membership_outcomes
from tamarack.sources.feeds import text_feed
from tamarack.sources.shared import remove

MEMBERSHIP = "observable string, observable_type string, feed_id string, first_seen timestamp, last_seen timestamp, status string, fingerprint string, missing_since timestamp, override_enabled boolean"
KEY = ["observable", "observable_type", "feed_id"]


def memberships(lines: DataFrame, feed_id: str, seen: datetime) -> DataFrame:
    """Lines of a feed as memberships seen now; repeated values once."""
    rows = text_feed(lines).where("observable is not null and error is null").select("observable", "observable_type").distinct()
    return rows.select("observable", "observable_type", F.lit(feed_id).alias("feed_id"), F.lit(seen).alias("first_seen"), F.lit(seen).alias("last_seen"), F.sha2("observable", 256).alias("fingerprint"))


class MembershipTable:
    """A table of memberships in generations: each write makes a new folder, readers keep theirs.

    A generation is written under its batch number, so a batch that runs again after a failure writes the same one.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _generations(self) -> list[int]:
        jvm = self.spark._jvm
        where = jvm.org.apache.hadoop.fs.Path(self.path)
        fs = where.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(where):
            return []
        names = [(f.getPath().getName(), fs.exists(jvm.org.apache.hadoop.fs.Path(f.getPath(), "_SUCCESS"))) for f in fs.listStatus(where)]
        return sorted(int(n.removeprefix("g=")) for n, done in names if n.startswith("g=") and done)

    def read(self, before: int | None = None) -> DataFrame:
        """The last complete generation, or the last one before a batch."""
        have = [g for g in self._generations() if before is None or g < before]
        return self.spark.read.schema(MEMBERSHIP).parquet(f"{self.path}/g={have[-1]}") if have else self.spark.createDataFrame([], MEMBERSHIP)

    def write(self, rows: DataFrame, generation: int) -> None:
        rows.write.mode("overwrite").parquet(f"{self.path}/g={generation}")

    def collect(self, keep: int = 2, pinned: tuple[int, ...] = ()) -> list[int]:
        """Deletes complete generations but the last ``keep`` and those that readers have pinned; gives what went."""
        gone = [g for g in self._generations()[: -max(1, keep)] if g not in pinned]
        for g in gone:
            remove(self.spark, f"{self.path}/g={g}")
        return gone


def merged(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """The table after a batch of incoming memberships: theirs as the merge gives them, the others as they were."""
    new = membership_outcomes(stored, incoming, KEY)
    kept = stored.join(incoming.select(*KEY), KEY, "left_anti")
    held = stored.select(*KEY, "override_enabled")
    new = new.drop("outcome").join(held, KEY, "left").withColumn("missing_since", F.lit(None).cast("timestamp"))
    return kept.unionByName(new.select(*kept.columns))


def expired(rows: DataFrame, now: datetime, ttl_days: int) -> DataFrame:
    """Memberships whose time is over become expired, unless their status is held."""
    over = (F.col("last_seen") + F.make_dt_interval(F.lit(ttl_days)) <= F.lit(now)) & ~F.coalesce("override_enabled", F.lit(False))
    return rows.withColumn("status", F.when(over, "expired").otherwise(F.col("status")))


def follow(spark: SparkSession, folder: str, feed_id: str, table: MembershipTable, checkpoint: str, clock: Callable[[], datetime], ttl_days: int | None = None) -> StreamingQuery:
    """Reads text files that arrive in a folder and merges each micro-batch into the table.

    With ``ttl_days``, memberships that no batch has seen for so long expire with the batch.
    """

    def batch(lines: DataFrame, number: int) -> None:
        now = clock()
        rows = merged(table.read(before=number), memberships(lines, feed_id, now))
        table.write(rows if ttl_days is None else expired(rows, now, ttl_days), number)

    return spark.readStream.format("text").load(folder).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, every: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Counts of a stream of events by window and type, closed when the watermark has passed."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", every), "event_type").agg(F.count("*").alias("n")).select("window.start", "event_type", "n")


def latest(rows: DataFrame, key: list[str], at: str) -> DataFrame:
    """The last version of each key of a change log."""
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy(*key).orderBy(F.col(at).desc()))).where("_r = 1").drop("_r")
