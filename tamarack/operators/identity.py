"""One logical indicator from many rows: same observable, or hashes of one file."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tamarack.sources.shared import numbered
from tamarack.sources.tables import Tables

KEY = ["observable_type", "id"]


def resolved(artifacts: DataFrame) -> DataFrame:
    """artifact_id and artifact: itself, or what it was merged into (one hop)."""
    return artifacts.select("artifact_id", F.when((F.col("status") == "merged") & F.col("merged_into").isNotNull(), F.col("merged_into")).otherwise(F.col("artifact_id")).alias("artifact"))


def annotated(rows: DataFrame, t: Tables) -> DataFrame:
    """rows with artifact, its primary hash and the identity they belong to."""
    primary = t.hashes.where("is_primary").select(F.col("artifact_id").alias("artifact"), F.col("hash_type").alias("primary_type"), F.col("hash_value").alias("primary_value"))
    linked = t.links.join(resolved(t.artifacts), "artifact_id").select(*KEY, "artifact")
    own = F.concat(F.lit("o:"), "observable_type", F.lit(":"), F.lower("observable"))
    return rows.join(linked, KEY, "left").join(primary, "artifact", "left").withColumn("identity_key", F.coalesce(F.concat(F.lit("a:"), "artifact"), own))


def representative_order() -> list:
    """The primary hash first, then the stronger hash, the older row, the smaller id."""
    primary = (F.lower("observable") == F.lower("primary_value")) & (F.lower("observable_type") == F.lower("primary_type"))
    strength = F.when(F.lower("observable_type") == "sha256", 0).when(F.lower("observable_type") == "sha1", 1).when(F.lower("observable_type") == "md5", 2).otherwise(9)
    return [F.when(F.coalesce(primary, F.lit(False)), 0).otherwise(1), strength, F.col("created_at"), F.col("id")]


def identities(rows: DataFrame) -> DataFrame:
    """A row for each identity of annotated rows: bounds of times, newest status, and its representative.

    One aggregation: the representative is the least struct of rank and display columns, so nothing is sorted.
    """
    rank = [c.alias(f"r{i}") for i, c in enumerate(representative_order())]
    status = F.coalesce("status", F.lit("active"))
    best = F.min(F.struct(*rank, "public_id", "observable", "observable_type")).alias("best")
    newest = F.max_by(status, F.struct("created_at", "id")).alias("status")
    out = rows.groupBy("identity_key").agg(
        F.min("created_at").alias("imported_at"), F.min("first_seen_at").alias("first_seen_at"), F.max("last_seen_at").alias("last_seen_at"), newest, F.max("artifact").alias("artifact"), F.count("*").alias("n_rows"), best
    )
    return out.select("identity_key", F.col("best.r3").alias("id"), "best.public_id", "best.observable", "best.observable_type", "imported_at", "first_seen_at", "last_seen_at", "status", "artifact", "n_rows")


def page(found: DataFrame, limit: int, cursor: tuple | None = None) -> DataFrame:
    """The next ``limit`` identities, newest first, after the cursor (imported_at, id)."""
    if cursor is not None:
        at, last = F.lit(cursor[0]).cast(found.schema["imported_at"].dataType), F.lit(cursor[1])
        found = found.where((F.col("imported_at") < at) | ((F.col("imported_at") == at) & (F.col("id") < last)))
    return found.orderBy(F.col("imported_at").desc(), F.col("id").desc()).limit(limit)


def positions(found: DataFrame, *order, name: str = "position") -> DataFrame:
    """Dense numbers from 1 in a global order."""
    return numbered(found, *order, name=name)


def browse(rows: DataFrame) -> DataFrame:
    """For each identity the sorted distinct sources, confidences and categories, and how many sources there are."""
    names = lambda c: F.array_sort(F.collect_set(c))
    return rows.groupBy("identity_key").agg(F.count_distinct("source_name").alias("source_count"), names("source_name").alias("sources"), names(F.lower("confidence")).alias("confidences"), names("category").alias("categories"))


def closure(keys: DataFrame, rows: DataFrame, links: DataFrame) -> DataFrame:
    """keys and the rows that share an observable or an artifact with one of them."""
    same = keys.join(rows.select(*KEY, "observable"), KEY).select("observable_type", "observable").distinct().join(rows.select(*KEY, "observable"), ["observable_type", "observable"]).select(*KEY)
    files = keys.join(links, KEY).select("artifact_id").distinct().join(links, "artifact_id").select(*KEY)
    return keys.select(*KEY).union(same).union(files).distinct()
