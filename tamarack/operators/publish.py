"""Published feeds: filters, windows, deduplication, serialised forms, chunks, differences, incremental refresh."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from datetime import datetime, timedelta
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tamarack.functions.network import is_private
from tamarack.functions.text import bucket, csv_cell, csv_time, uuid5
from tamarack.operators.fusion import confidence_score, membership_times
from tamarack.operators.identity import KEY, annotated, representative_order
from tamarack.sources.tables import Tables

# fixed values: types of a feed, windows in days, chunk sizes, names of patterns
FEED_TYPES = {"ip": ["ip"], "domain": ["domain"], "url": ["url"], "hash": ["md5", "sha1", "sha256"], "email": ["email"]}
WINDOWS = {"1d": 1, "3d": 3, "7d": 7}
CHUNK_ROWS, CHUNKS_LEAST, CHUNKS_MOST = 5000, 64, 512
STIX_NAMESPACE = "6ba7b810-9dad-11d1-80b4-00c04fd430c8"
PATTERNS = {"domain": "domain-name:value", "url": "url:value", "email": "email-addr:value", "md5": "file:hashes.MD5", "sha1": "file:hashes.'SHA-1'", "sha256": "file:hashes.'SHA-256'"}


@dataclass(frozen=True)
class Feed:
    """What a feed publishes."""

    types: tuple[str, ...] = ("domain",)
    window: str = "all"
    exclude_expired: bool = True
    exclude_false_positives: bool = True
    min_confidence: int = 0
    include_tags: tuple[str, ...] = ()
    exclude_tags: tuple[str, ...] = ()
    sources: tuple[str, ...] = ()
    max_items: int | None = None
    flags: dict = field(default_factory=dict)


def recency() -> Column:
    return F.coalesce("last_seen_log", "last_seen_at", "created_at")


def in_window(at: Column, now: datetime, window: str) -> Column:
    """Whether a time lies in the window that ends now; its lower end belongs to it."""
    return F.lit(True) if window == "all" else at >= F.lit(now - timedelta(days=WINDOWS[window])).cast("timestamp_ntz")


def departures(rows: DataFrame, before: datetime, now: datetime, window: str) -> DataFrame:
    """Rows that were in the window at an earlier time and only by time have left it now."""
    days = timedelta(days=WINDOWS[window])
    low, high = (F.lit(x - days).cast("timestamp_ntz") for x in (before, now))
    return rows.where((recency() >= low) & (recency() < high))


def eligible(t: Tables, feed: Feed, now: datetime, items: DataFrame | None = None) -> DataFrame:
    """The rows that pass all filters of a feed, with recency and score."""
    rows = (t.items if items is None else items).where(F.col("observable_type").isin(*(x for k in feed.types for x in FEED_TYPES[k])))
    category = F.lower(F.coalesce("category", F.lit("")))
    status = F.coalesce("status", F.lit("active"))
    rows = rows.where(status != "suppressed")
    if feed.exclude_false_positives:
        rows = rows.where(~category.like("%false%positive%") & (category != "fp"))
    if feed.exclude_expired:
        rows = rows.where(status == "active")
    if feed.sources:
        feeds = t.memberships.where("status = 'active'").join(t.feeds.where(F.col("feed_key").isin(*feed.sources)), "feed_id").select(*KEY)
        named = rows.where(F.lower("source_name").isin(*(s.lower() for s in feed.sources))).select(*KEY)
        rows = rows.join(feeds.union(named), KEY, "left_semi")
    if feed.include_tags:
        rows = rows.join(t.tags.where("enabled").where(F.col("tag").isin(*feed.include_tags)), KEY, "left_semi")
    if feed.exclude_tags:
        rows = rows.join(t.tags.where(F.col("tag").isin(*feed.exclude_tags)), KEY, "left_anti")
    rows = rows.withColumn("recency", recency()).withColumn("score", confidence_score("confidence"))
    return rows.where(in_window(F.col("recency"), now, feed.window) & (F.col("score") >= feed.min_confidence))


def line() -> Column:
    """A published value: domains, hashes and addresses of mail in lower case, private addresses not at all."""
    value = F.trim("observable")
    folded_types = [x for k in ("domain", "hash", "email") for x in FEED_TYPES[k]]
    return F.when(value == "", None).when(F.col("observable_type").isin(*folded_types), F.lower(value)).when((F.col("observable_type") == "ip") & is_private(value), None).otherwise(value)


def selected(rows: DataFrame, max_items: int | None = None) -> DataFrame:
    """One row for each published value, without regard to case: the most recent, then surest, then least one.

    A grouped minimum, so a value that many rows share costs one row a task. Ordering and the limit come after it.
    """
    order = F.struct((-F.unix_micros(F.col("recency").cast("timestamp"))).alias("a"), (-F.col("score")).alias("b"), F.col("observable").alias("c"), F.col("id").alias("d"))
    lined = rows.withColumn("line", line()).where("line is not null")
    best = lined.groupBy(F.lower("line").alias("value_key")).agg(F.min(F.struct(order.alias("o"), "line", "observable_type", "id", "recency", "score", "created_at", "last_seen_at")).alias("best"))
    out = best.select("best.line", "best.observable_type", "best.id", "best.recency", "best.score", "best.created_at", "best.last_seen_at")
    return out if max_items is None else out.orderBy(*published_order()).limit(max_items)


def published_order() -> list[Column]:
    return [F.col("recency").desc(), F.col("score").desc(), F.col("line")]


def one_per_identity(t: Tables, rows: DataFrame) -> DataFrame:
    """For each identity its most recent row, then the primary or strongest hash, then the smaller id."""
    a = annotated(rows, t)
    primary, strength, _, _ = representative_order()
    order = F.struct((-F.unix_micros(F.col("recency").cast("timestamp"))).alias("a"), primary.alias("b"), strength.alias("c"), F.col("id").alias("d"))
    return a.groupBy("identity_key").agg(F.min(F.struct(order.alias("o"), "observable", "observable_type", "id", "recency", "score")).alias("best")).select("identity_key", "best.observable", "best.observable_type", "best.id", "best.recency", "best.score")


def json_items(rows: DataFrame, timestamps: bool = True, sources: DataFrame | None = None, classification: DataFrame | None = None) -> DataFrame:
    """A JSON object for each selected row; what is optional is left out, or joined from tables by key."""
    day = lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss'Z'")
    parts = [F.col("line").alias("value"), F.col("observable_type").alias("type"), F.col("score").alias("confidence")]
    if timestamps:
        parts += [day("created_at").alias("first_seen"), day("last_seen_at").alias("last_seen")]
    for table, name in ((sources, "sources"), (classification, "classification")):
        if table is not None:
            rows = rows.join(table.select(*KEY, name), KEY, "left")
            parts.append(F.coalesce(name, F.array().cast("array<string>")).alias(name))
    return rows.select("line", F.to_json(F.struct(*parts)).alias("item"))


def stix_pattern() -> Column:
    value = F.replace(F.replace(F.trim("line"), F.lit("\\"), F.lit("\\\\")), F.lit("'"), F.lit("\\'"))
    out = None
    for kind, path in PATTERNS.items():
        this = F.concat(F.lit(f"[{path} = '"), value, F.lit("']"))
        out = F.when(F.col("observable_type") == kind, this) if out is None else out.when(F.col("observable_type") == kind, this)
    for kind, path in (("ip", "ipv4-addr:value"), ("ipv6", "ipv6-addr:value")):
        mark = F.when(value.contains("/"), " ISSUBSET '").otherwise(" = '")
        out = out.when(F.col("observable_type") == kind, F.concat(F.lit(f"[{path}"), mark, value, F.lit("']")))
    return out


def stix_objects(rows: DataFrame) -> DataFrame:
    """Indicator objects of selected rows; those without a creation or last time, or a pattern, are left out."""
    name = F.concat(F.lit("indicator:"), "observable_type", F.lit(":"), F.lower(F.trim("line")))
    out = rows.withColumn("pattern", stix_pattern()).where("pattern is not null and created_at is not null and last_seen_at is not null")
    return out.select("line", F.concat(F.lit("indicator--"), uuid5(STIX_NAMESPACE, name)).alias("stix_id"), "pattern", F.col("created_at").alias("created"), F.greatest("created_at", "last_seen_at").alias("modified"))


def chunk_count(rows: int) -> int:
    """The power of two nearest to the chunks that CHUNK_ROWS each would need, within bounds."""
    want = max(1, -(-rows // CHUNK_ROWS))
    high = 1 << (want - 1).bit_length()
    low = max(1, high // 2)
    return min(CHUNKS_MOST, max(CHUNKS_LEAST, low if want - low < high - want else high))


def chunk_manifest(rows: DataFrame, count: int) -> DataFrame:
    """Rows and a digest of each chunk; a digest adds up digests of lines, so no chunk is gathered in one place."""
    key = F.concat(F.lit("o:"), "observable_type", F.lit(":"), F.lower("line"))
    part = F.conv(F.substring(F.md5("line"), 1, 8), 16, 10).cast("long")
    return rows.withColumn("chunk_key", bucket(key, count)).groupBy("chunk_key").agg(F.count("*").alias("items"), F.sum(part).alias("digest"))


def etag(digest: str, types: str, window: str, limit: int | None) -> Column:
    return F.substring(F.sha2(F.lit(f"{digest}|{types}|{window}|{limit or ''}"), 256), 1, 32)


def preview(old: DataFrame, new: DataFrame, key: str = "line") -> DataFrame:
    """How many values a change adds, removes and leaves."""
    both = old.select(key, F.lit(1).alias("o")).join(new.select(key, F.lit(1).alias("n")), key, "full")
    return both.agg(F.count_if(F.col("o").isNull()).alias("added"), F.count_if(F.col("n").isNull()).alias("removed"), F.count_if(F.col("o").isNotNull() & F.col("n").isNotNull()).alias("unchanged"))


def projection(t: Tables, feed: Feed, now: datetime, items: DataFrame | None = None) -> DataFrame:
    """The materialised rows of a feed: identity, value, recency, score and a fingerprint of what is published."""
    rows = one_per_identity(t, eligible(t, feed, now, items))
    return rows.select("identity_key", "observable_type", "observable", "recency", "score", F.substring(F.sha2(F.to_json(F.struct("observable", "observable_type", "score", "recency")), 256), 1, 32).alias("fingerprint"))


def dirty_keys(changed: DataFrame, t: Tables) -> DataFrame:
    """Identities that changed rows belong to, and with them all rows of these identities."""
    every = annotated(t.items, t).select("identity_key", *KEY)
    return every.join(changed.select(*KEY).distinct(), KEY, "left_semi").select("identity_key").distinct()


def refreshed(old: DataFrame, t: Tables, feed: Feed, now: datetime, changed: DataFrame) -> DataFrame:
    """The projection after changes, from the old one and the dirty identities only; equal to a full projection."""
    dirty = dirty_keys(changed, t)
    rows = annotated(t.items, t).join(dirty, "identity_key", "left_semi").select(*t.items.columns)
    return old.join(dirty, "identity_key", "left_anti").unionByName(projection(t, feed, now, rows))


def delta(old: DataFrame, new: DataFrame) -> DataFrame:
    """What a refresh did to each identity it touched: entered, updated or left."""
    o, n = old.select("identity_key", F.col("fingerprint").alias("was")), new.select("identity_key", F.col("fingerprint").alias("is_now"))
    kind = F.when(F.col("was").isNull(), "entered").when(F.col("is_now").isNull(), "left").when(F.col("was") != F.col("is_now"), "updated")
    return o.join(n, "identity_key", "full").select("identity_key", kind.alias("change")).where("change is not null")


def refresh_mode(state: str | None, watermark_moved: bool, window_moved: bool, tags_changed: bool, dirty: int, most: int = 100_000) -> str:
    """noop, incremental, full or bootstrap."""
    if state != "ready":
        return "bootstrap"
    if tags_changed or dirty > most:
        return "full"
    return "incremental" if watermark_moved or window_moved or dirty else "noop"


def reconciliation_slice(rows: DataFrame, slice_: int, slices: int = 256) -> DataFrame:
    """The part of a projection that one sweep compares."""
    return rows.where(bucket("identity_key", slices) == slice_)


@dataclass(frozen=True)
class SourceRules:
    """Sources that a feed takes its rows from; a row of any of them counts."""

    exact: tuple[str, ...] = ()
    prefixes: tuple[str, ...] = ()
    includes: tuple[str, ...] = ()
    feed_keys: tuple[str, ...] = ()
    feed_prefixes: tuple[str, ...] = ()
    manual: tuple[int, ...] = ()


def of_sources(rows: DataFrame, t: Tables, rules: SourceRules) -> DataFrame:
    """Rows whose own source, desk or active feed one of the rules names."""
    own = F.lower(F.coalesce("source_name", F.lit("")))
    hit = own.isin(*(x.lower() for x in rules.exact)) | F.coalesce(F.col("ioc_source_id").isin(*rules.manual), F.lit(False))
    for p in rules.prefixes:
        hit = hit | own.startswith(p.lower())
    key, name = F.lower("feed_key"), F.lower("feed_name")
    wanted = key.isin(*(x.lower() for x in rules.feed_keys))
    for p in rules.feed_prefixes:
        wanted = wanted | key.startswith(p.lower())
    for part in rules.includes:
        hit, wanted = hit | own.contains(part.lower()), wanted | name.contains(part.lower())
    members = t.memberships.where("status = 'active'").join(t.feeds.where(wanted), "feed_id").select(*KEY).distinct().withColumn("_in", F.lit(True))
    return rows.join(members, KEY, "left").where(hit | F.coalesce("_in", F.lit(False))).drop("_in")


def curated(rows: DataFrame, public_ids: tuple[str, ...], listed: DataFrame | None) -> DataFrame:
    """Rows that a curated feed lists, by public id or as keys of a table; without either there are none."""
    if not public_ids and listed is None:
        return rows.where(F.lit(False))
    named = F.col("public_id").isin(*public_ids)
    if listed is None:
        return rows.where(named)
    flagged = rows.join(listed.select(*KEY).distinct().withColumn("_in", F.lit(True)), KEY, "left")
    return flagged.where(F.coalesce(named, F.lit(False)) | F.coalesce("_in", F.lit(False))).drop("_in")


def text_digest(rows: DataFrame, types: str, window: str, limit: int) -> DataFrame:
    """lines, content_sha256 and etag of the text of a bounded feed: its first lines, each with an end.

    The limit bounds what one task puts together; feeds without one are written in chunks.
    """
    top = rows.orderBy(*published_order()).limit(limit)
    order = F.struct((-F.unix_micros(F.col("recency").cast("timestamp"))).alias("a"), (-F.col("score")).alias("b"), "line")
    text = F.concat(F.array_join(F.transform(F.array_sort(F.collect_list(order)), lambda x: x["line"]), "\n"), F.lit("\n"))
    whole = top.agg(F.count("*").cast("int").alias("lines"), F.sha2(text, 256).alias("content_sha256"))
    return whole.select("lines", "content_sha256", F.substring(F.sha2(F.concat("content_sha256", F.lit(f"|{types}|{window}|{limit}")), 256), 1, 32).alias("etag"))


def chunk_files(rows: DataFrame, count: int) -> DataFrame:
    """chunk_key, items, text, content_sha256 and a strong etag of every chunk; ``count`` follows the rows, so that a chunk has a bound."""
    key = F.concat(F.lit("o:"), "observable_type", F.lit(":"), F.lower("line"))
    text = F.concat(F.array_join(F.array_sort(F.collect_list("line")), "\n"), F.lit("\n"))
    chunks = rows.select(bucket(key, count).alias("chunk_key"), "line").groupBy("chunk_key").agg(F.count("*").alias("items"), text.alias("text"))
    chunks = chunks.withColumn("content_sha256", F.sha2("text", 256))
    return chunks.withColumn("etag", F.concat(F.lit('"'), F.substring("content_sha256", 1, 32), F.lit('"')))


def chunk_digests(rows: DataFrame, count: int) -> DataFrame:
    """chunk_files without the texts, for any count: a chunk's lines are sorted and hashed as they come, so it needs no bound."""

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done = lambda: pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([items], pa.int64()), pa.array([digest.hexdigest()])], ["chunk_key", "items", "content_sha256"])
        at, items, digest = None, 0, hashlib.sha256()
        for batch in batches:
            for key, found in groupby(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()), lambda x: x[0]):
                if key != at:
                    if items:
                        yield done()
                    at, items, digest = key, 0, hashlib.sha256()
                lines = [line for _, line in found]
                items += len(lines)
                digest.update(("\n".join(lines) + "\n").encode())
        if items:
            yield done()

    key = F.concat(F.lit("o:"), "observable_type", F.lit(":"), F.lower("line"))
    dealt = rows.select(bucket(key, count).alias("chunk_key"), "line").repartition("chunk_key").sortWithinPartitions("chunk_key", "line")
    chunks = dealt.mapInArrow(digests, "chunk_key int, items long, content_sha256 string")
    return chunks.withColumn("etag", F.concat(F.lit('"'), F.substring("content_sha256", 1, 32), F.lit('"')))


def write_chunks(chunks: DataFrame, folder: str) -> None:
    """One folder for each chunk, with its text, and the manifest beside them."""
    chunks.select("chunk_key", F.expr("rtrim('\n', text)").alias("value")).write.partitionBy("chunk_key").mode("overwrite").text(f"{folder}/chunks")
    chunks.drop("text").write.mode("overwrite").json(f"{folder}/manifest")


def fingerprint(projected: DataFrame) -> DataFrame:
    """identities, newest and sure ones of a projection: one row to compare generations by."""
    return projected.agg(F.count_distinct("identity_key").alias("identities"), F.max("recency").alias("newest"), F.count_if(F.col("score") >= 50).alias("sure"))


def generation_decision(before: DataFrame | None, after: DataFrame) -> DataFrame:
    """decision: build, or skip where the fingerprint (one row each) is that of the generation before."""
    if before is None:
        return after.select(F.lit("build").alias("decision"))
    was = before.select(F.struct(*before.columns).alias("was"))
    # one row each
    return after.select(F.struct(*before.columns).alias("is_now")).crossJoin(F.broadcast(was)).select(F.when(F.col("was").eqNullSafe(F.col("is_now")), "skip").otherwise("build").alias("decision"))


def changes(old: DataFrame, new: DataFrame, most: int, key: str = "line") -> DataFrame:
    """The first values, without regard to case, that stand on one side only."""
    o, n = (x.select(F.lower(key).alias("value")).distinct() for x in (old, new))
    both = o.withColumn("o", F.lit(1)).join(n.withColumn("n", F.lit(1)), "value", "full").where("o is null or n is null")
    return both.select("value", F.when(F.col("o").isNull(), "added").otherwise("removed").alias("change")).orderBy("change", "value").limit(most)


def active_source_keys(t: Tables) -> DataFrame:
    """The keys of the feeds that a row is in now, sorted."""
    return t.memberships.where("status = 'active'").join(t.feeds, "feed_id").groupBy(*KEY).agg(F.array_sort(F.collect_set("feed_key")).alias("sources"))


# fixed values: keys and headers of the columns that an export may have
EXPORT_HEADERS = {
    "ioc": "IOC",
    "ioc_type": "IOC Type",
    "status": "Status",
    "source": "Source",
    "confidence": "Confidence",
    "tags": "Tags",
    "classifications": "Classifications",
    "threat_actor": "Threat actor",
    "first_seen_in_source": "First seen in source",
    "last_seen_in_source": "Last seen in source",
    "last_changed_in_source": "Last changed in source",
    "created_at": "Created at",
    "imported_at": "Imported at",
    "artifact_id": "Artifact ID",
    "primary_hash_type": "Primary hash type",
    "primary_hash_value": "Primary hash value",
    "linked_ioc_public_ids": "Linked IOC public IDs",
    "known_hashes": "Known hashes",
}


def export_columns(asked: tuple[str, ...]) -> list[str]:
    """The asked columns that there are, each once, in the order asked."""
    return [k for k in dict.fromkeys(asked) if k in EXPORT_HEADERS]


def export_header(asked: tuple[str, ...]) -> str:
    return ",".join(EXPORT_HEADERS[k] for k in export_columns(asked))


def export_lines(rows: DataFrame, t: Tables, asked: tuple[str, ...], zone: str = "UTC") -> DataFrame:
    """id and the CSV line of each row; only tables that an asked column needs are joined."""
    keys = export_columns(asked)
    out = annotated(rows, t)
    listed = lambda c: F.array_join(F.array_sort(F.collect_set(c)), "|")
    if "tags" in keys:
        out = out.join(t.tags.where("enabled").groupBy(*KEY).agg(listed("tag").alias("_tags")), KEY, "left")
    if "classifications" in keys:
        marks = t.classified.groupBy(*KEY).agg(listed("slug").alias("_slugs"))
        out = out.join(marks, KEY, "left")
    if "threat_actor" in keys:
        out = out.join(t.actors.where("kind = 'threat_actor'").groupBy(*KEY).agg(F.min("name").alias("_actor")), KEY, "left")
    if any(k.endswith("_in_source") for k in keys):
        out = out.join(membership_times(t.memberships), KEY, "left")
    if "known_hashes" in keys:
        known = t.hashes.groupBy(F.col("artifact_id").alias("artifact")).agg(listed(F.concat("hash_type", F.lit(":"), "hash_value")).alias("_hashes"))
        out = out.join(known, "artifact", "left")
    if "linked_ioc_public_ids" in keys:
        linked = out.where("artifact is not null").groupBy("artifact").agg(listed("public_id").alias("_linked"))
        out = out.join(linked, "artifact", "left")
    cells = {
        "ioc": lambda: F.col("observable"), "ioc_type": lambda: F.col("observable_type"), "status": lambda: F.coalesce("status", F.lit("active")), "source": lambda: F.col("source_name"), "confidence": lambda: F.col("confidence"),
        "tags": lambda: F.col("_tags"), "classifications": lambda: F.col("_slugs"), "threat_actor": lambda: F.col("_actor"), "first_seen_in_source": lambda: csv_time("m_first", zone), "last_seen_in_source": lambda: csv_time("m_last", zone),
        "last_changed_in_source": lambda: csv_time("m_changed", zone), "created_at": lambda: csv_time("created_at", zone), "imported_at": lambda: csv_time("created_at", zone), "artifact_id": lambda: F.col("artifact"),
        "primary_hash_type": lambda: F.coalesce("primary_type", "observable_type"), "primary_hash_value": lambda: F.coalesce("primary_value", "observable"), "linked_ioc_public_ids": lambda: F.col("_linked"), "known_hashes": lambda: F.col("_hashes"),
    }
    return out.select("id", F.concat_ws(",", *(csv_cell(cells[k]()) for k in keys)).alias("line"))
