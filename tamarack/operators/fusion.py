"""What many sources say about one indicator: times, status, confidence, classification, attribution."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tamarack.functions.text import folded, note_value, slug
from tamarack.operators.identity import KEY
from tamarack.sources.tables import Tables

# fixed values: ranks, scores and names of the data model
RANKS = {"low": 1, "medium": 2, "high": 3}
SCORES = {"low": 25, "medium": 50, "high": 100}
UNKNOWN = "unknown"
CATEGORY_SLUGS = {"c2": "c2_server", "malware_download": "malware"}
TAG_SLUGS = {"botnet": "botnet", "spam": "spam", "phishing_kit": "phishing_kit"}


def confidence_word(column: str | Column) -> Column:
    """low, medium or high; critical is high, all else null."""
    low = F.lower(F.trim(F.col(column) if isinstance(column, str) else column))
    return F.when(low == "critical", "high").when(low.isin(*RANKS), low)


def confidence_rank(word: Column) -> Column:
    return F.when(word == "high", 3).when(word == "medium", 2).when(word == "low", 1)


def confidence_score(column: str | Column) -> Column:
    """0 to 100: the words' scores, or a number within these bounds."""
    low = F.lower(F.trim(F.col(column) if isinstance(column, str) else column))
    number = low.try_cast("double")
    number = F.when(number.isNotNull(), F.greatest(F.lit(0), F.least(F.lit(100), F.floor(number))))  # least() passes over nulls
    return F.coalesce(F.when(low == "high", 100).when(low == "medium", 50).when(low == "low", 25), number.cast("int"), F.lit(0))


def membership_times(memberships: DataFrame) -> DataFrame:
    """First and last seen and last changed over all memberships of an indicator row."""
    return memberships.groupBy(*KEY).agg(F.min("first_seen_in_feed").alias("m_first"), F.max("last_seen_in_feed").alias("m_last"), F.max(F.coalesce("last_changed_in_source", "first_seen_in_feed")).alias("m_changed"))


def effective_confidence(memberships: DataFrame, feeds: DataFrame, items: DataFrame) -> DataFrame:
    """The highest confidence of a row's active memberships, else of its historical ones, and where it is from.

    A membership's own word goes before its feed's. Of equals the later (first seen, then feed) counts. A row's manual
    word overrides all. Purged memberships never count.
    """
    own = confidence_word("explicit_confidence")
    m = memberships.where("purged_at is null").join(feeds, "feed_id").withColumn("word", F.coalesce(own, confidence_word("default_confidence"))).where("word is not null")
    m = m.withColumn("best", F.struct(confidence_rank(F.col("word")).alias("rank"), "first_seen_in_feed", "feed_id", "word", "feed_name", own.isNull().alias("inherited")))
    best = m.groupBy(*KEY).agg(F.max(F.when(F.col("status") == "active", F.col("best"))).alias("now"), F.max("best").alias("ever")).select(*KEY, F.coalesce("now", "ever").alias("best"))
    manual = F.when(F.col("manual_status_override"), confidence_word("confidence"))
    rows = items.join(best, KEY, "left").withColumn("manual", manual)
    source = F.when(F.col("manual").isNotNull(), "manual").when(F.col("best").isNull(), "unknown").when(F.col("best.inherited"), "feed_default").otherwise("feed_entry")
    return rows.select(*KEY, F.coalesce("manual", "best.word").alias("effective"), source.alias("origin"), F.when(F.col("manual").isNull(), F.col("best.feed_name")).alias("feed_name"))


def global_status(items: DataFrame, memberships: DataFrame, now: datetime) -> DataFrame:
    """Status of each row from its own marks and the memberships of all rows with the same observable."""
    live = (F.col("status") == "active") & F.col("purged_at").isNull()
    facts = memberships.join(items.select(*KEY, "observable"), KEY).groupBy("observable_type", "observable").agg(
        F.count("*").alias("n"), F.bool_or(live).alias("live"), F.min(F.when(live, F.col("expires_at"))).alias("next_expiry")
    )
    at = F.lit(now).cast(items.schema["manual_expires_at"].dataType)
    status = (
        F.when(F.col("status") == "suppressed", "suppressed")
        .when(F.col("status") == "disabled", "disabled")
        .when(F.col("manual_status_override"), F.when(F.col("manual_expires_at") <= at, "expired").otherwise(F.coalesce("manual_status", F.lit("active"))))
        .when(F.col("n").isNull() | F.col("live"), "active")
        .otherwise("expired")
    )
    held = F.col("status").isin("suppressed", "disabled")
    expiry = F.when(~F.coalesce(held, F.lit(False)), F.when(F.col("manual_status_override"), F.col("manual_expires_at")).otherwise(F.col("next_expiry")))
    return items.join(facts, ["observable_type", "observable"], "left").select(*KEY, status.alias("new_status"), expiry.alias("expires_at"))


def policy_expiry(mode: Column, ttl: Column, grace: Column) -> Column:
    """When a membership expires: a fixed time after it was last seen, or a grace after it went missing."""
    last = F.coalesce("last_seen_in_feed", "first_seen_in_feed")
    later = lambda base, days: base + F.make_dt_interval(days.cast("int"))
    return F.when(mode.isin("fixed_ttl", "last_seen_ttl") & (ttl > 0), later(last, ttl)).when((mode == "missing_from_feed_ttl") & (F.coalesce(grace, ttl) > 0), later(F.col("missing_since"), F.coalesce(grace, ttl)))


def evidence_slugs(category: str = "category", note: str = "note") -> Column:
    """Classification slugs that a piece of evidence gives: its category's and its tags', sorted and distinct."""
    table = lambda d: F.create_map(*(F.lit(x) for kv in d.items() for x in kv))
    tags = F.transform(F.split(F.coalesce(note_value(note, "tags"), F.lit("")), ","), lambda x: F.try_element_at(table(TAG_SLUGS), slug(x)))
    every = F.concat(F.array(F.try_element_at(table(CATEGORY_SLUGS), slug(F.coalesce(F.col(category), F.lit(""))))), tags)
    return F.array_sort(F.array_distinct(F.array_compact(every)))


def feed_slugs(t: Tables, wanted: list[str] | None = None) -> DataFrame:
    """Key, slug and source of what feeds assert: evidence, and the importer's column unless the row's own mark says it.

    With ``wanted`` only these slugs, looked for before anything is exploded or joined.
    """
    keep = (lambda c: c.isin(*wanted)) if wanted is not None else (lambda c: c != UNKNOWN)
    evidence = t.evidence.select(*KEY, F.explode(F.filter(evidence_slugs(), keep)).alias("slug"), "source_name")
    stored = t.items.where("ioc_source_id is null and threat_classification is not null").select(*KEY, slug("threat_classification").alias("slug"), "source_name").where(keep(F.col("slug")))
    return evidence.union(stored.join(t.classified.where(keep(F.col("slug"))), [*KEY, "slug"], "left_anti")).where(F.col("slug") != UNKNOWN)


def asserted_slugs(t: Tables) -> DataFrame:
    """Key and slug of what people assert: marks, and the column of manual rows that have no mark."""
    legacy = t.items.where("ioc_source_id is not null and threat_classification is not null").select(*KEY, slug("threat_classification").alias("slug"))
    return t.classified.select(*KEY, "slug").union(legacy.join(t.classified.select(*KEY), KEY, "left_anti")).where(F.col("slug") != UNKNOWN)


def visible_feed_slugs(t: Tables, wanted: list[str] | None = None) -> DataFrame:
    """feed_slugs without those that an override hides for the identity: for all sources, or for its own.

    What hides a slug of a row stands in one row (for all, and the sources), so the closure is planned and joined once.
    """
    overrides = t.overrides if wanted is None else t.overrides.where(F.col("slug").isin(*wanted))
    sources = overrides.select("slug", folded(F.coalesce("source_name", F.lit(""))).alias("hidden"), *KEY)
    same = closure_pairs(sources.select(*KEY).distinct(), t)
    hidden = sources.join(same, KEY).select(F.col("to_type").alias("observable_type"), F.col("to_id").alias("id"), "slug", "hidden")
    hidden = hidden.groupBy(*KEY, "slug").agg(F.collect_set("hidden").alias("hidden"))
    said = feed_slugs(t, wanted).join(hidden, [*KEY, "slug"], "left")
    out = F.coalesce(F.array_contains("hidden", "") | F.array_contains("hidden", folded("source_name")), F.lit(False))
    return said.where(~out).drop("hidden")


def closure_pairs(keys: DataFrame, t: Tables) -> DataFrame:
    """From each key to itself and every row of the same observable or artifact: KEY, to_type, to_id."""
    to = [F.col("observable_type").alias("to_type"), F.col("id").alias("to_id")]
    rows = t.items.select(*KEY, "observable")
    same = keys.join(rows, KEY).join(rows.select(*to, "observable", F.col("observable_type").alias("kind")), "observable").where("kind = observable_type").select(*KEY, "to_type", "to_id")
    files = keys.join(t.links, KEY).join(t.links.select(*to, "artifact_id"), "artifact_id").select(*KEY, "to_type", "to_id")
    return keys.select(*KEY, *to).union(same).union(files).distinct()


def classification_keys(t: Tables, slugs: list[str]) -> DataFrame:
    """Keys whose rows carry one of the slugs, after overrides."""
    wanted = [s.replace(" ", "_").replace("-", "_") for s in slugs]
    return visible_feed_slugs(t, wanted).select(*KEY, "slug").union(asserted_slugs(t)).where(F.col("slug").isin(*wanted)).select(*KEY).distinct()


def effective_classifications(t: Tables) -> DataFrame:
    """The sorted effective slugs of each row that has any, with the origins of each."""
    feed = visible_feed_slugs(t).select(*KEY, "slug", F.lit("feed").alias("origin"))
    every = feed.union(asserted_slugs(t).withColumn("origin", F.lit("asserted"))).groupBy(*KEY, "slug").agg(F.array_join(F.array_sort(F.collect_set("origin")), "+").alias("origins"))
    return every.groupBy(*KEY).agg(F.array_join(F.array_sort(F.collect_list(F.concat("slug", F.lit(":"), "origins"))), ",").alias("classifications"))


def merged_attributions(t: Tables) -> DataFrame:
    """Analyst and source attributions of each row by kind and folded label: origin, whether direct, how many sources."""
    analyst = t.actors.select(*KEY, "kind", folded("name").alias("label"), F.lit("analyst").alias("origin"), F.lit(True).alias("direct"), F.lit(None).cast("long").alias("feed_id"))
    said = t.attributions.where("assertion = 'current'").select(*KEY, "kind", folded("label").alias("label"), F.lit("source_reported").alias("origin"), "direct", "feed_id")
    origin = F.when(F.min("origin") == F.max("origin"), F.min("origin")).otherwise("mixed")
    return analyst.union(said).groupBy(*KEY, "kind", "label").agg(origin.alias("origin"), F.bool_or("direct").alias("direct"), F.count_distinct("feed_id").alias("sources"))


def suppressed(items: DataFrame, suppressions: DataFrame, now: datetime) -> DataFrame:
    """Keys of rows with an active suppression of their type and value, whatever its scope."""
    live = suppression_status(suppressions, now).where("state = 'active'").select(F.lower("ioc_type").alias("observable_type"), F.lower("ioc_value").alias("value")).distinct()
    return items.withColumn("value", F.lower("observable")).join(live, ["observable_type", "value"], "left_semi").select(*KEY)


def suppression_status(suppressions: DataFrame, now: datetime) -> DataFrame:
    at = F.lit(now).cast(suppressions.schema["expires_at"].dataType)
    state = F.when(F.col("deleted_at").isNotNull(), "deleted").when(~F.col("active"), "disabled").when(F.col("expires_at") <= at, "expired").otherwise("active")
    return suppressions.withColumn("state", state)


def suppressed_with_files(items: DataFrame, suppressions: DataFrame, links: DataFrame, artifacts: DataFrame, now: datetime) -> DataFrame:
    """Keys of suppressed rows and of all rows of the files that one of them belongs to, also through merges."""
    hit = suppressed(items, suppressions, now)
    file_of = artifacts.select("artifact_id", F.when((F.col("status") == "merged") & F.col("merged_into").isNotNull(), F.col("merged_into")).otherwise(F.col("artifact_id")).alias("file"))
    of_rows = links.join(file_of, "artifact_id").select(*KEY, "file")
    files = of_rows.join(hit, KEY, "left_semi").select("file").distinct()
    return hit.union(of_rows.join(files, "file", "left_semi").select(*KEY)).distinct()
