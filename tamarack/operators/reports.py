"""Counts, rankings and lists for people."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tamarack.operators.identity import KEY
from tamarack.sources.tables import Tables


def top_sources(t: Tables, limit: int) -> DataFrame:
    """The sources with most distinct indicators, of feeds and of desks."""
    keys = t.items.select(*KEY, "observable", "ioc_source_id")
    pair = F.struct("observable", "observable_type")  # a struct counts also where a part is null
    feeds = t.memberships.where("status = 'active'").join(keys, KEY).groupBy("feed_id").agg(F.count_distinct(pair).alias("n")).join(t.feeds, "feed_id").select(F.col("feed_name").alias("source"), "n")
    desks = keys.join(t.manual_sources, keys.ioc_source_id == t.manual_sources.source_id).groupBy(F.col("source_name").alias("source")).agg(F.count_distinct(pair).alias("n"))
    return feeds.union(desks).groupBy("source").agg(F.sum("n").alias("indicators")).orderBy(F.col("indicators").desc(), "source").limit(limit)


def counts_by_type(items: DataFrame) -> DataFrame:
    return items.groupBy("observable_type").agg(F.count_distinct(F.lower("observable")).alias("indicators"), F.count("*").alias("n_rows"), F.count_if(F.coalesce("status", F.lit("active")) == "active").alias("active"))


def evidence_coverage(t: Tables) -> DataFrame:
    """Which part of each feed's members has evidence from it."""
    seen = t.evidence.select(*KEY, "feed_id").distinct().withColumn("has", F.lit(1))
    both = t.memberships.select(*KEY, "feed_id").distinct().join(seen, [*KEY, "feed_id"], "left").groupBy("feed_id").agg(F.count("*").alias("members"), F.count("has").alias("evidenced"))
    share = F.round(F.col("evidenced") * 100 / F.nullif("members", F.lit(0)), 1)
    return both.join(t.feeds, "feed_id").groupBy("feed_key").agg(F.sum("members").alias("members"), F.sum("evidenced").alias("evidenced")).withColumn("coverage", share)


def usage_by_day(events: DataFrame) -> DataFrame:
    """Calls, hits, units and a mean for each day and type; no mean where nothing was measured."""
    measured = F.when(F.col("value") > 0, F.col("value"))
    mean = F.round(F.sum(measured) / F.nullif(F.count(measured), F.lit(0)), 1)
    units = F.sum(F.get_json_object("props", "$.k").cast("long"))
    return events.groupBy(F.to_date("ts").alias("day"), "event_type").agg(F.count("*").alias("calls"), F.count_if(F.col("event_type") != "error").alias("hits"), units.alias("units"), mean.alias("mean_value"))


def report_list(reports: DataFrame, tags: DataFrame, text: str, not_tlp: str, limit: int) -> DataFrame:
    """Reports that are neither deleted nor superseded and whose title or a tag has the text."""
    low = text.lower()
    tagged = tags.where(F.col("tag").contains(low)).select("report_id").distinct().withColumn("tagged", F.lit(True))
    rows = reports.where("not deleted and superseded_by is null").join(tagged, "report_id", "left")
    rows = rows.where((F.lower("title").contains(low) | F.coalesce("tagged", F.lit(False))) & ~F.col("tlp").eqNullSafe(not_tlp))
    return rows.orderBy(F.col("score").desc_nulls_last(), F.col("report_id").desc()).limit(limit).select("report_id", "title")


def top_references(t: Tables, most: int) -> DataFrame:
    """The first references of each row: direct ones first, then the latest, with the count of all."""
    own = t.actors.select(*KEY, F.concat("kind", F.lit(":"), "name").alias("ref"), F.lit(True).alias("direct"), F.lit(None).cast("timestamp_ntz").alias("linked_at"))
    said = t.attributions.join(t.memberships.select(*KEY, "feed_id", "first_seen_in_feed"), [*KEY, "feed_id"]).select(*KEY, F.concat("kind", F.lit(":"), "label"), "direct", "first_seen_in_feed")
    w = Window.partitionBy(*KEY)
    place = F.row_number().over(w.orderBy(F.col("direct").desc(), F.col("linked_at").desc_nulls_last(), "ref"))
    return own.union(said).withColumn("total", F.count("*").over(w)).withColumn("place", place).where(F.col("place") <= most).select(*KEY, "ref", F.col("place").cast("long").alias("place"), "total")


def purge_preview(memberships: DataFrame, which: Column) -> DataFrame:
    """What removing feeds would touch: rows that only they hold and rows that others hold too."""
    held = memberships.groupBy(*KEY).agg(F.count("*").alias("others"))
    return memberships.where(which).join(held, KEY).groupBy("feed_id").agg(F.count("*").alias("affected"), F.count_if(F.col("others") == 1).alias("only_here"), F.count_if(F.col("others") > 1).alias("shared"))


def discovery_summary(t: Tables) -> DataFrame:
    """How many rows analysts, sources or both attribute, in one pass."""
    said = t.actors.select(*KEY, F.lit(True).alias("a")).union(t.attributions.where("assertion = 'current'").select(*KEY, F.lit(False)))
    rows = said.groupBy(*KEY).agg(F.bool_or("a").alias("a"), F.bool_or(~F.col("a")).alias("s"))
    return rows.agg(F.count("*").alias("total"), F.count_if(F.col("a") & F.col("s")).alias("both_said"), F.count_if(F.col("a") & ~F.col("s")).alias("analyst_only"), F.count_if(F.col("s") & ~F.col("a")).alias("source_only"))


def bulk_lookup(wanted: DataFrame, items: DataFrame, kind: str) -> DataFrame:
    """Each wanted value with the oldest row that has it."""
    first = items.where(F.col("observable_type") == kind).groupBy(F.lower("observable").alias("v")).agg(F.min_by("id", F.struct("created_at", "id")).alias("id"))
    return wanted.join(first, F.lower("value") == F.col("v"), "left").select("value", "id", F.when(F.col("id").isNull(), "new").otherwise("matched").alias("match_state"))


def bulk_tag(rows: DataFrame, tags: DataFrame, tag: str) -> DataFrame:
    """What tagging all rows of a query does to each: skipped where it is there, failed where the row is disabled."""
    has = tags.where(F.col("tag") == tag).select(*KEY).distinct().withColumn("has", F.lit(True))
    outcome = F.when(F.col("has"), "skipped").when(F.coalesce("status", F.lit("active")) == "disabled", "failed").otherwise("succeeded")
    return rows.join(has, KEY, "left").select(*KEY, outcome.alias("outcome"))


def audit(events: DataFrame, since: str, until: str, *words: tuple[str, str], limit: int = 10_000) -> DataFrame:
    """Events of a time span in which a column has its word, newest first."""
    match = F.lit(False)
    for column, word in words:
        match = match | F.lower(column).contains(word)
    kind = events.schema["ts"].dataType
    rows = events.where((F.col("ts") >= F.lit(since).cast(kind)) & (F.col("ts") < F.lit(until).cast(kind)) & match)
    return rows.orderBy(F.col("ts").desc(), F.col("event_id").desc()).limit(limit).select("event_id", "ts", "user_id")


def retained(rows: DataFrame, at: str, now, days: int) -> DataFrame:
    """Rows that a retention of so many days leaves."""
    from datetime import timedelta

    return rows.where(F.col(at) >= F.lit(now - timedelta(days=days)).cast(rows.schema[at].dataType))


def counts_of(rows: DataFrame, by: list[str], column: str, words: tuple[str, ...]) -> DataFrame:
    """For each group how many rows say each of the words, in one pass."""
    return rows.groupBy(*by).agg(*(F.count_if(F.col(column) == w).alias(w) for w in words))


def phase_counts(rows: DataFrame, phases: tuple[str, ...], listed: Column) -> DataFrame:
    """Rows of each phase, and the total of those that a filter lists, in one pass."""
    return rows.agg(*(F.count_if(F.col("phase") == p).alias(p) for p in phases), F.count_if(listed).alias("total"))


def discovery_figures(t: Tables) -> DataFrame:
    """Ten figures of who attributes rows: analysts, sources, both, directly, by a pulse, by several feeds, and types."""
    analysts = t.actors.select(*KEY).distinct().withColumn("a", F.lit(True))
    current = t.attributions.where("assertion = 'current'")
    sources = current.groupBy(*KEY).agg(F.bool_or("direct").alias("d"), F.bool_or(~F.col("direct")).alias("p"), F.count_distinct("feed_id").alias("feeds"), F.lit(True).alias("s"))
    rows = analysts.join(sources, KEY, "full").na.fill(False, ["a", "s", "d", "p"])
    a, s = F.col("a"), F.col("s")
    counted = {"analyst": a, "source": s, "both_said": a & s, "analyst_only": a & ~s, "source_only": s & ~a, "direct": F.col("d"), "pulse": F.col("p"), "several_feeds": F.col("feeds") > 1}
    return rows.agg(F.count("*").alias("total"), *(F.count_if(c).alias(n) for n, c in counted.items()), F.count_distinct("observable_type").alias("types"))


def usage_counters(calls: DataFrame, hit: Column, failed: Column) -> DataFrame:
    """Nine counters of calls (day, provider, type, k, value, micros) and the rates they give; no rate without calls."""
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long"))
    out = calls.groupBy("day", "provider", "type").agg(
        F.count("*").alias("lookups"), F.count_if(hit).alias("hits"), F.count_if(~hit & ~failed).alias("misses"), F.count_if(failed).alias("errors"), zero(F.sum("k")).alias("units"),
        zero(F.sum(F.when(hit, F.col("k")))).alias("hit_units"), F.count("value").alias("timed"), zero(F.sum("micros")).alias("micros"), zero(F.max("micros")).alias("longest"),
    )
    share = lambda c: F.round(F.col(c) * 100 / F.nullif("lookups", F.lit(0)), 1) if isinstance(c, str) else F.round(c * 100 / F.nullif("lookups", F.lit(0)), 1)
    return out.select("*", share("hits").alias("hit_rate"), share(F.col("lookups") - F.col("errors")).alias("success_rate"), F.round(F.col("micros") / F.nullif("timed", F.lit(0)), 1).alias("mean_micros"))


def watchlist(watched: DataFrame, items: DataFrame, memberships: DataFrame) -> DataFrame:
    """What people watch (user_id, id), with its status now and when it was last seen."""
    rows = watched.join(items.select(*KEY, "observable", F.coalesce("status", F.lit("active")).alias("status")), "id")
    seen = memberships.groupBy(*KEY).agg(F.max("last_seen_in_feed").alias("last_seen"))
    return rows.join(seen, KEY, "left").select("user_id", "id", "observable", "status", "last_seen").distinct()


def stats_snapshot(items: DataFrame) -> DataFrame:
    """Rows by type, status and confidence, in one pass: what, name, n."""
    each = F.array(
        F.struct(F.lit("type").alias("what"), F.col("observable_type").alias("name")),
        F.struct(F.lit("status").alias("what"), F.coalesce("status", F.lit("active")).alias("name")),
        F.struct(F.lit("confidence").alias("what"), F.coalesce(F.lower("confidence"), F.lit("unknown")).alias("name")),
    )
    # few groups: types, states and words
    return items.select(F.explode(each).alias("e")).groupBy("e.what", "e.name").agg(F.count("*").alias("n"))


def is_stale(taken_at, now, hours: int = 26) -> bool:
    """Whether a snapshot is older than it may be."""
    from datetime import timedelta

    return taken_at is None or now - taken_at > timedelta(hours=hours)
