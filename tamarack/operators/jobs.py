"""Work on indicators and reports that changes rows: merges of files, moves of sources, attributions, duplicates, spools."""

from __future__ import annotations

import math
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tamarack.functions.text import bucket, folded
from tamarack.operators.identity import KEY
from tamarack.operators.joins import graph_components
from tamarack.sources.shared import durable


def merged_artifacts(hashes: DataFrame) -> DataFrame:
    """Artifacts that share a hash become one: artifact_id, merged_into (the least of its component, or null)."""
    first = hashes.groupBy("hash_type", F.lower("hash_value").alias("v")).agg(F.min("artifact_id").alias("u"), F.count_distinct("artifact_id").alias("n")).where("n > 1")
    edges = hashes.withColumn("v", F.lower("hash_value")).join(first, ["hash_type", "v"]).where("artifact_id <> u").select("u", F.col("artifact_id").alias("v")).distinct()
    label = graph_components(edges).where("node <> label").select(F.col("node").alias("artifact_id"), F.col("label").alias("merged_into"))
    return hashes.select("artifact_id").distinct().join(label, "artifact_id", "left")


def primary_hashes(hashes: DataFrame) -> DataFrame:
    """The strongest hash of each artifact; where there are several of it, the least value, and a conflict."""
    rank = F.when(F.col("hash_type") == "sha256", 0).when(F.col("hash_type") == "sha1", 1).otherwise(2)
    best = hashes.groupBy("artifact_id").agg(F.min(F.struct(rank.alias("r"), "hash_type", F.lower("hash_value").alias("hash_value"))).alias("b"), F.count_distinct(F.when(F.col("hash_type") == "sha256", F.lower("hash_value"))).alias("n"))
    return best.select("artifact_id", "b.hash_type", "b.hash_value", (F.col("n") > 1).alias("conflict"))


def withdrawn(assertions: DataFrame, keep: DataFrame, key: list[str]) -> DataFrame:
    """Assertions with their status after a new list: current ones whose label it doesn't hold are withdrawn."""
    listed = keep.select(*key, folded("label").alias("_l")).distinct().withColumn("_k", F.lit(True))
    rows = assertions.withColumn("_l", folded("label")).join(listed, [*key, "_l"], "left")
    status = F.when((F.col("assertion") == "current") & F.col("_k").isNull(), "withdrawn").otherwise(F.col("assertion"))
    return rows.withColumn("assertion", status).select(*assertions.columns)


def duplicate_reports(reports: DataFrame, url_col: str = "url") -> DataFrame:
    """Groups of reports with one address: the key, the first report and how many there are."""
    return reports.withColumn("key", report_key(url_col)).where("key <> ''").groupBy("key").agg(F.min("report_id").alias("first"), F.count("*").alias("n")).where("n > 1")


def report_key(column: str | Column) -> Column:
    """An address without scheme, www, tracking parameters, fragment and final slash, in lower case of the host."""
    c = F.trim(F.col(column) if isinstance(column, str) else column)
    c = F.regexp_replace(F.regexp_replace(c, r"(?i)^https?://(www\.)?", ""), r"#.*$", "")
    c = F.regexp_replace(c, r"(?i)(?<=[?&])(utm_[a-z]+|fbclid|gclid|mc_cid|mc_eid|ref)=[^&]*&?", "")
    c = F.regexp_replace(F.regexp_replace(c, r"[?&]$", ""), r"/$", "")
    host = F.regexp_extract(c, r"^[^/?]*", 0)
    return F.concat(F.lower(host), F.substr(c, F.length(host) + 1))


def inherited_tags(candidates: DataFrame, report_tags: DataFrame, evidence_col: str = "evidence") -> DataFrame:
    """Tags of a report that a candidate inherits: those whose term stands in its evidence as a whole word.

    An equality on the report comes first, the pattern is looked at within it only. Blanks, hyphens and underscores in
    a tag are alike.
    """
    quoted = F.regexp_replace(F.trim("tag"), r"([\\.^$|?*+()\[\]{}])", r"\\$1")
    pattern = F.concat(F.lit(r"(?i)(?<![\p{L}\p{N}])"), F.regexp_replace(quoted, r"[\s_-]+", r"[\\s_-]+"), F.lit(r"(?![\p{L}\p{N}])"))
    met = candidates.join(report_tags.withColumn("_p", pattern), "report_id")
    return met.where(F.rlike(F.col(evidence_col), F.col("_p"))).drop("_p")


def due(memberships: DataFrame, now: datetime, most: int = 500) -> DataFrame:
    """The next batch that an expiration run takes: active, over, the earliest first."""
    at = F.lit(now).cast(memberships.schema["expires_at"].dataType)
    return memberships.where((F.col("status") == "active") & (F.col("expires_at") <= at)).orderBy("expires_at", "id").limit(most)


def reactivated(rows: DataFrame, matches: DataFrame, key: list[str], now: datetime, days: int) -> DataFrame:
    """Expired rows that a report matches are active again for so many days."""
    hit = matches.select(*key).distinct().withColumn("_hit", F.lit(True))
    again = (F.col("status") == "expired") & F.coalesce("_hit", F.lit(False))
    until = F.lit(now + timedelta(days=days)).cast(rows.schema["expires_at"].dataType)
    joined = rows.join(hit, key, "left")
    return joined.withColumn("expires_at", F.when(again, until).otherwise(F.col("expires_at"))).withColumn("status", F.when(again, "active").otherwise(F.col("status"))).select(*rows.columns)


def moved(items: DataFrame, source: int, target: int) -> DataFrame:
    """Rows of one manual source given to another."""
    return items.withColumn("ioc_source_id", F.when(F.col("ioc_source_id") == source, F.lit(target)).otherwise(F.col("ioc_source_id")))


def run_difference(before: DataFrame, after: DataFrame, key: list[str]) -> DataFrame:
    """What a new extraction run keeps, loses and adds, and kept ones that are no longer approved."""
    b, a = before.select(*key, F.lit(True).alias("b")), after.select(*key, F.lit(True).alias("a"), "approved")
    state = F.when(F.col("a").isNull(), "lost").when(F.col("b").isNull(), "added").when(~F.col("approved"), "not_approved").otherwise("kept")
    return b.join(a, key, "full").select(*key, state.alias("state"))


def review_progress(candidates: DataFrame) -> DataFrame:
    """For each report how many identities are done, open, conflicting or excluded, from the states of their rows."""
    per = candidates.groupBy("report_id", "identity_key").agg(F.bool_or(F.col("review") == "approved").alias("yes"), F.bool_or(F.col("review") == "rejected").alias("no"), F.bool_and(F.col("excluded")).alias("out"))
    open_ = ~F.col("yes") & ~F.col("no") & ~F.col("out")
    return per.groupBy("report_id").agg(F.count_if((F.col("yes") != F.col("no")) & ~F.col("out")).alias("done"), F.count_if(open_).alias("open"), F.count_if(F.col("yes") & F.col("no") & ~F.col("out")).alias("conflicting"), F.count_if("out").alias("excluded"))


def tag_usage(tags: DataFrame) -> DataFrame:
    """For each tag its rows and where it is enabled."""
    return tags.groupBy("tag").agg(F.count("*").alias("uses"), F.count_if("enabled").alias("enabled_uses"), F.array_sort(F.collect_set("observable_type")).alias("types"))


def latest_run(runs: DataFrame, key: str, at: str) -> DataFrame:
    """The last run of each feed."""
    w = Window.partitionBy(key).orderBy(F.col(at).desc_nulls_last())
    return runs.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def percentile(values: DataFrame, column: str, p: float) -> DataFrame:
    """The nearest-rank percentile, exactly: the value at place ceil(n p).

    Counts of range partitions tell which of them holds the place; only its distinct values are counted through.
    """
    counted = values.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("c"))
    dealt = durable(counted.repartitionByRange(column).withColumn("part", F.spark_partition_id()))
    totals = sorted((r.part, r.n) for r in dealt.groupBy("part").agg(F.sum("c").alias("n")).collect())  # a row for each partition
    place, before = max(1, math.ceil(sum(n for _, n in totals) * p)), 0
    here = None
    for here, n in totals:
        if before + n >= place:
            break
        before += n
    upto = F.sum("c").over(Window.partitionBy("part").orderBy(column).rowsBetween(Window.unboundedPreceding, 0))
    inside = dealt.where(F.col("part") == here).withColumn("upto", upto + before)
    return inside.where(F.col("upto") >= place).agg(F.min(column).alias("value"))


def expiration_run(items: DataFrame, memberships: DataFrame, now: datetime, most: int) -> DataFrame:
    """Keys and new status of the rows that one run touches: the due batch expires, then the rows' status is formed anew.

    Rows that are held (suppressed, disabled, or set by hand) keep their status and are left out.
    """
    at = F.lit(now).cast(memberships.schema["expires_at"].dataType)
    batch = memberships.where((F.col("status") == "active") & (F.col("expires_at") <= at)).orderBy("expires_at", "id", "feed_id").limit(most)
    batch = durable(batch.select(*KEY, "feed_id").withColumn("_due", F.lit(True)))
    touched = batch.select(*KEY).distinct()
    after = memberships.join(touched, KEY, "left_semi").join(batch, [*KEY, "feed_id"], "left")
    live = (F.col("status") == "active") & F.col("purged_at").isNull() & F.col("_due").isNull()
    status = after.groupBy(*KEY).agg(F.bool_or(live).alias("live")).select(*KEY, F.when(F.col("live"), "active").otherwise("expired").alias("new_status"))
    free = ~F.coalesce("status", F.lit("active")).isin("suppressed", "disabled") & ~F.coalesce("manual_status_override", F.lit(False))
    return items.where(free).select(*KEY).join(status, KEY)


# fixed values: names of bulk actions, outcomes and modes
BULK_ACTIONS = ("classify", "suppress", "expire")
SAMPLES = 20


def bulk_outcomes(rows: DataFrame, action: str, value: str | None = None) -> DataFrame:
    """Key and outcome of an action on each row: skipped where nothing would change, failed where the row forbids it."""
    status = F.coalesce("status", F.lit("active"))
    match action:
        case "classify":
            done, barred = F.col("threat_classification") == value, status == "disabled"
        case "suppress":
            done, barred = status == "suppressed", F.lit(False)
        case "expire":
            done, barred = status == "expired", status.isin("suppressed", "disabled")
        case _:
            raise ValueError(f"no bulk action {action!r}")
    return rows.select(*KEY, F.when(F.coalesce(done, F.lit(False)), "skipped").when(barred, "failed").otherwise("succeeded").alias("outcome"))


def outcome_summary(outcomes: DataFrame, samples: int = SAMPLES) -> DataFrame:
    """outcome, n and the first ids of each, by a bounded list that is cut in every task."""
    first = Window.partitionBy("outcome").orderBy("id")
    some = outcomes.withColumn("_r", F.row_number().over(first)).where(F.col("_r") <= samples).groupBy("outcome").agg(F.transform(F.array_sort(F.collect_list("id")), lambda x: x.cast("string")).alias("samples"))
    return outcomes.groupBy("outcome").agg(F.count("*").alias("n")).join(some, "outcome")


def execution_mode(rows: DataFrame, inline: int, most: int) -> DataFrame:
    """mode and how far it was counted: nothing, now, as a job, or refused; never counts further than one past ``most``."""
    n = F.col("counted")
    mode = F.when(n == 0, "nothing").when(n <= inline, "now").when(n <= most, "job").otherwise("refused")
    return rows.limit(most + 1).agg(F.count("*").alias("counted")).select(mode.alias("mode"), "counted")


def catalog_conflicts(entities: DataFrame, aliases: DataFrame) -> DataFrame:
    """Folded names that several entries have: name, entities (sorted), conflict."""
    named = entities.select("entity_id", folded("entity_name").alias("name"), F.lit("name").alias("kind")).union(aliases.select("entity_id", folded("alias"), F.lit("alias")))
    per = named.groupBy("name").agg(
        F.array_sort(F.collect_set(F.col("entity_id").cast("string"))).alias("entities"), F.count_distinct(F.when(F.col("kind") == "name", F.col("entity_id"))).alias("names"), F.count_distinct("kind").alias("kinds")
    )
    conflict = F.when(F.col("names") > 1, "name_collision").when(F.col("kinds") > 1, "alias_is_name").otherwise("alias_conflict")
    return per.where(F.size("entities") > 1).select("name", "entities", conflict.alias("conflict"))


# fixed values: states of assessment, match and review that keep a candidate from being an indicator
BARRED_STATES = {"assessment": ("context", "invalid"), "match_state": ("invalid",), "review": ("rejected", "context")}
# fixed values: flags of a candidate that keep it from being an indicator
BARRED_FLAGS = ("parser_metadata", "direct_source", "reserved", "non_actionable_local")


def indicator_gates(candidates: DataFrame, types: tuple[str, ...], flags_col: str = "flags") -> DataFrame:
    """Candidates (type, assessment, match_state, review, a JSON text of flags) that count as indicators of a report."""
    allowed = F.col("type").isin(*types)
    for column, states in BARRED_STATES.items():
        allowed = allowed & ~F.coalesce(F.col(column), F.lit("")).isin(*states)
    for flag in BARRED_FLAGS:
        allowed = allowed & (F.coalesce(F.get_json_object(flags_col, f"$.{flag}"), F.lit("false")) != "true")
    return candidates.where(F.coalesce(allowed, F.lit(False)))


def candidate_list(candidates: DataFrame, text: str | None = None, types: tuple[str, ...] = (), results: tuple[str, ...] = (), matched: bool | None = None) -> DataFrame:
    """Candidates of a tab: by a part of their value, their types, what came of them, and whether a row matches."""
    rows = candidates
    if text:
        rows = rows.where(F.lower("value").contains(text.lower()))
    if types:
        rows = rows.where(F.col("type").isin(*types))
    if results:
        rows = rows.where(F.coalesce("result", F.lit("open")).isin(*results))
    if matched is not None:
        rows = rows.where(F.col("matched_id").isNotNull() if matched else F.col("matched_id").isNull())
    return rows


def move_preview(items: DataFrame, source: int, target: int) -> DataFrame:
    """What moving a source would do: rows that move, and those of them whose value the target has already."""
    key = [F.col("observable_type"), F.lower("observable").alias("v")]
    there = items.where(F.col("ioc_source_id") == target).select(*key).distinct().withColumn("there", F.lit(True))
    rows = items.where(F.col("ioc_source_id") == source).select("id", *key).join(there, ["observable_type", "v"], "left")
    return rows.agg(F.count("*").alias("moving"), F.count_if(F.coalesce("there", F.lit(False))).alias("already_there"))


def removal(items: DataFrame, source: int) -> tuple[DataFrame, DataFrame]:
    """Rows that stay when a source is removed, and those that go with it."""
    own = F.coalesce(F.col("ioc_source_id") == source, F.lit(False))
    return items.where(~own), items.where(own)


def superseded_reports(reports: DataFrame, url_col: str = "url") -> DataFrame:
    """Reports with the one of the same address that replaces them: the newest, then the largest id."""
    keyed = reports.withColumn("key", report_key(url_col)).where("key <> ''")
    last = keyed.groupBy("key").agg(F.max(F.struct("published", "report_id")).alias("last"))
    return keyed.join(last, "key").where(F.col("report_id") != F.col("last.report_id")).select("report_id", F.col("last.report_id").alias("superseded_by"))


def swept(stored: DataFrame, fresh: DataFrame, slice_: int, slices: int, after: str = "", most: int = 1000) -> DataFrame:
    """The next differences of one slice of a projection, from a cursor on: identity_key and what is wrong with it."""
    here = lambda df: df.where((bucket("identity_key", slices) == slice_) & (F.col("identity_key") > after))
    o, n = here(stored).select("identity_key", F.col("fingerprint").alias("was")), here(fresh).select("identity_key", F.col("fingerprint").alias("now"))
    kind = F.when(F.col("was").isNull(), "missing").when(F.col("now").isNull(), "extra").when(F.col("was") != F.col("now"), "differs")
    return o.join(n, "identity_key", "full").select("identity_key", kind.alias("fault")).where("fault is not null").orderBy("identity_key").limit(most)
