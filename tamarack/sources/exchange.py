"""Indicators that other platforms exchange: STIX patterns and bundles, phishing lists, drop lists, signed bundles, pages."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tamarack.functions.text import hash_type, normal_url
from tamarack.sources.feeds import network_list, typed

# fixed values: object paths of patterns and the types they mean
PATHS = {
    "domain-name:value": "domain",
    "url:value": "url",
    "email-addr:value": "email",
    "ipv4-addr:value": "ip",
    "ipv6-addr:value": "ipv6",
    "file:hashes.MD5": "md5",
    "file:hashes.'MD5'": "md5",
    "file:hashes.'SHA-1'": "sha1",
    "file:hashes.SHA1": "sha1",
    "file:hashes.'SHA-256'": "sha256",
    "file:hashes.SHA256": "sha256",
}
_PATH = r"[a-z0-9-]+:[A-Za-z0-9_]+(?:\.(?:'[A-Za-z0-9-]+'|[A-Za-z0-9_-]+))*"
_VALUE = r"'(?:[^'\\]|\\.)*'"
_ONE = rf"({_PATH})\s*(?:=|ISSUBSET)\s*({_VALUE})"
_MANY = rf"({_PATH})\s+IN\s*\(\s*((?:{_VALUE}\s*,?\s*)+)\)"
BUNDLE = "struct<type:string,objects:array<struct<type:string,id:string,pattern:string,pattern_type:string,value:string,created:string,modified:string,valid_until:string,revoked:boolean,hashes:map<string,string>>>>"


def _unquoted(value: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(value, "^'|'$", ""), r"\\(.)", "$1")


def pattern_comparisons(column: str | Column) -> Column:
    """array<struct<path, value>> of the comparisons of a STIX pattern, or null if it says more than those.

    Supported are =, ISSUBSET and IN with AND and OR in brackets; a pattern with anything else is not read in part.
    """
    p = F.col(column) if isinstance(column, str) else column
    rest = F.regexp_replace(F.regexp_replace(p, _MANY, " "), _ONE, " ")
    clean = F.regexp_replace(rest, r"\b(AND|OR)\b|[\[\]()\s]", "") == ""
    pair = lambda path, value: F.struct(path.alias("path"), value.alias("value"))
    listless = F.regexp_replace(p, _MANY, " ")
    single = F.zip_with(F.regexp_extract_all(listless, F.lit(_ONE), 1), F.regexp_extract_all(listless, F.lit(_ONE), 2), lambda a, b: pair(a, _unquoted(b)))
    lists = F.zip_with(F.regexp_extract_all(p, F.lit(_MANY), 1), F.regexp_extract_all(p, F.lit(_MANY), 2), lambda a, b: F.transform(F.regexp_extract_all(b, F.lit(f"({_VALUE})")), lambda v: pair(a, _unquoted(v))))
    return F.when(clean & p.isNotNull(), F.concat(single, F.flatten(lists)))


def pattern_indicators(patterns: DataFrame, id_col: str, pattern_col: str = "pattern") -> DataFrame:
    """id, observable_type, observable of every supported comparison of each pattern."""
    kinds = F.create_map(*(F.lit(x) for kv in PATHS.items() for x in kv))
    rows = patterns.select(F.col(id_col).alias("id"), F.explode(pattern_comparisons(pattern_col)).alias("c"))
    kind = F.try_element_at(kinds, F.col("c.path"))
    value = F.when(kind == "url", normal_url("c.value")).otherwise(F.lower(F.trim("c.value")))
    return rows.select("id", kind.alias("observable_type"), value.alias("observable")).where("observable_type is not null and observable <> ''").distinct()


def stix_bundles(texts: DataFrame, column: str = "value") -> DataFrame:
    """Indicators of STIX 2 bundles given as JSON texts: those of patterns, and observables that objects name."""
    objects = texts.select(F.explode(F.from_json(column, BUNDLE)["objects"]).alias("o")).select("o.*").where("not coalesce(revoked, false)")
    patterned = pattern_indicators(objects.where("type = 'indicator' and coalesce(pattern_type, 'stix') = 'stix'"), "id")
    kinds = F.create_map(*(F.lit(x) for x in ("domain-name", "domain", "url", "url", "email-addr", "email", "ipv4-addr", "ip", "ipv6-addr", "ipv6")))
    plain = objects.select("id", F.try_element_at(kinds, F.col("type")).alias("observable_type"), F.lower(F.trim("value")).alias("observable")).where("observable_type is not null and observable is not null")
    files = objects.where("type = 'file'").select("id", F.explode("hashes").alias("name", "observable")).select("id", hash_type("observable").alias("observable_type"), F.lower("observable").alias("observable")).where("observable_type is not null")
    return patterned.unionByName(plain).unionByName(files).distinct()


def phishtank(records: DataFrame) -> DataFrame:
    """Verified and online URLs of a phishing list (phish_id, url, verified, online, submission_time)."""
    live = records.where("coalesce(lower(verified), 'yes') = 'yes' and coalesce(lower(online), 'yes') = 'yes'")
    return live.select("phish_id", F.lit("url").alias("observable_type"), normal_url("url").alias("observable"), F.col("submission_time").alias("first_seen")).where("observable <> ''")


def drop_list(texts: DataFrame, column: str = "value", keep: tuple[str, ...] = ()) -> DataFrame:
    """Networks of a drop list, a JSON object a line; lines without a network (metadata) are left out."""
    return network_list(texts.select(*keep, F.get_json_object(column, "$.cidr").alias("cidr")).where("cidr is not null"), keep=keep)


def block_list(texts: DataFrame, column: str = "value") -> DataFrame:
    """Addresses and networks of a plain block list."""
    return typed(texts.select(F.col(column).alias("raw")).where(~F.col("raw").rlike(r"^\s*(#|;|$)"))).where("observable_type in ('ip', 'ipv6') and error is null").select("observable_type", "observable").distinct()


def taxii_page(objects: DataFrame, limit: int, cursor: str | None = None) -> tuple[DataFrame, str | None]:
    """A page of objects (added, stix_id) after an opaque cursor, and the next cursor if there is more.

    The page is bounded by the limit, so it is the one thing that is looked at on the driver.
    """
    rows = objects
    if cursor is not None:
        added, last = json.loads(bytes.fromhex(cursor))
        at = F.lit(added).cast(objects.schema["added"].dataType)
        rows = rows.where((F.col("added") > at) | ((F.col("added") == at) & (F.col("stix_id") > last)))
    page = rows.orderBy("added", "stix_id").limit(limit)
    tail = rows.orderBy("added", "stix_id").limit(limit + 1).select("added", "stix_id").collect()
    more = json.dumps([str(tail[limit - 1].added), tail[limit - 1].stix_id]).encode().hex() if len(tail) > limit else None
    return page, more


def signed(rows: DataFrame, column: str = "body") -> DataFrame:
    """Bundles with their integrity digest."""
    return rows.withColumn("sha256", F.sha2(column, 256))


def verified(rows: DataFrame, column: str = "body") -> DataFrame:
    """Bundles whose digest is right."""
    return rows.where(F.lower("sha256") == F.sha2(column, 256))
