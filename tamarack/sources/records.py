"""Indicators in files that documents link to, in bundles that installations exchange, in paged services, by hand."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tamarack.functions.text import normal_url
from tamarack.sources.feeds import VALUE_HEADERS, typed

# fixed values: object types of a national block list, and XML names of observable values
USOM_TYPES = {"domain": "domain", "url": "url", "ip": "ip", "ipv6": "ipv6"}
CYBOX_VALUES = ("Address_Value", "Value", "Simple_Hash_Value")


def sniffed(text: str | Column, path: str | Column | None = None) -> Column:
    """stix, json, ndjson, xml, csv, md, adoc or text: by the suffix of the path where it says enough, else by the text."""
    text = F.ltrim(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")))
    first = F.substring_index(text, "\n", 1)
    line_of_json = r"^\s*\{.*\}\s*$"
    lines = F.filter(F.split(text, "\n"), lambda x: F.trim(x) != "")
    by_text = (
        F.when(text.startswith("{") & text.rlike(r'"(?:spec_version|type)"\s*:\s*"(?:2\.\d|bundle)"'), "stix")
        .when((F.size(lines) > 1) & F.forall(lines, lambda x: x.rlike(line_of_json)), "ndjson")
        .when(text.startswith("{") | text.startswith("["), "json")
        .when(text.startswith("<"), "xml")
        .when(first.contains(",") & F.exists(F.split(F.lower(first), ","), lambda x: F.regexp_replace(F.trim(x), '"', "").isin(*VALUE_HEADERS)), "csv")
        .when(first.rlike(r"^#{1,6} "), "md")
        .when(first.rlike(r"^={1,5} "), "adoc")
        .otherwise("text")
    )
    if path is None:
        return by_text
    suffix = F.lower(F.regexp_extract(F.col(path) if isinstance(path, str) else path, r"\.([A-Za-z0-9]+)$", 1))
    return F.when(suffix.isin("csv", "md", "adoc", "ndjson"), suffix).when(suffix == "jsonl", "ndjson").otherwise(by_text)


def structured_records(files: DataFrame, id_col: str, text_col: str, path_col: str | None = None) -> DataFrame:
    """id, format, raw of every record in linked CSV, JSON (an array, or an object with one) and NDJSON files, typed.

    A record's value is its first non-empty member of the known names. Other formats give no records.
    """
    rows = files.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), sniffed(text_col, path_col).alias("format"))
    value = lambda x: F.coalesce(*(F.nullif(F.trim(F.get_json_object(x, f"$.{n}")), F.lit("")) for n in VALUE_HEADERS))
    lines = rows.where("format = 'ndjson'").select("id", "format", F.explode(F.split("text", "\n")).alias("r"))
    listed = F.coalesce(F.get_json_object("text", "$.indicators"), F.get_json_object("text", "$.data"), F.col("text"))
    arrays = rows.where("format = 'json'").select("id", "format", F.explode(F.from_json(listed, "array<string>")).alias("r"))
    raw = lines.union(arrays).select("id", "format", value(F.col("r")).alias("raw"))
    cells = rows.where("format = 'csv'").select("id", "format", F.split("text", "\n").alias("l"))
    names = F.transform(F.split(F.lower(cells["l"][0]), ","), lambda x: F.regexp_replace(F.trim(x), '"', ""))
    at = F.array_max(F.transform(names, lambda n, i: F.when(n.isin(*VALUE_HEADERS), i)))
    table = cells.select("id", "format", at.alias("at"), F.explode(F.slice("l", F.lit(2), F.greatest(F.size("l") - 1, F.lit(0)))).alias("r"))
    cell = F.regexp_replace(F.trim(F.get(F.split("r", r',(?=(?:[^"]*"[^"]*")*[^"]*$)'), F.col("at"))), '^"|"$', "")
    return typed(raw.union(table.select("id", "format", cell)).where("raw is not null and raw <> ''"))


def cybox_values(texts: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, raw of the values of observables in STIX 1 XML, typed; several values in one element have a delimiter."""
    found = None
    for name in CYBOX_VALUES:
        part = F.xpath(F.col(text_col), F.lit(f"//*[local-name()='{name}']/text()"))
        found = part if found is None else F.concat(found, part)
    raw = F.explode(F.flatten(F.transform(found, lambda x: F.split(x, "##comma##|##@@##"))))
    return typed(texts.where(F.col(text_col).startswith("<")).select(F.col(id_col).alias("id"), raw.alias("raw")).where("trim(raw) <> ''"))


def bundles(rows: DataFrame, by: str, columns: list[str]) -> DataFrame:
    """One bundle for each group: its items as JSON in a fixed order, and the SHA-256 of that text.

    Groups are what an export asks for (a report, a feed), which bounds a bundle.
    """
    item = F.to_json(F.struct(*sorted(columns)))
    body = F.concat(F.lit("["), F.array_join(F.array_sort(F.collect_list(item)), ","), F.lit("]"))
    return rows.groupBy(by).agg(body.alias("body"), F.count("*").alias("items")).withColumn("sha256", F.sha2("body", 256))


def unbundled(given: DataFrame, by: str, schema: str) -> DataFrame:
    """The items of bundles whose digest is right; a bundle that was changed gives none."""
    right = given.where(F.lower("sha256") == F.sha2("body", 256))
    return right.select(by, F.explode(F.from_json("body", f"array<struct<{schema}>>")).alias("item")).select(by, "item.*")


def usom(records: DataFrame) -> DataFrame:
    """Records (id, type, url, date) of a paged service as typed rows with a hash of what they say."""
    kind = F.try_element_at(F.create_map(*(F.lit(x) for kv in USOM_TYPES.items() for x in kv)), F.lower(F.trim("type")))
    value = F.when(kind == "url", normal_url(F.when(F.col("url").contains("://"), F.col("url")).otherwise(F.concat(F.lit("http://"), "url")))).otherwise(F.lower(F.trim("url")))
    rows = records.select("id", kind.alias("observable_type"), value.alias("observable"), "date").where("observable_type is not null and observable <> ''")
    return rows.withColumn("content_hash", F.sha2(F.concat_ws("|", "observable_type", "observable"), 256))


def advanced(records: DataFrame, state: DataFrame, stored: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What one run takes in, and the state after it.

    state holds a cursor (the highest id seen) for each type, stored the hashes by id. Records up to their type's cursor
    are not read again; of the others those with a stored hash count as seen and write nothing.
    """
    s = state.select("observable_type", F.col("cursor").alias("_from"))
    fresh = records.join(s, "observable_type", "left").where(F.col("_from").isNull() | (F.col("id") > F.col("_from"))).drop("_from")
    new = fresh.join(stored.select("content_hash").distinct(), "content_hash", "left_anti")
    ends = fresh.groupBy("observable_type").agg(F.max("id").alias("_to"))
    after = state.join(ends, "observable_type", "full").select("observable_type", F.greatest("cursor", "_to").alias("cursor"))
    return new, after


def snapshot_changes(stored: DataFrame, snapshot: DataFrame) -> DataFrame:
    """What a full snapshot changes: content_hash and whether it enters or leaves."""
    a, b = stored.select("content_hash").distinct().withColumn("a", F.lit(1)), snapshot.select("content_hash").distinct().withColumn("b", F.lit(1))
    return a.join(b, "content_hash", "full").where("a is null or b is null").select("content_hash", F.when(F.col("a").isNull(), "enters").otherwise("leaves").alias("change"))


def created_by_hand(values: DataFrame, items: DataFrame, value_col: str = "raw", type_col: str | None = None) -> DataFrame:
    """What creating values by hand or by a call does: observable, type and outcome (created, exists, repeated, invalid)."""
    rows = typed(values.withColumnRenamed(value_col, "raw"))
    if type_col is not None:  # the type that was asked for must be the one that the value has
        asked = F.lower(F.trim(F.col(type_col)))
        rows = rows.withColumn("error", F.when(F.col("error").isNull() & (asked != F.col("observable_type")), "type_mismatch").otherwise(F.col("error")))
    good = F.col("error").isNull() & F.col("observable").isNotNull()
    known = items.select("observable_type", F.lower("observable").alias("_v")).distinct().withColumn("_known", F.lit(True))
    first = rows.where(good).groupBy("observable_type", F.lower("observable").alias("_v")).agg(F.min("place").alias("_first"))
    rows = rows.withColumn("_v", F.lower("observable")).join(known, ["observable_type", "_v"], "left").join(first, ["observable_type", "_v"], "left")
    outcome = F.when(~good, "invalid").when(F.col("_known"), "exists").when(F.col("place") > F.col("_first"), "repeated").otherwise("created")
    return rows.select("place", "raw", F.when(good, F.col("observable_type")).alias("observable_type"), F.when(good, F.col("observable")).alias("observable"), outcome.alias("outcome"))
