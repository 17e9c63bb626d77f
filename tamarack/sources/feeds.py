"""Feed payloads to typed indicator rows: plain lists, CSV, and the records of known providers."""

from __future__ import annotations

import csv

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tamarack.functions.network import ipv4_number, with_network
from tamarack.functions.text import hash_type, normal_url

# fixed values: headers, columns and spellings of feeds
VALUE_HEADERS = ("value", "ioc", "indicator")
URLHAUS = ("id", "dateadded", "url", "url_status", "last_online", "threat", "tags", "link", "reporter")
MALWAREBAZAAR = ("first_seen_utc", "sha256_hash", "md5_hash", "sha1_hash", "reporter", "file_name", "file_type_guess", "mime_type", "signature", "clamav", "vtpercent", "imphash", "ssdeep", "tlsh")
OTX_TYPES = {"IPv4": "ip", "IPv6": "ipv6", "domain": "domain", "hostname": "domain", "URL": "url", "URI": "url", "FileHash-MD5": "md5", "FileHash-SHA1": "sha1", "FileHash-SHA256": "sha256"}
COMMENT = r"^\s*(#|//|;|$)"


def detect_format(sample: str, content_type: str = "", path: str = "") -> str:
    """csv or txt: by the type, by the suffix, or if half of the first five lines have a comma."""
    kind, path = content_type.lower(), path.lower()
    if "csv" in kind or path.endswith(".csv"):
        return "csv"
    if "text/plain" in kind or path.endswith(".txt"):
        return "txt"
    lines = [x for x in sample[:4096].splitlines() if x.strip() and not x.strip().startswith(("#", "//", ";"))][:5]
    return "csv" if lines and 2 * sum("," in x for x in lines) >= len(lines) else "txt"


def inferred_type(value: Column, network: Column) -> Column:
    """The type of a value by its shape."""
    digest = F.coalesce(hash_type(value), F.lit("hash"))
    return (
        F.when(network.isNotNull(), network.getField("kind"))
        .when(value.rlike(r"^[0-9.]+/[0-9]+$") | value.rlike(r"^[0-9a-fA-F:]+/0$"), None)
        .when(value.rlike("(?i)^https?://") | value.contains("/"), "url")
        .when(value.rlike(r"^([0-9]{1,3}\.){3}[0-9]{1,3}$"), "ip")
        .when(value.rlike("^[a-fA-F0-9]{32,128}$"), digest)
        .otherwise("domain")
    )


def typed(rows: DataFrame, value: str = "raw") -> DataFrame:
    """rows with observable, observable_type and, where they are no indicator, the reason."""
    rows = with_network(rows.withColumn("_v", F.trim(F.col(value))), "_v", "_n")
    v, kind = F.col("_v"), F.col("observable_type")
    rows = rows.withColumn("observable_type", inferred_type(v, F.col("_n")))
    normal = F.when(kind.isin("ip", "ipv6"), F.coalesce(F.col("_n").getField("value"), v)).when(kind == "url", normal_url("_v")).when(kind.isin("domain", "hash", "md5", "sha1", "sha256"), F.lower("_v")).otherwise(v)
    shape = F.when(kind.isNull(), False).when(kind == "ip", F.col("_n").isNotNull()).when(kind == "domain", v.rlike("^[A-Za-z0-9.-]+$")).otherwise(True)
    return rows.withColumn("observable", F.when(shape, normal)).withColumn("error", F.when(v == "", "empty").when(~shape, "invalid_value")).drop("_v", "_n")


#: Rejected lines that a report shows, and how much of each.
REJECTED, REJECTED_CHARS = 20, 500


def text_feed(lines: DataFrame, column: str = "value", kind: str | None = None) -> DataFrame:
    """One row for each line that is no comment, typed; a feed of one fixed kind rejects other values."""
    rows = typed(lines.select(F.col(column).alias("raw")).where(~F.col("raw").rlike(COMMENT)))
    if kind is None:
        return rows
    other = F.col("error").isNull() & (F.col("observable_type") != kind)
    return rows.withColumn("error", F.when(other, "type_mismatch").otherwise(F.col("error"))).withColumn("observable", F.when(F.col("error").isNull(), F.col("observable")))


def rejected(rows: DataFrame, most: int = REJECTED) -> DataFrame:
    """The first rejected lines by their text, cut short, with the reason."""
    return rows.where("error is not null").select(F.substring("raw", 1, REJECTED_CHARS).alias("raw"), "error").orderBy("raw", "error").limit(most)


def split_header(line: str) -> list[str]:
    """The cells of a header line, quoted or not, in lower case."""
    return [c.strip().lower() for c in next(csv.reader([line]), [])]


def csv_lines(lines: DataFrame, header: str | None, column: str = "value") -> DataFrame:
    """Rows of CSV lines, typed; ``header`` is the first line that is no comment. Without a known name in it the first
    cell is the value. A type or confidence column is taken over."""
    first = split_header(header or "")
    named = any(c in VALUE_HEADERS for c in first)
    names = first if named else ["value", *(f"_c{i}" for i in range(1, max(1, len(first))))]
    body = lines.where(~F.col(column).rlike(COMMENT))
    if named:
        body = body.where(F.col(column) != header)
    cells = body.select(F.from_csv(column, F.lit(", ".join(f"`{c}` string" for c in names)), {"escape": '"', "ignoreLeadingWhiteSpace": "true", "ignoreTrailingWhiteSpace": "true"}).alias("r")).select("r.*")
    value = next((c for c in names if c in VALUE_HEADERS), names[0])
    word = F.lower(F.trim("confidence")) if "confidence" in names else F.lit(None).cast("string")
    rows = typed(cells.select(F.coalesce(F.col(value), F.lit("")).alias("raw"), word.alias("confidence"), *([F.lower(F.trim("type")).alias("_said")] if "type" in names else [])))
    if "type" in names:
        rows = rows.withColumn("observable_type", F.coalesce(F.nullif("_said", F.lit("")), "observable_type")).drop("_said")
    return rows


def csv_feed(spark: SparkSession, path: str) -> DataFrame:
    """Rows of CSV files with or without a header, typed."""
    lines = spark.read.text(path)
    first = lines.where(~F.col("value").rlike(COMMENT)).first()
    return csv_lines(lines, first[0] if first else None)


def _cells(lines: DataFrame, names: tuple[str, ...], column: str = "value") -> DataFrame:
    """Named cells of the lines of a provider's CSV; comments are left out."""
    schema = ", ".join(f"{c} string" for c in names)
    body = lines.where(~F.col(column).rlike(r"^\s*(#|$)"))
    return body.select(F.from_csv(column, F.lit(schema), {"escape": '"', "ignoreLeadingWhiteSpace": "true"}).alias("r")).select("r.*")


def urlhaus(spark: SparkSession, path: str) -> DataFrame:
    return urlhaus_lines(spark.read.text(path))


def urlhaus_lines(lines: DataFrame) -> DataFrame:
    """URLs with threat and tags; the fingerprint leaves out what changes by itself."""
    rows = _cells(lines, URLHAUS).where("id is not null and url is not null and reporter is not null and id <> 'id'")
    threat = F.coalesce(F.nullif(F.trim("threat"), F.lit("")), F.lit("malware-url"))
    tags = F.array_sort(F.array_distinct(F.filter(F.transform(F.split(F.concat_ws(",", "tags", threat), ","), lambda x: F.trim(x)), lambda x: x != "")))
    rows = rows.select("id", F.lit("url").alias("observable_type"), normal_url("url").alias("observable"), F.lower("url_status").alias("state"), threat.alias("threat"), tags.alias("tags"), "reporter")
    return rows.withColumn("fingerprint", F.sha2(F.to_json(F.struct("id", "observable", "state", "threat", "tags", "reporter")), 256))


def threatfox(records: DataFrame) -> DataFrame:
    """Records (ioc, ioc_type, confidence_level, malware) to typed rows; an ip:port gives its host."""
    host = F.when(F.col("ioc_type") == "ip:port", F.regexp_replace(F.regexp_replace("ioc", r":\d+$", ""), r"[\[\]]", "")).otherwise(F.col("ioc"))
    level = F.col("confidence_level").try_cast("double")
    word = F.when(level.isNull(), "medium").when(level >= 80, "high").when(level >= 50, "medium").otherwise("low")
    out = typed(records.withColumn("raw", host)).withColumn("confidence", word)
    # the day it was last seen changes by itself
    said = [c for c in ("observable_type", "observable", "confidence", "malware", "threat_type", "reporter", "tags") if c in out.columns]
    return out.withColumn("fingerprint", F.sha2(F.to_json(F.struct(*said)), 256))


def malwarebazaar(spark: SparkSession, path: str) -> DataFrame:
    return malwarebazaar_lines(spark.read.text(path))


def malwarebazaar_lines(lines: DataFrame) -> DataFrame:
    """Samples with their hashes; a sample without a SHA-256 is left out. The fingerprint leaves out detection rates."""
    rows = _cells(lines, MALWAREBAZAAR)
    hexed = lambda c, n: F.when(F.lower(F.trim(c)).rlike(f"^[0-9a-f]{{{n}}}$"), F.lower(F.trim(c)))
    tags = F.array_distinct(F.filter(F.array(F.lower("signature"), F.lower("file_type_guess")), lambda x: x.isNotNull() & ~x.isin("", "n/a")))
    out = rows.select(hexed("sha256_hash", 64).alias("sha256"), hexed("md5_hash", 32).alias("md5"), hexed("sha1_hash", 40).alias("sha1"), hexed("imphash", 32).alias("imphash"), F.lower("ssdeep").alias("ssdeep"), F.lower("tlsh").alias("tlsh"), tags.alias("tags"), "reporter", "file_name")
    return out.where("sha256 is not null").withColumn("fingerprint", F.sha2(F.to_json(F.struct(*out.columns)), 256))


def otx(pulses: DataFrame) -> DataFrame:
    """Indicators of pulses (id, created, modified, indicators): every pair of indicator and pulse stays."""
    kinds = F.create_map(*(F.lit(x) for kv in OTX_TYPES.items() for x in kv))
    rows = pulses.select(F.col("id").alias("pulse"), "created", "modified", F.explode("indicators").alias("i"))
    kind, value = F.try_element_at(kinds, F.col("i.type")), F.trim("i.indicator")
    kind = F.when((kind == "domain") & value.contains("://"), "url").otherwise(kind)
    return rows.select("pulse", kind.alias("observable_type"), F.lower(value).alias("observable"), F.coalesce("i.created", "created").alias("first_seen"), F.coalesce("modified", "i.created").alias("last_seen")).where("observable_type is not null and observable <> ''")


def certpl(records: DataFrame) -> DataFrame:
    """Domains that are not withdrawn; of several records the earliest, then the one listed first."""
    live = records.where("coalesce(DeleteDate, '') = ''").withColumn("observable", F.lower(F.regexp_replace(F.trim("DomainAddress"), r"\.$", ""))).where(F.col("observable").rlike(r"^[a-z0-9-]+(\.[a-z0-9-]+)+$"))
    order = F.struct(F.col("InsertDate").isNull().alias("a"), "InsertDate", F.col("RegisterPositionId").isNull().alias("b"), "RegisterPositionId")
    return live.groupBy("observable").agg(F.min(order).alias("first")).select("observable", F.lit("domain").alias("observable_type"), F.col("first.InsertDate").alias("first_seen"), F.col("first.RegisterPositionId").alias("position"))


def certpl_skipped(records: DataFrame) -> DataFrame:
    """Why records give no row: reason and how many."""
    value = F.lower(F.regexp_replace(F.trim(F.coalesce("DomainAddress", F.lit(""))), r"\.$", ""))
    good = value.rlike(r"^[a-z0-9-]+(\.[a-z0-9-]+)+$")
    reason = F.when(F.coalesce("DeleteDate", F.lit("")) != "", "withdrawn").when(value == "", "empty").when(~good, "invalid_domain")
    first = records.select(reason.alias("reason"), value.alias("value"))
    kept = first.where("reason is null").agg((F.count("*") - F.count_distinct("value")).alias("n")).select(F.lit("duplicate").alias("reason"), "n")
    return first.where("reason is not null").groupBy("reason").agg(F.count("*").alias("n")).union(kept).where("n > 0")


def network_list(records: DataFrame, column: str = "cidr", keep: tuple[str, ...] = ()) -> DataFrame:
    """lo, hi and bits of the IPv4 networks of a list, after the columns that are kept."""
    n, bits = ipv4_number(F.substring_index(column, "/", 1)), F.substring_index(column, "/", -1).try_cast("int")
    size = F.pow(F.lit(2), F.lit(32) - bits).cast("long")
    lo = n - F.pmod(n, size)
    return records.where(F.col(column).contains("/")).select(*keep, lo.alias("lo"), (lo + size - 1).alias("hi"), bits.alias("bits")).where("lo is not null and bits between 1 and 32").distinct()
