"""What documents say beside their indicators: sections, tables, kinds of digests and dotted names, markings, dates, quality.

A bounded set of rules, each stated here; blocks are rows (doc, position, kind, level, text).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tamarack.functions.extract import candidate_value, heading_zone

# fixed values: levels of the traffic light protocol from open to closed, and spellings of one level
TLP = ("clear", "green", "amber", "amber+strict", "red")
TLP_SPELLINGS = {"WHITE": "clear"}
# fixed values: words of a label that say what a digest is of, the first that stands in it counts
DIGEST_LABELS = (
    ("object_id", ("commit", "revision", "layer", "manifest", "image id")),
    ("key", ("key", "token", "secret", "password", "salt", "nonce", "iv")),
    ("certificate", ("thumbprint", "serial", "certificate", "ja3", "ja3s")),
    ("file_hash", ("md5", "sha1", "sha-1", "sha256", "sha-256", "hash", "file", "sample")),
)
# fixed values: endings of file names and first names of code that look like domains
FILE_ENDINGS = ("exe", "dll", "sys", "bat", "cmd", "ps1", "vbs", "js", "jar", "py", "sh", "doc", "docx", "xls", "xlsx", "pdf", "zip", "rar", "7z", "txt", "log", "dat", "bin", "tmp", "ini", "cfg", "json", "xml", "html", "php", "asp", "aspx", "jsp", "png", "jpg", "gif", "lnk", "iso", "img", "apk", "elf")
CODE_HEADS = ("system", "java", "javax", "android", "com", "org", "net", "os", "self", "this", "microsoft", "window", "document", "console")
MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")
# fixed values: what the header of a column says its cells are
HEADERS = (
    ("description", ("description", "comment", "note", "details", "context")),
    ("type", ("type", "kind", "category")),
    ("value", ("indicator", "ioc", "value", "observable", "ip", "ip address", "domain", "url", "host", "hostname", "md5", "sha1", "sha256", "hash", "email")),
)


def tlp_marking(column: str | Column) -> Column:
    """The strictest marking of a text, null without one. Only markings in capitals count."""
    text = F.col(column) if isinstance(column, str) else column
    said = F.regexp_extract_all(text, F.lit(r"\bTLP\s?:\s?(RED|AMBER\+STRICT|AMBER|GREEN|CLEAR|WHITE)(?![A-Z])"), 1)
    rank = F.lit(-1)
    for i, level in enumerate(TLP):
        names = [level.upper(), *(s for s, to in TLP_SPELLINGS.items() if to == level)]
        here = F.lit(False)
        for n in names:
            here = here | F.array_contains(said, n)
        rank = F.when(here, F.greatest(rank, F.lit(i))).otherwise(rank)
    return F.when(rank >= 0, F.element_at(F.array(*(F.lit(x) for x in TLP)), F.greatest(rank, F.lit(0)) + 1))


def document_tlp(blocks: DataFrame) -> DataFrame:
    """doc and the strictest marking of its blocks; a document without one is clear."""
    order = F.array(*(F.lit(x) for x in TLP))
    place = F.array_position(order, tlp_marking("text"))
    best = blocks.groupBy("doc").agg(F.max(F.coalesce(place, F.lit(0))).alias("p"))
    return best.select("doc", F.when(F.col("p") > 0, F.element_at(order, F.greatest("p", F.lit(1)).cast("int"))).otherwise(TLP[0]).alias("tlp"), F.when(F.col("p") > 0, "explicit").otherwise("default").alias("tlp_source"))


def published_dates(column: str | Column) -> Column:
    """All dates of a text in order: 2024-01-31, January 31, 2024 and 31 January 2024; impossible ones are left out."""
    text = F.col(column) if isinstance(column, str) else column
    word = "(?:sept|" + "|".join(m[:3] + (f"(?:{m[3:]})?" if m[3:] else "") for m in MONTHS) + r")\.?"
    shape = rf"(?i)\b((?:19|20)\d\d-\d\d-\d\d|{word}\s+\d{{1,2}}(?:st|nd|rd|th)?,?\s+(?:19|20)\d\d|\d{{1,2}}(?:st|nd|rd|th)?\s+{word},?\s+(?:19|20)\d\d)\b"

    def read(found: Column) -> Column:
        low = F.lower(found)
        month = F.lit(0)
        for i, m in enumerate(MONTHS, 1):
            month = F.when(F.regexp_extract(low, "[a-z]{3,}", 0).startswith(m[:3]), i).otherwise(month)
        spelled = F.concat_ws("-", F.regexp_extract(low, r"(?:19|20)\d\d", 0), F.lpad(month.cast("string"), 2, "0"), F.lpad(F.regexp_extract(low, r"(?<!\d)\d{1,2}(?!\d)", 0), 2, "0"))
        return F.try_to_timestamp(F.when(low.rlike(r"^\d{4}-"), low).otherwise(spelled), F.lit("yyyy-MM-dd")).cast("date")

    return F.array_compact(F.transform(F.regexp_extract_all(text, F.lit(shape), 1), read))


def publication_date(blocks: DataFrame, first: int = 20) -> DataFrame:
    """doc, published: a date after "published" or the like in the first blocks, else the first date there."""
    near = blocks.where(F.col("position") < first)
    labelled = F.try_element_at(published_dates(F.regexp_extract("text", r"(?i)\b(?:published|posted|released|date)\b\s*(?:on)?\s*:?\s*(.{0,30})", 1)), F.lit(1))
    plain = F.try_element_at(published_dates("text"), F.lit(1))
    rows = near.select("doc", "position", labelled.alias("l"), plain.alias("p"))
    first_of = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.col("position")))
    return rows.groupBy("doc").agg(F.coalesce(first_of("l"), first_of("p")).alias("published")).where("published is not null")


def document_title(blocks: DataFrame, most: int = 200) -> DataFrame:
    """doc, title: the first heading of the highest level that is no longer than a title may be."""
    heads = blocks.where((F.col("kind") == "heading") & F.length(F.trim("text")).between(1, most))
    return heads.groupBy("doc").agg(F.min_by(F.trim("text"), F.struct("level", "position")).alias("title"))


def digest_label(text: Column, value: Column) -> Column:
    """The words that govern a value: what stands before it after the last separator or other digest."""
    before = F.split_part(F.lower(text), F.lower(value), F.lit(1))
    before = F.regexp_replace(before, r"^.*\b[0-9a-f]{32,}\b", "")
    cells = F.filter(F.split(before, r"[|;\n\t]|\.\s"), lambda x: F.trim(x) != "")
    return F.coalesce(F.trim(F.try_element_at(cells, F.lit(-1))), F.lit(""))


def digest_kind(text: Column, value: Column) -> Column:
    """object_id, key, certificate or file_hash by the label of a digest; unlabelled where it has none."""
    label = digest_label(text, value)
    out = F.when(label == "", "unlabelled")
    for kind, words in DIGEST_LABELS:
        out = out.when(label.rlike(r"(?<![a-z0-9])(?:" + "|".join(words) + r")s?(?![a-z0-9])"), kind)
    return out.otherwise("unlabelled")


def dotted_kind(column: str | Column) -> Column:
    """version, ip, file, code or domain for a name with dots, null for anything else."""
    v = F.trim(F.col(column) if isinstance(column, str) else column)
    labels = F.split(F.lower(v), r"\.")
    last, head = F.try_element_at(labels, F.lit(-1)), F.try_element_at(labels, F.lit(1))
    octets = F.forall(labels, lambda x: x.rlike(r"^\d{1,3}$") & (x.try_cast("int") < 256)) & (F.size(labels) == 4)
    return (
        F.when(~v.rlike(r"^[\w$()-]+(?:\.[\w$()-]+)+$"), None)
        .when(octets, "ip")
        .when(v.rlike(r"^[vV]?\d+(?:\.\d+)+(?:[-_]?[a-zA-Z]+\d*)?$"), "version")
        .when(v.rlike(r"[_$()]") | v.rlike(r"\.[a-z]+[A-Z]") | (head.isin(*CODE_HEADS) & (F.size(labels) > 2)), "code")
        .when(last.isin(*FILE_ENDINGS), "file")
        .when(last.rlike("^[a-z]{2,}$"), "domain")
    )


def column_intent(header: Column) -> Column:
    """value, type or description by the header of a column, else null."""
    h = F.trim(F.regexp_replace(F.lower(header), r"[^a-z0-9]+", " "))
    out = None
    for intent, words in HEADERS:
        here = h.isin(*words)
        out = F.when(here, intent) if out is None else out.when(here, intent)
    return out


def table_candidates(rows: DataFrame) -> DataFrame:
    """doc, row, type, value, description of table rows (doc, table, row, cells): cells under a value header that are indicators.

    The first row whose headers name a value is the header; a cell that was wrapped over lines is read as one. A digest
    that ends in dots is no whole one and is left out.
    """
    intents = F.transform("cells", column_intent)
    heads = rows.where(F.array_contains(intents, "value")).groupBy("doc", "table").agg(F.min_by(F.struct(F.col("row").alias("at"), intents.alias("intents")), "row").alias("h"))
    body = rows.join(heads, ["doc", "table"]).where(F.col("row") > F.col("h.at"))
    wrapped = F.transform("cells", lambda c: F.when(c.rlike(r"^[0-9a-fA-F\s]{32,}$"), F.regexp_replace(c, r"\s+", "")).otherwise(F.trim(c)))
    said = F.array_join(F.array_compact(F.zip_with("h.intents", wrapped, lambda i, c: F.when(i == "description", c))), " ")
    cells = body.select("doc", "table", "row", said.alias("description"), F.explode(F.array_compact(F.zip_with("h.intents", wrapped, lambda i, c: F.when((i == "value") & ~c.rlike(r"(?:\.\.\.|…)$"), c)))).alias("cell"))
    found = cells.withColumn("c", candidate_value("cell")).where("c.type is not null")
    return found.select("doc", "table", "row", "c.type", "c.value", "description")


def sections(blocks: DataFrame) -> DataFrame:
    """Blocks with their section: the path of headings above them and the zone that the nearest of these opens.

    A heading stands under the last one of a smaller level, until one of its own or a smaller level comes.
    """
    w = Window.partitionBy("doc").orderBy("position").rowsBetween(Window.unboundedPreceding, 0)
    heading = F.col("kind") == "heading"
    rows = blocks
    for level in range(1, 7):
        here = F.when(heading & (F.col("level") == level), F.struct("position", F.trim("text").alias("text"), heading_zone("text").alias("zone")))
        rows = rows.withColumn(f"_h{level}", F.last(here, ignorenulls=True).over(w))
    above, path = F.lit(-1), []
    for level in range(1, 7):
        h = F.col(f"_h{level}")
        open_ = h.isNotNull() & (h["position"] > above)
        path.append(F.when(open_, h))
        above = F.greatest(above, F.coalesce(h["position"], F.lit(-1)))
    kept = F.array_compact(F.array(*path))
    zones = F.filter(kept, lambda x: x["zone"].isNotNull())
    out = rows.select(*blocks.columns, F.transform(kept, lambda x: x["text"]).alias("path"), F.try_element_at(zones, F.lit(-1))["zone"].alias("zone"))
    return out


# fixed values: codes of what may be wrong with an extraction
QUALITY_CODES = ("no_blocks", "no_headings", "mostly_repeated", "very_long_block", "no_indicators")


def quality_codes(blocks: DataFrame, indicators: DataFrame, docs: DataFrame, repeated: float = 0.5, longest: int = 20_000) -> DataFrame:
    """doc, codes (sorted): what each document's blocks and indicators show; a document without faults has none."""
    per = blocks.groupBy("doc").agg(
        F.count("*").alias("n"), F.count_if(F.col("kind") == "heading").alias("heads"), F.count_distinct(F.lower(F.trim("text"))).alias("kinds"), F.max(F.length("text")).alias("longest")
    )
    found = indicators.groupBy("doc").agg(F.count("*").alias("found"))
    rows = docs.select("doc").distinct().join(per, "doc", "left").join(found, "doc", "left").na.fill(0)
    n = F.col("n")
    faults = {
        "no_blocks": n == 0,
        "no_headings": (n > 0) & (F.col("heads") == 0),
        "mostly_repeated": (n > 1) & (F.col("kinds") <= n * (1 - repeated)),
        "very_long_block": F.col("longest") > longest,
        "no_indicators": (n > 0) & F.coalesce(F.col("found") == 0, F.lit(True)),
    }
    return rows.select("doc", F.array_sort(F.array_compact(F.array(*(F.when(faults[c], c) for c in QUALITY_CODES)))).alias("codes"))
