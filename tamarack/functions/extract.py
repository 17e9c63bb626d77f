"""Indicators in documents: blocks of pages, zones, observables in text, and whether they are members of a report."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tamarack.functions.network import IPV4
from tamarack.functions.text import hash_type, refanged

# fixed values: shapes of observables and names of zones
_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
_IPV4 = rf"{_OCTET}(?:\.{_OCTET}){{3}}"
_HOST = r"(?:[a-zA-Z0-9](?:[a-zA-Z0-9-]{0,61}[a-zA-Z0-9])?\.)+[a-zA-Z]{2,63}"
_IN_PATH = r"[^\s<>\"')\]]"
SHAPES = {
    # with a scheme, or a host with a path; what follows an address must hold a letter and be no protocol
    "url": rf"\b(?i:https?|wss?)://[A-Za-z0-9.:-]+{_IN_PATH}*"
    rf"|(?<![\w@:/.-]){_HOST}(?::[0-9]{{1,5}})?/(?={_IN_PATH}*[\w~%]){_IN_PATH}+"
    rf"|(?<![\w@:/.-]){_IPV4}(?::[0-9]{{1,5}})?/(?!(?i:tcp|udp|sctp)\b)(?={_IN_PATH}*[A-Za-z_~%]){_IN_PATH}+",
    "cve": r"(?i:\bCVE-[0-9]{4}-[0-9]{4,7}\b)",
    "technique": r"\bT[0-9]{4}(?:\.[0-9]{3})?\b",
    "email": r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}\b",
    "domain": rf"\b{_HOST}\b",
    "cidr": rf"\b{_IPV4}/(?:3[0-2]|[12]?[0-9])\b",
    "ip_port": rf"\b{_IPV4}:[0-9]{{1,5}}\b",
    "ip": rf"\b{_IPV4}\b",
    "ipv6": r"(?<![0-9a-fA-F:])::1(?![0-9a-fA-F:])",
    "sha256": r"\b[0-9a-fA-F]{64}\b",
    "sha1": r"\b[0-9a-fA-F]{40}\b",
    # a hexadecimal literal is one where it opens a line
    "md5": r"\b[0-9a-fA-F]{32}\b|(?m:^)[ \t]*(?:[-*•·▪][ \t]*)?0[xX][0-9a-fA-F]{32}(?![0-9A-Za-z_])",
}
#: What each match of a shape that is slow to look for has in it.
NEEDED = {"url": "/", "email": "@", "domain": r"[A-Za-z0-9]\.[A-Za-z]{2}", "cidr": r"[0-9]/[0-9]", "ip_port": r"[0-9]:[0-9]", "ipv6": "::1"}
ZONES = (
    ("explicit_ioc_section", r"(?i)^(appendix\s+\w+\s*[:.-]\s*)?(indicators? of compromise|iocs?|indicators?)\b", 48),
    ("reference_section", r"(?i)^(appendix\s+\w+\s*[:.-]\s*)?(references|further reading|bibliography|sources)\b", 200),
    ("c2_section", r"(?i)\b(c2|c&c|command and control)\b", 40),
    ("sample_table", r"(?i)\b(samples?|hashes|files?)\b", 40),
    ("mitre", r"(?i)\b(mitre|att&ck)\b", 200),
)
BLOCK = "page_id long, position int, kind string, level int, text string, links array<string>"


class _Blocks(HTMLParser):
    """Headings, paragraphs, list items, code and table rows in reading order."""

    KINDS = {"p": "paragraph", "li": "list", "pre": "code", "tr": "table", "blockquote": "paragraph", **{f"h{i}": "heading" for i in range(1, 7)}}
    SKIPPED = {"script", "style", "nav", "footer", "header", "aside", "noscript", "form"}

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.blocks, self.skipped, self.open, self.parts, self.links = [], 0, None, [], []

    def close_block(self):
        text = " ".join("".join(self.parts).split())
        if text:
            kind = self.KINDS.get(self.open, "paragraph")
            self.blocks.append((kind, int(self.open[1]) if kind == "heading" else 0, text, self.links))
        self.open, self.parts, self.links = None, [], []

    def handle_starttag(self, tag, attrs):
        if tag in self.SKIPPED:
            self.skipped += 1
        elif tag in self.KINDS and not self.skipped:
            self.close_block()
            self.open = tag
        elif tag in ("td", "th") and self.parts:
            self.parts.append(" | ")
        elif tag == "br":
            self.parts.append("\n")
        if tag == "a" and not self.skipped:
            self.links += [v for k, v in attrs if k == "href" and v]

    def handle_endtag(self, tag):
        if tag in self.SKIPPED:
            self.skipped = max(0, self.skipped - 1)
        elif tag in self.KINDS:
            self.close_block()

    def handle_data(self, data):
        if not self.skipped:
            self.parts.append(data)


def html_blocks(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """Blocks of each page in order; null pages have none."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for page, html in zip(batch["id"], batch["html"]):
                reader = _Blocks()
                reader.feed(html or "")
                reader.close()
                reader.close_block()
                rows += [(page, i, *b) for i, b in enumerate(reader.blocks)]
            yield pd.DataFrame(rows, columns=["page_id", "position", "kind", "level", "text", "links"])

    return pages.select(F.col(id_col).alias("id"), F.col(html_col).alias("html")).mapInPandas(read, BLOCK)


def heading_zone(column: str | Column = "text") -> Column:
    """The zone that a heading opens, null if none."""
    text = F.trim(F.col(column) if isinstance(column, str) else column)
    out = F.when((F.length(text) == 0) | (F.length(text) > 200), None)
    for zone, pattern, most in ZONES:
        out = out.when(text.rlike(pattern) & (F.length(text) <= most), zone)
    return out


#: Shapes of words that change from page to page, by what stands for them.
_CHANGING = (
    ("URL", r"^[a-z][a-z0-9+.-]*://\S+$"),
    ("HOST", r"^www\.[a-z0-9.-]+$"),
    ("DATE", r"^(?:\d{1,2}[./-]\d{1,2}[./-]\d{2,4}|\d{4}-\d{2}-\d{2})$"),
    ("TIME", r"^\d{1,2}(?::\d{2}){1,2}$"),
    ("DOCID", r"^\p{L}{2,6}(?:[-–—]\w+)+[-–—]\d+$"),
    ("PAGE", r"^\d+/\d+$"),
)
KEY_LENGTH = 240


def repeated_key(column: str | Column) -> Column:
    """Text of a header or footer, word by word, with links, names, dates, times and page numbers made alike.

    A number that opens the text is taken for a page number and dropped, one after "page" (or "n of m") with its word.
    """
    c = F.lower(F.trim(F.col(column) if isinstance(column, str) else column))
    words = F.filter(F.split(F.regexp_replace(c, r"(\d)\s*/\s*(?=\d)", "$1/"), r"\s+"), lambda w: w != "")
    bare = F.transform(words, lambda w: F.regexp_replace(w, r"^[(\[|]+|[)\],;|]+$", ""))

    def made_alike(w: Column, i: Column) -> Column:
        before = F.when(i > 0, F.get(bare, i - 1))
        after = F.get(bare, i + 1)
        number = w.rlike(r"^\d+$")
        out = F.when(number & (i == 0) & w.rlike(r"^\d{1,3}$"), F.lit(""))
        out = out.when(number & (before == "page"), F.lit("")).when((w == "page") & after.rlike(r"^\d+$"), F.lit("PAGE"))
        for name, shape in _CHANGING:
            out = out.when(w.rlike(shape), F.lit(name))
        # a page number that the text layer ran together with the first word
        glued = (i == 0) & w.rlike(r"^\d{1,3}\p{L}{3}")
        return out.when(glued, F.regexp_replace(w, r"^\d+", "")).otherwise(w)

    alike = F.filter(F.transform(bare, made_alike), lambda w: w != "")
    return F.substring(F.array_join(alike, " "), 1, KEY_LENGTH)


def repeated_blocks(blocks: DataFrame, doc_col: str, page_col: str, text_col: str = "text", least: int = 2) -> DataFrame:
    """Headers and footers: doc, key and pages of texts that stand on several pages of a document."""
    keyed = blocks.select(F.col(doc_col).alias("doc"), F.col(page_col).alias("page"), repeated_key(text_col).alias("key")).where("key <> ''")
    return keyed.groupBy("doc", "key").agg(F.count_distinct("page").alias("pages")).where(F.col("pages") >= least)


def _typed(values: Column, kind: str) -> Column:
    return F.transform(values, lambda x: F.struct(F.lit(kind).alias("type"), x.alias("value")))


def _of_interest(text: Column) -> Column:
    """The words of a text that any shape could match: with a digit, an at sign, a scheme or a dot inside.

    No shape spans a blank but after the start of a line, so words with a line's end stay too.
    """
    return F.array_join(F.filter(F.split(text, "[ \t]+"), lambda w: w.rlike(r"[0-9@\n]|\w\.\w|://|\w/\w|[a-fA-F]{32}")), " ")


def observables(texts: DataFrame, id_col: str, text_col: str = "text", kinds: tuple[str, ...] | None = None) -> DataFrame:
    """Typed observables of each text: id, type, value, occurrences; the longer shape takes what the shorter would.

    An address with a port counts as ip_port and as ip. Domains are told by their shape, so names of files may be some.
    With ``kinds`` only these are returned; shapes that come after all of them are not looked for.
    """
    wanted = tuple(SHAPES) if kinds is None else kinds
    last = max(list(SHAPES).index(k) for k in wanted)
    rows = texts.select(F.col(id_col).alias("id"), _of_interest(refanged(F.coalesce(F.col(text_col), F.lit("")))).alias("text"))
    shapes = dict(list(SHAPES.items())[: last + 1])
    for kind, pattern in shapes.items():
        there = F.col("text").rlike(NEEDED[kind]) if kind in NEEDED else F.lit(True)
        rows = rows.withColumn(f"of_{kind}", F.when(there, _typed(F.regexp_extract_all("text", F.lit(f"({pattern})")), kind)))
        if kind in ("url", "email", "domain", "cidr", "sha256", "sha1"):
            rows = rows.withColumn("text", F.when(F.size(f"of_{kind}") > 0, F.regexp_replace("text", pattern, " ")).otherwise(F.col("text")))
    found = [F.coalesce(f"of_{kind}", F.array().cast("array<struct<type:string,value:string>>")) for kind in wanted]
    every = rows.select("id", F.explode(F.concat(*found)).alias("o"))
    value = F.when(F.col("o.type").isin("cve", "technique"), F.upper("o.value")).when(F.col("o.type") == "url", F.regexp_replace("o.value", r"[.,;:]+$", "")).when(F.col("o.type") == "md5", F.lower(F.right("o.value", F.lit(32)))).otherwise(F.lower("o.value"))
    return every.select("id", "o.type", value.alias("value")).groupBy("id", "type", "value").agg(F.count("*").alias("occurrences"))


def candidate_value(column: str | Column) -> Column:
    """struct(type, value, error): what a token is, or why it is nothing."""
    v = F.trim(refanged(column))
    digest = hash_type(v)
    one = lambda kind, value: F.struct(F.lit(kind).alias("type"), value.alias("value"), F.lit(None).cast("string").alias("error"))
    bad = lambda why: F.struct(F.lit(None).cast("string").alias("type"), F.lit(None).cast("string").alias("value"), F.lit(why).alias("error"))
    return (
        F.when(v == "", bad("empty"))
        .when(~v.rlike("[A-Za-z0-9]"), bad("no_alphanumeric"))
        .when(v.rlike(r"(?i)^CVE-\d{4}-\d{4,7}$"), one("cve", F.upper(v)))
        .when(v.contains("@") & v.rlike(f"^{SHAPES['email']}$"), one("email", F.lower(v)))
        .when(v.contains("@"), bad("invalid_email"))
        .when(v.rlike(r"^T\d{4}(\.\d{3})?$"), one("technique", v))
        .when(v.rlike(r"^[0-9.]+/\d+$"), F.when(F.substring_index(v, "/", 1).rlike(IPV4) & F.substring_index(v, "/", -1).cast("int").between(1, 32), one("cidr", v)).otherwise(bad("invalid_cidr")))
        .when(v.rlike(IPV4), one("ip", v))
        .when(v.rlike(r"^[0-9]+(\.[0-9]+){3}$"), bad("invalid_ip"))
        .when(v.rlike("(?i)^https?://"), one("url", v))
        .when(digest.isNotNull(), F.struct(digest.alias("type"), F.lower(v).alias("value"), F.lit(None).cast("string").alias("error")))
        .when(v.rlike("^[0-9a-fA-F]{24,}$"), bad("invalid_hash"))
        .when(v.rlike(r"(?i)^([a-z0-9]([a-z0-9-]{0,61}[a-z0-9])?\.)+[a-z]{2,}$"), one("domain", F.lower(v)))
        .when(v.contains("."), bad("invalid_domain"))
        .otherwise(bad("unrecognized"))
    )


#: The decision about a candidate: the first rule whose facts all hold ("-" before a fact: it does not hold).
# fixed values: names of rules, their outcomes and their order
MEMBERSHIP_RULES = (
    ("R01_not_an_ioc_observable", "excluded", "excluded"),
    ("R10_publisher_assertion", "member", "asserted"),
    ("R20_publisher_stance", "context_only", "stance_blocked"),
    ("R21_non_asserting_section", "context_only", "nothing_asserted"),
    ("R22_grounded_model_context", "context_only", "model_says_context"),
    ("R30_structured_inventory", "member", "-curated structured"),
    ("R34_sample_hash", "member", "-curated sample_hash -operational"),
    ("R32_grounded_model_assessment", "needs_review", "-curated model_warns"),
    ("R31_operational_statement", "needs_review", "-curated operational"),
    ("R33_mention_needs_review", "needs_review", "-curated"),
    ("R40_structured_rows_uncertain_section", "needs_review", "structured"),
    ("R41_operational_statement", "needs_review", "operational"),
    ("R42_grounded_model_assessment", "needs_review", "model_warns model_grounded"),
    ("R43_undecided_sample_hash", "needs_review", "sample_hash"),
    ("R44_unresolved_section_narrative", "needs_review", "narrative"),
    ("R50_passing_mention", "context_only", ""),
)


def membership_facts() -> dict[str, Column]:
    """What the rules ask about a candidate, never null.

    Reads excluded, explicit, stance_blocked, sections (array), model (text), model_supported, model_applied, curated,
    structured, operational, sample_hash, narrative. An unsaid model_supported or model_applied counts as said for a
    warning and as not said for anything else.
    """
    flag = lambda name, unsaid=False: F.coalesce(F.col(name), F.lit(unsaid))
    model = F.coalesce(F.col("model"), F.lit(""))
    same = {name: flag(name) for name in ("excluded", "stance_blocked", "curated", "structured", "operational", "sample_hash", "narrative")}
    silent = F.filter("sections", lambda s: s == "non_asserting")
    return same | {
        "asserted": flag("explicit"),
        "nothing_asserted": F.coalesce((F.size("sections") > 0) & (F.size(silent) == F.size("sections")), F.lit(False)),
        "model_says_context": (model == "context_only") & flag("model_applied"),
        "model_warns": model.isin("malicious", "suspicious") & flag("model_supported", True) & flag("model_applied", True),
        "model_grounded": flag("model_supported"),
    }


def membership_rule() -> Column:
    """The first rule that decides about a candidate: struct(rule, outcome)."""
    facts, decisions = membership_facts(), []
    for rule, outcome, needs in MEMBERSHIP_RULES:
        holds = F.lit(True)
        for need in needs.split():
            holds = holds & (~facts[need[1:]] if need.startswith("-") else facts[need])
        decisions.append(F.when(holds, F.struct(F.lit(rule).alias("rule"), F.lit(outcome).alias("outcome"))))
    return F.coalesce(*decisions)


def scored(found: DataFrame, expected: DataFrame, key: list[str]) -> DataFrame:
    """True and false positives, misses, precision and recall of found against expected keys."""
    f, e = found.select(*key).distinct().withColumn("f", F.lit(1)), expected.select(*key).distinct().withColumn("e", F.lit(1))
    counts = f.join(e, key, "full").agg(*(F.count_if(c).alias(n) for n, c in (("tp", F.col("f").isNotNull() & F.col("e").isNotNull()), ("fp", F.col("e").isNull()), ("fn", F.col("f").isNull()))))
    return counts.select("*", (F.col("tp") / F.nullif(F.col("tp") + F.col("fp"), F.lit(0))).alias("precision"), (F.col("tp") / F.nullif(F.col("tp") + F.col("fn"), F.lit(0))).alias("recall"))
