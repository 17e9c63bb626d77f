"""All queries of the engine by name, with SQL that gives the same rows."""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tamarack.functions import extract
from tamarack.functions.network import ipv4_number
from tamarack.functions.text import bucket, csv_cell
from tamarack.operators import fusion, identity, joins, publish, reports
from tamarack.operators.identity import KEY
from tamarack.plans.compile import Compiler
from tamarack.plans.language import utc
from tamarack.sources import feeds
from tamarack.sources.tables import Tables, with_views

#: The moment that all queries are evaluated at.
NOW = utc("2001-07-15 00:00:00")
AT = "TIMESTAMP '2001-07-15 00:00:00'"

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def query(views: str = "", sql: str | None = None):
    """Registers a query over Tables; the SQL may use the named views."""

    def add(f: Callable[[Tables], DataFrame]):
        _QUERIES[f.__name__] = lambda spark, folder: f(Tables(spark, folder))
        if sql is not None:
            body = sql.replace("$NOW", AT)
            head = with_views(*views.split())
            _SQL[f.__name__] = (f"WITH RECURSIVE {head}, {body[5:]}" if body.startswith("WITH ") else f"WITH {head} {body}") if head else body
        return f

    return add


def _md5(text: str) -> str:
    return hashlib.md5(text.encode()).hexdigest()


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from tamarack.plans import catalog, intake, pages, texts  # noqa: F401  register their queries

    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    from tamarack.plans import catalog, intake, pages, texts  # noqa: F401

    return dict(_SQL)


def flagship(spark: SparkSession, folder: str) -> DataFrame:
    """A search page: text and date conditions, one row for each identity, newest first."""
    return _QUERIES["search_page"](spark, folder)


# ---- identity in SQL, shared by the checks -------------------------------------------------------------------------
ANNOTATED = """annotated AS (
  SELECT i.*, a.artifact, h.hash_type AS primary_type, h.hash_value AS primary_value,
    coalesce('a:' || a.artifact, 'o:' || i.observable_type || ':' || lower(i.observable)) AS identity_key
  FROM rows_in i
  LEFT JOIN (SELECT l.id, l.observable_type, CASE WHEN f.status = 'merged' AND f.merged_into IS NOT NULL THEN f.merged_into ELSE f.artifact_id END AS artifact
             FROM links l JOIN artifacts f ON f.artifact_id = l.artifact_id) a ON a.id = i.id AND a.observable_type = i.observable_type
  LEFT JOIN hashes h ON h.artifact_id = a.artifact AND h.is_primary)"""
RANKED = """ranked AS (
  SELECT *, row_number() OVER (PARTITION BY identity_key ORDER BY
      CASE WHEN lower(observable) = lower(primary_value) AND observable_type = primary_type THEN 0 ELSE 1 END,
      CASE observable_type WHEN 'sha256' THEN 0 WHEN 'sha1' THEN 1 WHEN 'md5' THEN 2 ELSE 9 END, created_at, id) AS pick,
    row_number() OVER (PARTITION BY identity_key ORDER BY created_at DESC, id DESC) AS newest FROM annotated)"""
IDENTITIES = """found AS (
  SELECT identity_key, max(CASE WHEN pick = 1 THEN id END) AS id, max(CASE WHEN pick = 1 THEN observable END) AS observable,
    max(CASE WHEN pick = 1 THEN observable_type END) AS observable_type, min(created_at) AS imported_at, min(first_seen_at) AS first_seen_at,
    max(last_seen_at) AS last_seen_at, max(CASE WHEN newest = 1 THEN coalesce(status, 'active') END) AS status, count(*) AS n_rows
  FROM ranked GROUP BY identity_key)"""
SEARCH_VIEWS = "items links artifacts hashes"
FOUND = ["identity_key", "id", "observable", "observable_type", "imported_at", "first_seen_at", "last_seen_at", "status", "n_rows"]


def _searched(where: str, tail: str = "SELECT * FROM found", before: str = "") -> str:
    return f"WITH {before}rows_in AS (SELECT i.* FROM items i WHERE {where}), {ANNOTATED}, {RANKED}, {IDENTITIES} {tail}"


def _search(t: Tables, text: str) -> DataFrame:
    return Compiler(t, NOW).search(text).select(*FOUND)


# ---- searches ------------------------------------------------------------------------------------------------------
@query(SEARCH_VIEWS, _searched("lower(observable) LIKE '%zone1%' AND created_at > TIMESTAMP '1996-01-01 00:00:00'", "SELECT * FROM found ORDER BY imported_at DESC, id DESC LIMIT 100"))
def search_page(t: Tables) -> DataFrame:
    return identity.page(_search(t, 'ioc contains "Zone1" AND created_at after "1996-01-01"'), 100)


@query(SEARCH_VIEWS, _searched("created_at < TIMESTAMP '2000-01-01 00:00:00'", "SELECT * FROM found WHERE (imported_at, id) < (TIMESTAMP '1999-06-01 00:00:00', 5) ORDER BY imported_at DESC, id DESC LIMIT 50"))
def keyset_page(t: Tables) -> DataFrame:
    return identity.page(_search(t, 'imported_at before "2000-01-01 00:00:00"'), 50, (utc("1999-06-01 00:00:00").replace(tzinfo=None), 5))


@query(SEARCH_VIEWS, _searched("(coalesce(status, 'active') IN ('active', 'disabled') AND NOT (lower(confidence) = 'low')) OR created_at BETWEEN TIMESTAMP '1998-01-01 00:00:00' AND TIMESTAMP '1998-01-31 00:00:00'"))
def search_status_and_confidence(t: Tables) -> DataFrame:
    return _search(t, '(status in ("active", "Disabled") AND confidence not_equals "low") OR created_at between "1998-01-01" AND "1998-01-31"')


@query(SEARCH_VIEWS + " memberships feeds manual_sources", _searched("""NOT (lower(source_name) = 'source 3' OR EXISTS (SELECT 1 FROM memberships m JOIN feeds f ON f.feed_id = m.feed_id
    WHERE m.id = i.id AND m.observable_type = i.observable_type AND lower(f.feed_name) = 'source 3')
  OR EXISTS (SELECT 1 FROM manual_sources s WHERE s.source_id = i.ioc_source_id AND lower(s.source_name) = 'source 3'))
  AND (EXISTS (SELECT 1 FROM memberships m JOIN feeds f ON f.feed_id = m.feed_id WHERE m.id = i.id AND m.observable_type = i.observable_type AND lower(f.feed_name) LIKE '%00012%')
    OR lower(source_name) LIKE '%00012%' OR EXISTS (SELECT 1 FROM manual_sources s WHERE s.source_id = i.ioc_source_id AND lower(s.source_name) LIKE '%00012%'))"""))
def search_source(t: Tables) -> DataFrame:
    return _search(t, 'source not_equals "Source 3" AND source contains "00012"')


@query(SEARCH_VIEWS + " tags candidates report_tags", _searched("""EXISTS (SELECT 1 FROM tags g WHERE g.id = i.id AND g.observable_type = i.observable_type AND g.tag = 'brand#17')
  OR EXISTS (SELECT 1 FROM candidates c JOIN report_tags r ON r.report_id = c.report_id WHERE c.id = i.id AND c.observable_type = i.observable_type AND r.tag = 'brand#17')
  OR (NOT (EXISTS (SELECT 1 FROM tags g WHERE g.id = i.id AND g.observable_type = i.observable_type AND (g.tag LIKE 'mach%'))
  OR EXISTS (SELECT 1 FROM candidates c JOIN report_tags r ON r.report_id = c.report_id WHERE c.id = i.id AND c.observable_type = i.observable_type AND r.tag LIKE 'mach%')) AND lower(observable) LIKE '10.%')"""))
def search_tag(t: Tables) -> DataFrame:
    return _search(t, 'tag equals " Brand#17 " OR (NOT tag starts_with "MACH" AND ioc starts_with "10.")')


TIMES = """times AS (SELECT id, observable_type, min(first_seen_in_feed) AS m_first, max(last_seen_in_feed) AS m_last, max(coalesce(last_changed_in_source, first_seen_in_feed)) AS m_changed
  FROM memberships GROUP BY id, observable_type), """


@query(SEARCH_VIEWS + " memberships", _searched("""(SELECT m_last FROM times t WHERE t.id = i.id AND t.observable_type = i.observable_type) > $NOW - INTERVAL '90' DAY
  AND coalesce((SELECT m_first FROM times t WHERE t.id = i.id AND t.observable_type = i.observable_type), first_seen_at) < TIMESTAMP '2001-06-01 00:00:00'
  AND NOT ((SELECT m_changed FROM times t WHERE t.id = i.id AND t.observable_type = i.observable_type) BETWEEN TIMESTAMP '2001-05-01 00:00:00' AND TIMESTAMP '2001-05-10 00:00:00')""", before=TIMES))
def search_source_times(t: Tables) -> DataFrame:
    return _search(t, 'last_seen after "now-90d" AND first_seen before "2001-06-01" AND NOT last_changed between "2001-05-01" AND "2001-05-10"')


FILE_KEYS = """same AS (SELECT artifact_id, CASE WHEN status = 'merged' AND merged_into IS NOT NULL THEN merged_into ELSE artifact_id END AS artifact FROM artifacts),
  owners AS (SELECT artifact_id FROM {source}),
  of_files AS (SELECT l.observable_type, l.id FROM owners o JOIN same s ON s.artifact_id = o.artifact_id JOIN same s2 ON s2.artifact = s.artifact JOIN links l ON l.artifact_id = s2.artifact_id), """


@query(SEARCH_VIEWS, _searched("(i.observable_type, i.id) IN (SELECT observable_type, id FROM of_files) OR (i.observable_type = 'md5' AND lower(i.observable) = md5('m64'))", before=FILE_KEYS.format(source="hashes WHERE hash_type = 'md5' AND hash_value = md5('m64')")))
def search_file_hash(t: Tables) -> DataFrame:
    return _search(t, f'md5 equals "{_md5("m64").upper()}"')


@query(SEARCH_VIEWS + " file_attributes", _searched("(i.observable_type, i.id) IN (SELECT observable_type, id FROM of_files)", before=FILE_KEYS.format(source="file_attributes WHERE attr_type = 'imphash' AND attr_value = md5('i7')")))
def search_file_attribute(t: Tables) -> DataFrame:
    return _search(t, f'imphash equals "{_md5("i7")}"')


@query(SEARCH_VIEWS, _searched("""((i.observable_type, i.id) IN (SELECT l.observable_type, l.id FROM links l JOIN same s ON s.artifact_id = l.artifact_id JOIN hashes h ON h.artifact_id = s.artifact AND h.is_primary WHERE h.hash_type = 'md5')
    OR (i.observable_type = 'md5' AND (i.observable_type, i.id) NOT IN (SELECT observable_type, id FROM links)))
  AND (i.observable_type, i.id) IN (SELECT l.observable_type, l.id FROM links l JOIN same s ON s.artifact_id = l.artifact_id JOIN hashes h ON h.artifact_id = s.artifact WHERE h.hash_type = 'sha1')""", before=FILE_KEYS.format(source="artifacts")))
def search_type(t: Tables) -> DataFrame:
    return _search(t, 'type equals "md5" AND known_hash_type in ("sha1")')


@query(SEARCH_VIEWS + " actors attributions", _searched("""EXISTS (SELECT 1 FROM actors a WHERE a.kind = 'threat_actor' AND lower(a.name) = 'group 7' AND a.id = i.id AND a.observable_type = i.observable_type)
  OR (EXISTS (SELECT 1 FROM attributions a WHERE a.kind = 'malware_family' AND a.assertion = 'current' AND lower(regexp_replace(a.label, '\\s+', ' ', 'g')) LIKE '%label 1%' AND a.id = i.id AND a.observable_type = i.observable_type)
      AND NOT EXISTS (SELECT 1 FROM actors a WHERE a.kind = 'malware_family' AND lower(a.name) IN ('group 1', 'group 2') AND a.id = i.id AND a.observable_type = i.observable_type))"""))
def search_attribution(t: Tables) -> DataFrame:
    return _search(t, 'actor equals "GROUP 7" OR (source_malware_family contains "label 1" AND malware not_in ("Group 1", "Group 2"))')


ENTITY_VIEWS = " candidates relations entities entity_aliases direct_relations report_names"
NAMED_ENTITY = """(SELECT entity_id, lower(entity_name) AS name, entity_type FROM entities UNION ALL SELECT a.entity_id, lower(alias), entity_type FROM entity_aliases a JOIN entities e ON e.entity_id = a.entity_id)"""


def _related(where: str) -> str:
    return f"""(EXISTS (SELECT 1 FROM candidates c JOIN relations r ON r.report_id = c.report_id JOIN {NAMED_ENTITY} e ON e.entity_id = r.entity_id WHERE c.id = i.id AND c.observable_type = i.observable_type AND {where})
      OR EXISTS (SELECT 1 FROM direct_relations d JOIN {NAMED_ENTITY} e ON e.entity_id = d.entity_id WHERE d.id = i.id AND {where}))"""


@query(SEARCH_VIEWS + ENTITY_VIEWS, _searched(_related("e.name LIKE '%1'") + " AND NOT " + _related("e.entity_type IN ('malware')") + """
  AND NOT EXISTS (SELECT 1 FROM candidates c WHERE c.id = i.id AND c.observable_type = i.observable_type AND c.report_id IN (10, 12))"""))
def search_reports_and_entities(t: Tables) -> DataFrame:
    return _search(t, 'related_entity ends_with "1" AND entity_type not_in ("malware") AND report_id not_in ("10", "12")')


@query(SEARCH_VIEWS + ENTITY_VIEWS, _searched(_related("e.name = 'apt 3'") + " OR (" + _related("e.entity_type IN ('tool', 'campaign')") + " AND lower(observable) LIKE '%zone%')"))
def search_entity_alias(t: Tables) -> DataFrame:
    return _search(t, 'related_entity equals "apt  3" OR (entity_type in ("tool", "campaign") AND ioc contains "zone")')


@query(SEARCH_VIEWS + ENTITY_VIEWS, _searched("""EXISTS (SELECT 1 FROM candidates c JOIN report_names r ON r.report_id = c.report_id WHERE c.id = i.id AND c.observable_type = i.observable_type
  AND (r.report_id IN (16, 22, 25) OR r.report_uuid = (SELECT report_uuid FROM report_names WHERE report_id = 7) OR r.title = 'Customer#000000043'))"""))
def search_report(t: Tables) -> DataFrame:
    """Reports by number, uuid and label."""
    h = _md5("r7")
    return _search(t, f'report_id in ("16", "22", "25", "{h[:8]}-{h[8:12]}-4{h[13:16]}-a{h[17:20]}-{h[20:]}", "customer#000000043")')


@query(SEARCH_VIEWS, _searched("(i.observable_type, i.id) IN (SELECT observable_type, id FROM of_files) OR (i.observable_type = 'md5' AND lower(i.observable) = md5('m64'))", before=FILE_KEYS.format(source="hashes WHERE hash_type = 'md5' AND hash_value = md5('m64')")))
def search_ioc_hash(t: Tables) -> DataFrame:
    """A whole hash as the value that is searched for finds the file."""
    return _search(t, f'ioc equals "{_md5("m64").upper()}"')


@query(SEARCH_VIEWS, _searched("lower(observable) = 'host6.zone6.com'"))
def search_exact(t: Tables) -> DataFrame:
    return _search(t, 'ioc equals "HOST6.zone6.com"')


# ---- classification in SQL, shared by the checks
SLUGGED = """raw_tags AS (SELECT *, string_split(trim(regexp_extract(note, '(?:^| \\| )tags=([^|]*)$', 1)), ',') AS parts FROM evidence),
  slugs_of AS (SELECT id, observable_type, source_name, CASE regexp_replace(lower(trim(category)), '[\\s_-]+', '_', 'g') WHEN 'c2' THEN 'c2_server' WHEN 'malware_download' THEN 'malware' END AS slug FROM raw_tags
    UNION SELECT id, observable_type, source_name, CASE regexp_replace(lower(trim(p)), '[\\s_-]+', '_', 'g') WHEN 'botnet' THEN 'botnet' WHEN 'spam' THEN 'spam' WHEN 'phishing_kit' THEN 'phishing_kit' END
    FROM (SELECT id, observable_type, source_name, unnest(parts) AS p FROM raw_tags)),
  stored AS (SELECT id, observable_type, ioc_source_id, source_name, regexp_replace(lower(trim(threat_classification)), '[\\s_-]+', '_', 'g') AS slug FROM items WHERE threat_classification IS NOT NULL),
  said AS (SELECT id, observable_type, slug, source_name FROM slugs_of WHERE slug IS NOT NULL
    UNION ALL SELECT id, observable_type, slug, source_name FROM stored s WHERE ioc_source_id IS NULL AND slug <> 'unknown'
      AND NOT EXISTS (SELECT 1 FROM classified c WHERE c.id = s.id AND c.observable_type = s.observable_type AND c.slug = s.slug)),
  twins AS (SELECT a.observable_type AS kind, a.id AS from_id, b.observable_type AS to_kind, b.id AS to_id FROM items a JOIN items b ON b.observable_type = a.observable_type AND b.observable = a.observable
    UNION SELECT a.observable_type, a.id, b.observable_type, b.id FROM links a JOIN links b ON b.artifact_id = a.artifact_id),
  hidden AS (SELECT DISTINCT w.to_kind, w.to_id, o.slug, lower(trim(coalesce(o.source_name, ''))) AS by_source FROM overrides o JOIN twins w ON w.from_id = o.id AND w.kind = o.observable_type),
  visible AS (SELECT * FROM said s WHERE NOT EXISTS (SELECT 1 FROM hidden h WHERE h.to_id = s.id AND h.to_kind = s.observable_type AND h.slug = s.slug AND (h.by_source = '' OR h.by_source = lower(trim(s.source_name))))),
  asserted AS (SELECT id, observable_type, slug FROM classified UNION SELECT id, observable_type, slug FROM stored s WHERE ioc_source_id IS NOT NULL AND slug <> 'unknown'
    AND NOT EXISTS (SELECT 1 FROM classified c WHERE c.id = s.id AND c.observable_type = s.observable_type)), """
CLASS_VIEWS = " classified evidence overrides"


@query(SEARCH_VIEWS + CLASS_VIEWS, _searched("(i.observable_type, i.id) IN (SELECT observable_type, id FROM visible WHERE slug = 'phishing_kit' UNION SELECT observable_type, id FROM asserted WHERE slug = 'phishing_kit') AND coalesce(status, 'active') = 'active'", before=SLUGGED))
def search_classification(t: Tables) -> DataFrame:
    return _search(t, 'classification equals "phishing-kit" AND status equals "active"')


@query(SEARCH_VIEWS + CLASS_VIEWS, _searched("(i.observable_type, i.id) NOT IN (SELECT to_kind, to_id FROM twins w JOIN (SELECT observable_type, id FROM visible WHERE slug = 'malware' UNION SELECT observable_type, id FROM asserted WHERE slug = 'malware') m ON m.observable_type = w.kind AND m.id = w.from_id)", before=SLUGGED))
def search_not_classification(t: Tables) -> DataFrame:
    return _search(t, 'NOT classification equals "malware"')


@query("items links" + CLASS_VIEWS, "WITH " + SLUGGED + """every AS (SELECT DISTINCT observable_type, id, slug, 'feed' AS origin FROM visible UNION SELECT observable_type, id, slug, 'asserted' FROM asserted),
  one AS (SELECT observable_type, id, slug, string_agg(origin, '+' ORDER BY origin) AS origins FROM every GROUP BY ALL)
  SELECT observable_type, id, string_agg(slug || ':' || origins, ',' ORDER BY slug || ':' || origins) AS classifications FROM one GROUP BY observable_type, id""")
def effective_classifications(t: Tables) -> DataFrame:
    return fusion.effective_classifications(t)


# ---- lists, exports, spools ----------------------------------------------------------------------------------------
@query(SEARCH_VIEWS, f"WITH rows_in AS (SELECT * FROM items), {ANNOTATED}" + """ SELECT identity_key, count(DISTINCT source_name) AS source_count, string_agg(DISTINCT source_name, ',' ORDER BY source_name) AS sources,
  coalesce(string_agg(DISTINCT lower(confidence), ',' ORDER BY lower(confidence)), '') AS confidences, coalesce(string_agg(DISTINCT category, ',' ORDER BY category), '') AS categories FROM annotated GROUP BY identity_key""")
def browse_rollup(t: Tables) -> DataFrame:
    out = identity.browse(identity.annotated(t.items, t))
    return out.select("identity_key", "source_count", *(F.array_join(c, ",").alias(c) for c in ("sources", "confidences", "categories")))


@query(SEARCH_VIEWS, _searched("lower(observable) LIKE 'http://%'", "SELECT row_number() OVER (ORDER BY imported_at DESC, id DESC) AS position, identity_key, id FROM found"))
def search_spool(t: Tables) -> DataFrame:
    return identity.positions(_search(t, 'ioc starts_with "http://"'), F.col("imported_at").desc(), F.col("id").desc()).select("position", "identity_key", "id")


@query(SEARCH_VIEWS, _searched("lower(confidence) = 'high'", """SELECT id, CASE WHEN observable LIKE '%,%' THEN '"' || observable || '"' ELSE observable END AS ioc, strftime(imported_at, '%Y-%m-%dT%H:%M:%SZ') AS imported, '''=' || status AS guarded FROM found"""))
def export_rows(t: Tables) -> DataFrame:
    found = _search(t, 'confidence equals "high"')
    return found.select("id", csv_cell("observable").alias("ioc"), F.date_format("imported_at", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("imported"), csv_cell(F.concat(F.lit("="), "status")).alias("guarded"))


@query("items", "SELECT id, observable, created_at FROM items ORDER BY created_at DESC NULLS LAST, id DESC LIMIT 25 OFFSET 50")
def browse_offset_page(t: Tables) -> DataFrame:
    return t.items.select("id", "observable", "created_at").orderBy(F.col("created_at").desc_nulls_last(), F.col("id").desc()).offset(50).limit(25)


# ---- fusion --------------------------------------------------------------------------------------------------------
@query("items memberships", """WITH facts AS (SELECT i.observable_type, i.observable, count(*) AS n, bool_or(m.status = 'active' AND m.purged_at IS NULL) AS live, min(CASE WHEN m.status = 'active' AND m.purged_at IS NULL THEN m.expires_at END) AS next_expiry
    FROM memberships m JOIN items i ON i.id = m.id AND i.observable_type = m.observable_type GROUP BY i.observable_type, i.observable)
  SELECT i.observable_type, i.id, CASE WHEN i.status = 'suppressed' THEN 'suppressed' WHEN i.status = 'disabled' THEN 'disabled'
      WHEN manual_status_override THEN CASE WHEN manual_expires_at <= $NOW THEN 'expired' ELSE coalesce(manual_status, 'active') END
      WHEN n IS NULL OR live THEN 'active' ELSE 'expired' END AS new_status,
    CASE WHEN coalesce(i.status IN ('suppressed', 'disabled'), false) THEN NULL WHEN manual_status_override THEN manual_expires_at ELSE next_expiry END AS expires_at
  FROM items i LEFT JOIN facts f ON f.observable_type = i.observable_type AND f.observable = i.observable""")
def global_status(t: Tables) -> DataFrame:
    return fusion.global_status(t.items, t.memberships, NOW)


@query("items memberships feeds", """WITH words AS (SELECT m.*, f.feed_name, CASE WHEN m.explicit_confidence IS NULL THEN CASE f.default_confidence WHEN 'critical' THEN 'high' ELSE f.default_confidence END ELSE m.explicit_confidence END AS word
    FROM memberships m JOIN feeds f ON f.feed_id = m.feed_id WHERE m.purged_at IS NULL),
  best AS (SELECT *, row_number() OVER (PARTITION BY id, observable_type ORDER BY CASE status WHEN 'active' THEN 0 ELSE 1 END, CASE word WHEN 'high' THEN 3 WHEN 'medium' THEN 2 ELSE 1 END DESC, first_seen_in_feed DESC, feed_id DESC) AS pick
    FROM words WHERE word IS NOT NULL),
  manual AS (SELECT *, CASE WHEN manual_status_override AND lower(confidence) IN ('low', 'medium', 'high') THEN lower(confidence) END AS by_hand FROM items)
  SELECT i.observable_type, i.id, coalesce(by_hand, word) AS effective, CASE WHEN by_hand IS NOT NULL THEN 'manual' WHEN word IS NULL THEN 'unknown' WHEN explicit_confidence IS NULL THEN 'feed_default' ELSE 'feed_entry' END AS origin,
    CASE WHEN by_hand IS NULL THEN feed_name END AS feed_name
  FROM manual i LEFT JOIN best b ON b.id = i.id AND b.observable_type = i.observable_type AND b.pick = 1""")
def effective_confidence(t: Tables) -> DataFrame:
    return fusion.effective_confidence(t.memberships, t.feeds, t.items)


@query("actors attributions", """WITH every AS (SELECT observable_type, id, kind, lower(trim(regexp_replace(name, '\\s+', ' ', 'g'))) AS label, 'analyst' AS origin, true AS direct, NULL::BIGINT AS feed_id FROM actors
    UNION ALL SELECT observable_type, id, kind, lower(trim(regexp_replace(label, '\\s+', ' ', 'g'))), 'source_reported', direct, feed_id FROM attributions WHERE assertion = 'current')
  SELECT observable_type, id, kind, label, CASE WHEN min(origin) = max(origin) THEN min(origin) ELSE 'mixed' END AS origin, bool_or(direct) AS direct, count(DISTINCT feed_id) AS sources FROM every GROUP BY observable_type, id, kind, label""")
def merged_attributions(t: Tables) -> DataFrame:
    return fusion.merged_attributions(t)


@query("items suppressions", """SELECT i.observable_type, i.id FROM items i WHERE EXISTS (SELECT 1 FROM suppressions s WHERE lower(s.ioc_type) = i.observable_type AND s.ioc_value = lower(i.observable)
  AND s.active AND s.deleted_at IS NULL AND (s.expires_at IS NULL OR s.expires_at > $NOW))""")
def suppressed_rows(t: Tables) -> DataFrame:
    return fusion.suppressed(t.items, t.suppressions, NOW)


@query("suppressions", "SELECT state, count(*) AS n FROM (SELECT CASE WHEN deleted_at IS NOT NULL THEN 'deleted' WHEN NOT active THEN 'disabled' WHEN expires_at <= $NOW THEN 'expired' ELSE 'active' END AS state FROM suppressions) GROUP BY state")
def suppression_states(t: Tables) -> DataFrame:
    return fusion.suppression_status(t.suppressions, NOW).groupBy("state").agg(F.count("*").alias("n"))


@query("memberships", """SELECT observable_type, id, feed_id, CASE WHEN feed_id % 3 = 0 THEN NULL WHEN feed_id % 3 = 1 THEN last_seen_in_feed + INTERVAL '45' DAY WHEN purged_at IS NOT NULL THEN purged_at + INTERVAL '7' DAY END AS policy_expires_at FROM memberships""")
def policy_expiry(t: Tables) -> DataFrame:
    mode = F.when(F.col("feed_id") % 3 == 0, "never").when(F.col("feed_id") % 3 == 1, "last_seen_ttl").otherwise("missing_from_feed_ttl")
    rows = t.memberships.withColumn("missing_since", F.col("purged_at"))
    return rows.select(*KEY, "feed_id", fusion.policy_expiry(mode, F.lit(45), F.lit(7)).alias("policy_expires_at"))


# ---- joins ---------------------------------------------------------------------------------------------------------
def _networks(t: Tables) -> DataFrame:
    base = t.supplier.select(F.concat(F.col("s_suppkey") % 223 + 1, F.lit("."), F.col("s_suppkey") % 5, F.lit(".0.0/"), F.lit(8) + (F.col("s_suppkey") % 4) * 8).alias("cidr"))
    return feeds.network_list(base)


NUMBERS = "numbers AS (SELECT id, list_reduce(list_transform(string_split(observable, '.'), lambda x: x::BIGINT), lambda a, b: a * 256 + b) AS number FROM items WHERE observable_type = 'ip')"


@query("items", f"""WITH {NUMBERS}, nets AS (SELECT DISTINCT (n - n % size)::BIGINT AS lo, bits, (n - n % size + size - 1)::BIGINT AS hi FROM (
    SELECT (s_suppkey % 223 + 1) * 16777216 + (s_suppkey % 5) * 65536 AS n, 8 + (s_suppkey % 4) * 8 AS bits, 1::BIGINT << (32 - (8 + (s_suppkey % 4) * 8)) AS size FROM supplier)),
  met AS (SELECT id, lo, bits, row_number() OVER (PARTITION BY id ORDER BY bits DESC) AS pick FROM numbers JOIN nets ON number BETWEEN lo AND hi AND bits < 32)
  SELECT id, lo AS network, bits::INTEGER AS bits FROM met WHERE pick = 1""")
def network_containment(t: Tables) -> DataFrame:
    numbers = t.items.where("observable_type = 'ip'").select("id", ipv4_number("observable").alias("number"))
    return joins.longest_prefix(numbers, _networks(t), "number", "id")


@query("", """WITH iv AS (SELECT c_custkey * 700 AS lo, c_custkey * 700 + 300 + c_custkey % 7 * 250 AS hi, c_name AS name FROM customer),
  met AS (SELECT event_id, name, row_number() OVER (PARTITION BY event_id ORDER BY hi - lo, lo) AS pick FROM events JOIN iv ON event_id * 97 BETWEEN lo AND hi)
  SELECT e.event_id, m.name FROM events e LEFT JOIN met m ON m.event_id = e.event_id AND m.pick = 1""")
def interval_lookup(t: Tables) -> DataFrame:
    spans = t.customer.select((F.col("c_custkey") * 700).alias("lo"), (F.col("c_custkey") * 700 + 300 + F.col("c_custkey") % 7 * 250).alias("hi"), F.col("c_name").alias("name"))
    return joins.narrowest_interval(t.events.select("event_id", (F.col("event_id") * 97).alias("p")), spans, "p", "event_id", 2048)


@query("reports", """WITH steps AS (SELECT report_id, report_id AS place, 0 AS steps FROM reports UNION ALL SELECT s.report_id, r.superseded_by, s.steps + 1 FROM steps s JOIN reports r ON r.report_id = s.place
    WHERE r.superseded_by IS NOT NULL AND r.superseded_by IN (SELECT report_id FROM reports) AND s.steps < 16)
  SELECT report_id, place AS "end", steps FROM (SELECT *, row_number() OVER (PARTITION BY report_id ORDER BY steps DESC) AS pick FROM steps) WHERE pick = 1""")
def supersession_ends(t: Tables) -> DataFrame:
    known = t.reports.select(F.col("report_id").alias("superseded_by"), F.lit(True).alias("known"))
    rows = t.reports.join(known, "superseded_by", "left").select("report_id", F.when(F.col("known"), F.col("superseded_by")).alias("superseded_by"))
    return joins.chain_ends(rows, "report_id", "superseded_by")


@query("items memberships feeds tags", """SELECT i.id, i.observable_type, f.feed_key, g.tag FROM items i JOIN memberships m ON m.id = i.id AND m.observable_type = i.observable_type JOIN feeds f ON f.feed_id = m.feed_id
  LEFT JOIN tags g ON g.id = i.id AND g.observable_type = i.observable_type AND g.enabled WHERE m.status = 'active' AND i.observable_type IN ('ip', 'url')""")
def active_memberships(t: Tables) -> DataFrame:
    rows = t.items.where("observable_type in ('ip', 'url')").select(*KEY)
    found = rows.join(t.memberships.where("status = 'active'").select(*KEY, "feed_id"), KEY).join(t.feeds.select("feed_id", "feed_key"), "feed_id")
    return found.join(t.tags.where("enabled").select(*KEY, "tag"), KEY, "left").select("id", "observable_type", "feed_key", "tag")


@query("memberships", """SELECT observable_type, id, feed_id FROM memberships m WHERE status = 'active' AND NOT EXISTS (SELECT 1 FROM memberships s WHERE s.id = m.id AND s.observable_type = m.observable_type AND s.feed_id = m.feed_id AND s.last_seen_in_feed >= TIMESTAMP '1998-01-01 00:00:00')""")
def missing_from_snapshot(t: Tables) -> DataFrame:
    key = [*KEY, "feed_id"]
    return joins.snapshot_missing(t.memberships.where("status = 'active'"), t.memberships.where("last_seen_in_feed >= timestamp_ntz '1998-01-01'"), key).select(*key)


INCOMING = "SELECT observable_type, id, feed_id, first_seen_in_feed AS first_seen, last_seen_in_feed AS last_seen, coalesce(explicit_confidence, 'none') AS fingerprint FROM {memberships} WHERE id % 4 <> 0"
STORED = """SELECT observable_type, id, feed_id, first_seen_in_feed + INTERVAL '1' DAY AS first_seen, last_seen_in_feed + INTERVAL '1' DAY * (id % 3 - 1) AS last_seen,
  CASE WHEN id % 5 = 0 THEN NULL WHEN id % 7 = 0 THEN 'old' ELSE coalesce(explicit_confidence, 'none') END AS fingerprint, status, purged_at AS missing_since, id % 11 = 0 AS override_enabled FROM {memberships} WHERE id % 3 <> 0"""


@query("memberships", f"""WITH incoming AS ({INCOMING.format(memberships="memberships")}), stored AS ({STORED.format(memberships="memberships")}) SELECT i.observable_type, i.id, i.feed_id, CASE WHEN s.status IS NULL THEN 'created' WHEN override_enabled THEN 'overridden' WHEN s.status = 'expired' OR missing_since IS NOT NULL THEN 'reactivated'
    WHEN s.fingerprint IS NULL THEN 'adopted' WHEN s.fingerprint <> i.fingerprint THEN 'changed' ELSE 'unchanged' END AS outcome, least(i.first_seen, s.first_seen) AS first_seen, greatest(i.last_seen, s.last_seen) AS last_seen,
    CASE WHEN override_enabled THEN s.status ELSE 'active' END AS status, i.fingerprint FROM incoming i LEFT JOIN stored s ON s.id = i.id AND s.observable_type = i.observable_type AND s.feed_id = i.feed_id""")
def membership_upsert(t: Tables) -> DataFrame:
    incoming, stored = (t.spark.sql(x, memberships=t.memberships) for x in (INCOMING, STORED))
    return joins.membership_outcomes(stored, incoming, [*KEY, "feed_id"])


# ---- published feeds -----------------------------------------------------------------------------------------------
FEED = publish.Feed(types=("domain", "hash", "ip"), window="7d", min_confidence=25, include_tags=("brand#2", "brand#3", "brand#4", "brand#12", "brand#21"), exclude_tags=("brand#7",))
WIDE = publish.Feed(types=("domain", "hash", "ip", "url"), exclude_expired=False)
SCORED = """*, coalesce(last_seen_log, last_seen_at, created_at) AS recency, CASE lower(confidence) WHEN 'high' THEN 100 WHEN 'medium' THEN 50 WHEN 'low' THEN 25 ELSE 0 END AS score"""
SAFE = "coalesce(status, 'active') <> 'suppressed' AND NOT (lower(coalesce(category, '')) LIKE '%false%positive%') AND lower(coalesce(category, '')) <> 'fp'"
WIDE_ROWS = f"rows_in AS (SELECT {SCORED} FROM items WHERE {SAFE})"
LINED = """lined AS (SELECT *, CASE WHEN observable_type = 'ip' AND (split_part(observable, '.', 1)::INT IN (0, 10, 127) OR split_part(observable, '.', 1)::INT >= 224
      OR (split_part(observable, '.', 1) = '169' AND split_part(observable, '.', 2) = '254') OR (split_part(observable, '.', 1) = '172' AND split_part(observable, '.', 2)::INT BETWEEN 16 AND 31)
      OR (split_part(observable, '.', 1) = '192' AND split_part(observable, '.', 2) = '168')) THEN NULL WHEN observable_type = 'url' OR observable_type = 'ip' THEN observable ELSE lower(observable) END AS line FROM rows_in),
  picked AS (SELECT *, row_number() OVER (PARTITION BY lower(line) ORDER BY recency DESC, score DESC, observable, id) AS pick FROM lined WHERE line IS NOT NULL)"""


@query("items tags", f"""WITH rows_in AS (SELECT {SCORED} FROM items i WHERE observable_type IN ('domain', 'ip', 'md5', 'sha1', 'sha256') AND {SAFE} AND coalesce(status, 'active') = 'active'
    AND EXISTS (SELECT 1 FROM tags g WHERE g.id = i.id AND g.observable_type = i.observable_type AND g.enabled AND g.tag IN ('brand#2', 'brand#3', 'brand#4', 'brand#12', 'brand#21'))
    AND NOT EXISTS (SELECT 1 FROM tags g WHERE g.id = i.id AND g.observable_type = i.observable_type AND g.tag = 'brand#7')), {LINED}
  SELECT line, observable_type, id, recency, score FROM picked WHERE pick = 1 AND recency >= $NOW - INTERVAL '7' DAY AND score >= 25""".replace("FROM lined WHERE line IS NOT NULL", "FROM lined WHERE line IS NOT NULL AND recency >= $NOW - INTERVAL '7' DAY AND score >= 25"))
def published_window(t: Tables) -> DataFrame:
    return publish.selected(publish.eligible(t, FEED, NOW)).select("line", "observable_type", "id", "recency", "score")


@query("items", f"WITH {WIDE_ROWS}, {LINED} SELECT line, observable_type, id, recency, score FROM picked WHERE pick = 1 ORDER BY recency DESC, score DESC, line LIMIT 500")
def published_top(t: Tables) -> DataFrame:
    return publish.selected(publish.eligible(t, WIDE, NOW), 500).select("line", "observable_type", "id", "recency", "score")


@query("items", f"""WITH {WIDE_ROWS}, {LINED} SELECT line, CASE observable_type WHEN 'ip' THEN '[ipv4-addr:value = ''' WHEN 'domain' THEN '[domain-name:value = ''' WHEN 'url' THEN '[url:value = ''' WHEN 'md5' THEN '[file:hashes.MD5 = ''' ELSE '[file:hashes.''SHA-256'' = ''' END || line || ''']' AS pattern,
  created_at AS created, greatest(created_at, last_seen_at) AS modified FROM picked WHERE pick = 1 AND last_seen_at IS NOT NULL""")
def published_stix(t: Tables) -> DataFrame:
    return publish.stix_objects(publish.selected(publish.eligible(t, WIDE, NOW))).drop("stix_id")


@query("items", f"""WITH {WIDE_ROWS}, {LINED} SELECT line, '{{"value":"' || line || '","type":"' || observable_type || '","confidence":' || score || ',"first_seen":"' || strftime(created_at, '%Y-%m-%dT%H:%M:%SZ') || '"'
  || CASE WHEN last_seen_at IS NULL THEN '' ELSE ',"last_seen":"' || strftime(last_seen_at, '%Y-%m-%dT%H:%M:%SZ') || '"' END || '}}' AS item FROM picked WHERE pick = 1""")
def published_json(t: Tables) -> DataFrame:
    return publish.json_items(publish.selected(publish.eligible(t, WIDE, NOW)))


@query("items", f"""WITH {WIDE_ROWS}, {LINED} SELECT chunk_key, count(*) AS items, sum(digest)::BIGINT AS digest FROM (SELECT (('0x' || substr(sha256('o:' || observable_type || ':' || lower(line)), 1, 8))::BIGINT & 63)::INTEGER AS chunk_key, ('0x' || substr(md5(line), 1, 8))::BIGINT AS digest FROM picked WHERE pick = 1) GROUP BY chunk_key""")
def published_chunks(t: Tables) -> DataFrame:
    return publish.chunk_manifest(publish.selected(publish.eligible(t, WIDE, NOW)), publish.chunk_count(0))


@query("items", f"""WITH {WIDE_ROWS}, {LINED}, a AS (SELECT line FROM picked WHERE pick = 1), rows_b AS (SELECT * FROM lined WHERE recency >= $NOW - INTERVAL '7' DAY AND coalesce(status, 'active') = 'active'), b AS (SELECT DISTINCT lower(line) AS k, line FROM rows_b WHERE line IS NOT NULL)
  SELECT (SELECT count(*) FROM b WHERE line NOT IN (SELECT line FROM a)) AS added, (SELECT count(*) FROM a WHERE line NOT IN (SELECT line FROM b)) AS removed, (SELECT count(*) FROM a WHERE line IN (SELECT line FROM b)) AS unchanged""")
def feed_preview(t: Tables) -> DataFrame:
    old = publish.selected(publish.eligible(t, WIDE, NOW))
    new = publish.selected(publish.eligible(t, publish.Feed(types=WIDE.types, window="7d"), NOW))
    return publish.preview(old, new)


@query("items", """SELECT id FROM items WHERE coalesce(last_seen_log, last_seen_at, created_at) >= $NOW - INTERVAL '4' DAY AND coalesce(last_seen_log, last_seen_at, created_at) < $NOW - INTERVAL '3' DAY""")
def window_departures(t: Tables) -> DataFrame:
    return publish.departures(t.items, NOW - timedelta(days=1), NOW, "3d").select("id")


PROJECTED = f"""{ANNOTATED}, best AS (SELECT *, row_number() OVER (PARTITION BY identity_key ORDER BY recency DESC, CASE WHEN lower(observable) = lower(primary_value) AND observable_type = primary_type THEN 0 ELSE 1 END,
    CASE observable_type WHEN 'sha256' THEN 0 WHEN 'sha1' THEN 1 WHEN 'md5' THEN 2 ELSE 9 END, id) AS pick FROM annotated)"""


@query(SEARCH_VIEWS, f"WITH {WIDE_ROWS}, {PROJECTED} SELECT identity_key, observable_type, observable, recency, score FROM best WHERE pick = 1")
def incremental_projection(t: Tables) -> DataFrame:
    """A projection of older rows, refreshed with those that changed since; equal to a full one."""
    changed = t.items.where("id % 10 < 3")
    older = publish.projection(t, WIDE, NOW, t.items.where("id % 10 >= 3"))
    return publish.refreshed(older, t, WIDE, NOW, changed).drop("fingerprint")


@query(SEARCH_VIEWS, f"""WITH {WIDE_ROWS}, {PROJECTED}, n AS (SELECT * FROM best WHERE pick = 1), old_best AS (SELECT *, row_number() OVER (PARTITION BY identity_key ORDER BY recency DESC, CASE WHEN lower(observable) = lower(primary_value) AND observable_type = primary_type THEN 0 ELSE 1 END,
    CASE observable_type WHEN 'sha256' THEN 0 WHEN 'sha1' THEN 1 WHEN 'md5' THEN 2 ELSE 9 END, id) AS p2 FROM annotated WHERE id % 10 >= 3), o AS (SELECT * FROM old_best WHERE p2 = 1)
  SELECT change, count(*) AS n FROM (SELECT CASE WHEN o.identity_key IS NULL THEN 'entered' WHEN n.identity_key IS NULL THEN 'left' WHEN (o.observable, o.recency, o.score) IS DISTINCT FROM (n.observable, n.recency, n.score) THEN 'updated' END AS change
    FROM o FULL JOIN n ON n.identity_key = o.identity_key) WHERE change IS NOT NULL GROUP BY change""")
def projection_delta(t: Tables) -> DataFrame:
    older = publish.projection(t, WIDE, NOW, t.items.where("id % 10 >= 3"))
    return publish.delta(older, publish.projection(t, WIDE, NOW)).groupBy("change").agg(F.count("*").alias("n"))


# ---- reports and counts --------------------------------------------------------------------------------------------
@query("items memberships feeds manual_sources", """WITH every AS (SELECT f.feed_name AS source, count(DISTINCT (i.observable, i.observable_type)) AS n FROM memberships m JOIN items i ON i.id = m.id AND i.observable_type = m.observable_type JOIN feeds f ON f.feed_id = m.feed_id
    WHERE m.status = 'active' GROUP BY f.feed_name UNION ALL SELECT s.source_name, count(DISTINCT (i.observable, i.observable_type)) FROM items i JOIN manual_sources s ON s.source_id = i.ioc_source_id GROUP BY s.source_name)
  SELECT source, sum(n)::BIGINT AS indicators FROM every GROUP BY source ORDER BY indicators DESC, source LIMIT 20""")
def top_sources(t: Tables) -> DataFrame:
    return reports.top_sources(t, 20)


@query("items", "SELECT observable_type, count(DISTINCT lower(observable)) AS indicators, count(*) AS n_rows, count(*) FILTER (coalesce(status, 'active') = 'active') AS active FROM items GROUP BY observable_type")
def counts_by_type(t: Tables) -> DataFrame:
    return reports.counts_by_type(t.items)


@query("memberships evidence feeds", """SELECT f.feed_key, count(DISTINCT (m.observable_type, m.id)) AS members, count(DISTINCT CASE WHEN e.id IS NOT NULL THEN e.observable_type || e.id END) AS evidenced, round(100.0 * count(DISTINCT CASE WHEN e.id IS NOT NULL THEN e.observable_type || e.id END) / nullif(count(DISTINCT (m.observable_type, m.id)), 0), 1)::DOUBLE AS coverage
  FROM memberships m JOIN feeds f ON f.feed_id = m.feed_id LEFT JOIN evidence e ON e.id = m.id AND e.observable_type = m.observable_type AND e.feed_id = m.feed_id GROUP BY f.feed_key""")
def evidence_coverage(t: Tables) -> DataFrame:
    return reports.evidence_coverage(t)


@query("", """SELECT CAST(ts AS DATE) AS day, event_type, count(*) AS calls, count(*) FILTER (event_type <> 'error') AS hits, sum(json_extract(props, '$.k')::BIGINT)::BIGINT AS units, CASE WHEN count(*) FILTER (value > 0) > 0 THEN round(sum(CASE WHEN value > 0 THEN value END) / count(*) FILTER (value > 0), 1) END AS mean_value FROM events GROUP BY ALL""")
def usage_by_day(t: Tables) -> DataFrame:
    return reports.usage_by_day(t.events)


@query("reports report_tags", """SELECT report_id, title FROM reports r WHERE NOT deleted AND superseded_by IS NULL AND (lower(title) LIKE '%9%' OR EXISTS (SELECT 1 FROM report_tags g WHERE g.report_id = r.report_id AND g.tag LIKE '%9%'))
  AND tlp IS DISTINCT FROM 'green' ORDER BY score DESC NULLS LAST, report_id DESC LIMIT 50""")
def report_list(t: Tables) -> DataFrame:
    return reports.report_list(t.reports, t.report_tags, "9", not_tlp="green", limit=50)


@query("actors attributions memberships", """WITH refs AS (SELECT observable_type, id, kind || ':' || name AS ref, true AS direct, NULL::TIMESTAMP AS linked_at FROM actors UNION ALL SELECT a.observable_type, a.id, kind || ':' || label, direct, m.first_seen_in_feed
    FROM attributions a JOIN memberships m ON m.id = a.id AND m.observable_type = a.observable_type AND m.feed_id = a.feed_id),
  r AS (SELECT *, row_number() OVER (PARTITION BY observable_type, id ORDER BY direct DESC, linked_at DESC NULLS LAST, ref) AS place, count(*) OVER (PARTITION BY observable_type, id) AS total FROM refs)
  SELECT observable_type, id, ref, place, total FROM r WHERE place <= 3""")
def top_references(t: Tables) -> DataFrame:
    return reports.top_references(t, 3)


@query("memberships", """SELECT feed_id, count(*) AS affected, count(*) FILTER (others = 1) AS only_here, count(*) FILTER (others > 1) AS shared FROM (SELECT feed_id, count(*) OVER (PARTITION BY observable_type, id) AS others FROM memberships) WHERE feed_id % 10 = 0 GROUP BY feed_id""")
def purge_preview(t: Tables) -> DataFrame:
    return reports.purge_preview(t.memberships, F.col("feed_id") % 10 == 0)


@query("actors attributions", """WITH k AS (SELECT observable_type, id, bool_or(src = 'a') AS analyst, bool_or(src = 's') AS source FROM (SELECT observable_type, id, 'a' AS src FROM actors UNION ALL SELECT observable_type, id, 's' FROM attributions WHERE assertion = 'current') GROUP BY observable_type, id)
  SELECT count(*) AS total, count(*) FILTER (analyst AND source) AS both_said, count(*) FILTER (analyst AND NOT source) AS analyst_only, count(*) FILTER (source AND NOT analyst) AS source_only FROM k""")
def discovery_summary(t: Tables) -> DataFrame:
    return reports.discovery_summary(t)


@query("items", """WITH q AS (SELECT 'HOST' || (n * 5 + 1) || '.zone' || ((n * 5 + 1) % 97) || '.com' AS value FROM (SELECT c_custkey AS n FROM customer)),
  first_rows AS (SELECT lower(observable) AS v, id, row_number() OVER (PARTITION BY lower(observable) ORDER BY created_at, id) AS pick FROM items WHERE observable_type = 'domain')
  SELECT value, id, CASE WHEN id IS NULL THEN 'new' ELSE 'matched' END AS match_state FROM q LEFT JOIN first_rows f ON f.v = lower(q.value) AND f.pick = 1""")
def bulk_lookup(t: Tables) -> DataFrame:
    n = F.col("c_custkey") * 5 + 1
    wanted = t.customer.select(F.concat(F.lit("HOST"), n, F.lit(".zone"), n % 97, F.lit(".com")).alias("value"))
    return reports.bulk_lookup(wanted, t.items, "domain")


@query("items tags", """SELECT outcome, count(*) AS n FROM (SELECT CASE WHEN EXISTS (SELECT 1 FROM tags g WHERE g.id = i.id AND g.observable_type = i.observable_type AND g.tag = 'brand#5') THEN 'skipped' WHEN coalesce(i.status, 'active') = 'disabled' THEN 'failed' ELSE 'succeeded' END AS outcome
  FROM items i WHERE lower(observable) LIKE '%zone%' AND created_at > TIMESTAMP '1997-01-01 00:00:00') GROUP BY outcome""")
def bulk_tag_outcomes(t: Tables) -> DataFrame:
    rows = Compiler(t, NOW).rows('ioc contains "zone" AND created_at after "1997-01-01"')
    return reports.bulk_tag(rows, t.tags, "brand#5").groupBy("outcome").agg(F.count("*").alias("n"))


@query("", "SELECT event_id, ts, user_id FROM events WHERE ts >= TIMESTAMP '2024-01-10 00:00:00' AND ts < TIMESTAMP '2024-01-20 00:00:00' AND (lower(event_type) LIKE '%err%' OR lower(props) LIKE '%99%') ORDER BY ts DESC, event_id DESC LIMIT 10000")
def audit_search(t: Tables) -> DataFrame:
    return reports.audit(t.events, "2024-01-10", "2024-01-20", ("event_type", "err"), ("props", "99"))


# ---- text ----------------------------------------------------------------------------------------------------------
@query("", """WITH one AS (SELECT doc_id, coalesce(text, '') AS text FROM documents), mails AS (SELECT doc_id, unnest(regexp_extract_all(text, '\\b[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\\.[A-Za-z0-9-]+)*\\.[A-Za-z]{2,}\\b')) AS v FROM one),
  ips AS (SELECT doc_id, unnest(regexp_extract_all(regexp_replace(text, '\\b[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\\.[A-Za-z0-9-]+)*\\.[A-Za-z]{2,}\\b', ' ', 'g'), '\\b(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])(?:\\.(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])){3}\\b')) AS v FROM one),
  digests AS (SELECT doc_id, unnest(regexp_extract_all(text, '\\b[0-9a-fA-F]{40}\\b')) AS v FROM one)
  SELECT doc_id AS id, type, value, count(*) AS occurrences FROM (SELECT doc_id, 'email' AS type, lower(v) AS value FROM mails UNION ALL SELECT doc_id, 'ip', lower(v) FROM ips UNION ALL SELECT doc_id, 'sha1', lower(v) FROM digests) GROUP BY ALL""")
def observables_in_documents(t: Tables) -> DataFrame:
    return extract.observables(t.documents, "doc_id", kinds=("email", "ip", "sha1"))


@query()
def observables_of_every_type(t: Tables) -> DataFrame:
    return extract.observables(t.documents, "doc_id")


@query()
def blocks_of_pages(t: Tables) -> DataFrame:
    return extract.html_blocks(t.pages).withColumn("zone", F.when(F.col("kind") == "heading", extract.heading_zone()))


@query("items", "SELECT id, ((('0x' || substr(sha256('o:' || observable_type || ':' || lower(observable)), 1, 8))::BIGINT) & 255)::INTEGER AS bucket FROM items")
def reconciliation_buckets(t: Tables) -> DataFrame:
    return t.items.select("id", bucket(F.concat(F.lit("o:"), "observable_type", F.lit(":"), F.lower("observable")), 256).alias("bucket"))
