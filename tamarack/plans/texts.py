"""Queries of what documents say, over blocks made from the supplied tables; imported by the registry."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tamarack.functions import documents
from tamarack.operators import publish
from tamarack.plans.registry import ANNOTATED, SEARCH_VIEWS, query
from tamarack.sources.tables import Tables

BLOCKS = """SELECT c_custkey % 40 AS doc, CAST(floor(c_custkey / 40) AS INT) AS position, CASE floor(c_custkey / 40) % 4 WHEN 0 THEN 'heading' WHEN 1 THEN 'paragraph' WHEN 2 THEN 'heading' ELSE 'paragraph' END AS kind, CASE floor(c_custkey / 40) % 4 WHEN 0 THEN 1 WHEN 2 THEN 2 ELSE 0 END AS level,
  CASE floor(c_custkey / 40) % 4 WHEN 0 THEN CASE WHEN c_custkey % 40 % 3 = 0 THEN 'Indicators of Compromise' ELSE 'Report ' || (c_custkey % 40) END WHEN 1 THEN CASE c_custkey % 5 WHEN 0 THEN 'TLP:AMBER and TLP:GREEN' WHEN 1 THEN 'the tlp:red protocol' WHEN 2 THEN 'Published on: March 5, 2021. Before 2020-01-01' WHEN 3 THEN 'seen 7 Feb 2019 and 2019-02-30' ELSE 'TLP: WHITE' END
  WHEN 2 THEN CASE WHEN c_custkey % 40 % 2 = 0 THEN 'References' ELSE 'Samples and hashes' END ELSE 'text ' || (c_custkey % 7) END AS text FROM {customer}"""


def _blocks(t: Tables) -> DataFrame:
    return t.spark.sql(BLOCKS, customer=t.customer)


MADE = "b AS (" + BLOCKS.replace("{customer}", "customer") + ")"


@query("", f"""WITH {MADE}, m AS (SELECT doc, max(CASE text WHEN 'TLP:AMBER and TLP:GREEN' THEN 2 WHEN 'TLP: WHITE' THEN 0 ELSE -1 END) AS p FROM b GROUP BY doc)
  SELECT doc, CASE p WHEN 2 THEN 'amber' ELSE 'clear' END AS tlp, CASE WHEN p >= 0 THEN 'explicit' ELSE 'default' END AS tlp_source FROM m""")
def document_markings(t: Tables) -> DataFrame:
    return documents.document_tlp(_blocks(t))


@query("", f"""WITH {MADE}, d AS (SELECT doc, position, CASE WHEN text LIKE 'Published%' THEN DATE '2021-03-05' END AS l, CASE WHEN text LIKE 'Published%' THEN DATE '2021-03-05' WHEN text LIKE 'seen%' THEN DATE '2019-02-07' END AS p FROM b WHERE position < 20),
  f AS (SELECT doc, arg_min(l, position) FILTER (l IS NOT NULL) AS l, arg_min(p, position) FILTER (p IS NOT NULL) AS p FROM d GROUP BY doc) SELECT doc, coalesce(l, p) AS published FROM f WHERE coalesce(l, p) IS NOT NULL""")
def document_dates(t: Tables) -> DataFrame:
    return documents.publication_date(_blocks(t))


@query("", f"WITH {MADE} SELECT doc, arg_min(text, position) AS title FROM b WHERE kind = 'heading' AND level = 1 GROUP BY doc")
def document_titles(t: Tables) -> DataFrame:
    return documents.document_title(_blocks(t))


@query("", f"""WITH {MADE}, h AS (SELECT *, max(CASE WHEN level = 1 THEN position END) OVER w AS p1, max(CASE WHEN level = 2 THEN position END) OVER w AS p2 FROM b WINDOW w AS (PARTITION BY doc ORDER BY position)),
  n AS (SELECT h.doc, h.position, t1.text AS one, CASE WHEN p2 > p1 THEN t2.text END AS two FROM h LEFT JOIN b t1 ON t1.doc = h.doc AND t1.position = h.p1 LEFT JOIN b t2 ON t2.doc = h.doc AND t2.position = h.p2)
  SELECT doc, position, one || coalesce(' > ' || two, '') AS path, CASE two WHEN 'References' THEN 'reference_section' WHEN 'Samples and hashes' THEN 'sample_table' ELSE CASE one WHEN 'Indicators of Compromise' THEN 'explicit_ioc_section' END END AS zone FROM n""")
def document_sections(t: Tables) -> DataFrame:
    """Every block with the headings above it and the zone that the nearest opens."""
    return documents.sections(_blocks(t)).select("doc", "position", F.array_join("path", " > ").alias("path"), "zone")


@query("", """SELECT c_custkey AS k, CASE c_custkey % 7 WHEN 0 THEN 'file_hash' WHEN 1 THEN 'object_id' WHEN 2 THEN 'key' WHEN 3 THEN 'certificate' WHEN 4 THEN 'unlabelled' WHEN 5 THEN 'file_hash' ELSE 'unlabelled' END AS kind FROM customer""")
def digest_kinds(t: Tables) -> DataFrame:
    """What digests are of, by the label before them."""
    given = t.spark.sql("""SELECT c_custkey AS k, md5('d' || c_custkey) AS d, CASE c_custkey % 7 WHEN 0 THEN 'MD5 hash: ' WHEN 1 THEN 'see commit ' WHEN 2 THEN 'file | Encryption key = ' WHEN 3 THEN 'JA3 ' WHEN 4 THEN '' WHEN 5 THEN 'key ' || md5('e') || ' sample ' ELSE 'monkey ' END AS label FROM {customer}""", customer=t.customer)
    return given.select("k", documents.digest_kind(F.concat("label", "d", F.lit(" end")), F.col("d")).alias("kind"))


@query("", """SELECT c_custkey AS k, CASE c_custkey % 8 WHEN 0 THEN 'domain' WHEN 1 THEN 'file' WHEN 2 THEN 'version' WHEN 3 THEN 'code' WHEN 4 THEN 'ip' WHEN 5 THEN 'code' WHEN 7 THEN 'version' END AS kind FROM customer""")
def dotted_kinds(t: Tables) -> DataFrame:
    given = t.spark.sql("""SELECT c_custkey AS k, CASE c_custkey % 8 WHEN 0 THEN 'Evil' || c_custkey || '.co.uk' WHEN 1 THEN 'drop' || c_custkey || '.EXE' WHEN 2 THEN 'v1.2.' || c_custkey WHEN 3 THEN 'System.Net.Web' || c_custkey WHEN 4 THEN '1.2.3.' || (c_custkey % 256) WHEN 5 THEN 'obj_' || c_custkey || '.run' WHEN 6 THEN 'no dots ' || c_custkey ELSE '10.0.19045.' || (3000 + c_custkey) END AS v FROM {customer}""", customer=t.customer)
    return given.select("k", documents.dotted_kind("v").alias("kind"))


@query("", """SELECT c_custkey % 10 AS doc, 1 AS "table", c_custkey AS "row", CASE c_custkey % 4 WHEN 0 THEN 'domain' WHEN 1 THEN 'ip' ELSE 'md5' END AS type, CASE c_custkey % 4 WHEN 0 THEN 'evil' || c_custkey || '.com' WHEN 1 THEN '3.3.3.' || (c_custkey % 256) ELSE md5('w' || c_custkey) END AS value, 'note ' || c_custkey AS description FROM customer WHERE c_custkey % 4 <> 3 AND c_custkey >= 10""")
def table_candidates(t: Tables) -> DataFrame:
    """Typed values of tables: by the header's intent, wrapped digests as one, cut ones left out."""
    rows = t.spark.sql("""SELECT c_custkey % 10 AS doc, 1 AS `table`, c_custkey AS `row`, CASE WHEN c_custkey < 10 THEN array('IOC', 'Comment') ELSE array(CASE c_custkey % 4 WHEN 0 THEN 'Evil' || c_custkey || '[.]com' WHEN 1 THEN '3.3.3[.]' || (c_custkey % 256) WHEN 2 THEN substr(md5('w' || c_custkey), 1, 20) || ' ' || substr(md5('w' || c_custkey), 21) ELSE substr(md5('w'), 1, 20) || '...' END, 'note ' || c_custkey) END AS cells FROM {customer}""", customer=t.customer)
    return documents.table_candidates(rows)


@query("", f"""WITH {MADE}, p AS (SELECT doc, count(*) AS n, count(*) FILTER (kind = 'heading') AS heads, count(DISTINCT lower(trim(text))) AS kinds FROM b WHERE doc % 5 <> 0 AND (doc % 5 <> 1 OR kind <> 'heading') GROUP BY doc)
  SELECT d.doc, CASE WHEN n IS NULL THEN 'no_blocks' ELSE concat_ws(',', CASE WHEN kinds <= n * 0.5 AND n > 1 THEN 'mostly_repeated' END, CASE WHEN heads = 0 THEN 'no_headings' END, CASE WHEN d.doc % 2 = 1 THEN 'no_indicators' END) END AS codes FROM (SELECT DISTINCT doc FROM b) d LEFT JOIN p ON p.doc = d.doc""")
def extraction_quality(t: Tables) -> DataFrame:
    every = _blocks(t)
    blocks = every.where("doc % 5 <> 0 and (doc % 5 <> 1 or kind <> 'heading')")
    found = every.select("doc").distinct().where("doc % 2 = 0")
    return documents.quality_codes(blocks, found, every.select("doc")).withColumn("codes", F.array_join("codes", ","))


EXPORTED = ("ioc", "ioc_type", "status", "source", "confidence", "tags", "first_seen_in_source", "last_seen_in_source", "created_at", "artifact_id", "primary_hash_type", "primary_hash_value", "known_hashes")


@query(SEARCH_VIEWS + " tags memberships", f"""WITH rows_in AS (SELECT * FROM items WHERE observable_type IN ('sha256', 'domain') AND id < 400), {ANNOTATED}, g AS (SELECT id, observable_type, string_agg(tag, '|' ORDER BY tag) AS tags FROM tags WHERE enabled GROUP BY ALL),
  m AS (SELECT id, observable_type, min(first_seen_in_feed) AS f, max(last_seen_in_feed) AS l FROM memberships GROUP BY ALL), h AS (SELECT artifact_id, string_agg(hash_type || ':' || hash_value, '|' ORDER BY hash_type, hash_value) AS known FROM hashes GROUP BY artifact_id)
  SELECT a.id, a.observable || ',' || a.observable_type || ',' || coalesce(a.status, 'active') || ',' || a.source_name || ',' || coalesce(a.confidence, '') || ',' || coalesce(g.tags, '') || ',' || coalesce(strftime(m.f, '%Y-%m-%dT%H:%M:%SZ'), '') || ',' || coalesce(strftime(m.l, '%Y-%m-%dT%H:%M:%SZ'), '') || ',' || strftime(a.created_at, '%Y-%m-%dT%H:%M:%SZ') || ','
    || coalesce(a.artifact, '') || ',' || coalesce(a.primary_type, a.observable_type) || ',' || coalesce(a.primary_value, a.observable) || ',' || coalesce(h.known, '') AS line
  FROM annotated a LEFT JOIN g ON g.id = a.id AND g.observable_type = a.observable_type LEFT JOIN m ON m.id = a.id AND m.observable_type = a.observable_type LEFT JOIN h ON h.artifact_id = a.artifact""")
def export_lines(t: Tables) -> DataFrame:
    """Lines of a file that people download, of the columns they ask for."""
    rows = t.items.where("observable_type in ('sha256', 'domain') and id < 400")
    return publish.export_lines(rows, t, (*EXPORTED, "no such column"))
