"""Queries of feed formats, exchange formats and scalar functions over texts made from the supplied tables; imported by the registry."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tamarack.functions import extract, text
from tamarack.functions.network import with_network
from tamarack.operators import publish, reports
from tamarack.operators.identity import KEY
from tamarack.plans import language
from tamarack.plans.registry import LINED, NOW, PROJECTED, SEARCH_VIEWS, WIDE, WIDE_ROWS, query
from tamarack.sources import exchange, feeds, records
from tamarack.sources.tables import Tables


def _texts(t: Tables, sql: str) -> DataFrame:
    return t.spark.sql(sql, customer=t.customer)


def _cases(t: Tables, rows: list[tuple], schema: str) -> DataFrame:
    return t.spark.createDataFrame(rows, schema)


# ---- feeds ---------------------------------------------------------------------------------------------------------
PLAIN = """SELECT c_custkey AS k, CASE c_custkey % 11 WHEN 0 THEN '# comment ' || c_custkey WHEN 1 THEN '' WHEN 2 THEN '7.8.' || (c_custkey % 256) || '.9' WHEN 3 THEN '  HOST' || c_custkey || '.Example-Zone.com ' WHEN 4 THEN 'HTTP://Ex' || c_custkey || '.com:80/A?b#c'
  WHEN 5 THEN upper(md5('f' || c_custkey)) WHEN 6 THEN '7.9.' || (c_custkey % 256) || '.77/24' WHEN 7 THEN 'bad value ' || c_custkey WHEN 8 THEN '2001:0DB8:0::' || (c_custkey % 9 + 1) WHEN 9 THEN '// other comment' ELSE '300.1.1.' || (c_custkey % 9) END AS value FROM {customer}"""
PLAIN_ROWS = """SELECT k, CASE k % 11 WHEN 2 THEN 'ip' WHEN 3 THEN 'domain' WHEN 4 THEN 'url' WHEN 5 THEN 'md5' WHEN 6 THEN 'ip' WHEN 8 THEN 'ipv6' END AS observable_type,
  CASE k % 11 WHEN 2 THEN '7.8.' || (k % 256) || '.9' WHEN 3 THEN 'host' || k || '.example-zone.com' WHEN 4 THEN 'http://ex' || k || '.com/A?b' WHEN 5 THEN md5('f' || k) WHEN 6 THEN '7.9.' || (k % 256) || '.0/24' WHEN 8 THEN '2001:db8::' || (k % 9 + 1) END AS observable FROM (SELECT c_custkey AS k FROM customer) WHERE k % 11 IN (2, 3, 4, 5, 6, 8)"""


@query("", f"SELECT observable_type, observable, count(*) AS n FROM ({PLAIN_ROWS}) GROUP BY ALL")
def plain_feed(t: Tables) -> DataFrame:
    """A plain list: comments go, types are inferred, addresses and networks canonical."""
    good = feeds.text_feed(_texts(t, PLAIN)).where("error is null")
    return good.groupBy("observable_type", "observable").agg(F.count("*").alias("n"))


@query("", """SELECT raw, error FROM (SELECT 'bad value ' || c_custkey AS raw, 'invalid_value' AS error FROM customer WHERE c_custkey % 11 = 7 UNION ALL SELECT '300.1.1.' || (c_custkey % 9), 'invalid_value' FROM customer WHERE c_custkey % 11 = 10) ORDER BY raw, error LIMIT 20""")
def plain_feed_rejects(t: Tables) -> DataFrame:
    return feeds.rejected(feeds.text_feed(_texts(t, PLAIN)))


@query("", f"SELECT coalesce(observable_type, 'none') AS kind, count(*) AS n FROM (SELECT CASE WHEN observable_type = 'domain' THEN 'taken' ELSE 'refused' END AS observable_type FROM ({PLAIN_ROWS}) UNION ALL SELECT 'refused' FROM customer WHERE c_custkey % 11 IN (7, 10)) GROUP BY ALL")
def feed_of_one_kind(t: Tables) -> DataFrame:
    """A list that may hold domains only."""
    rows = feeds.text_feed(_texts(t, PLAIN), kind="domain")
    return rows.groupBy(F.when(F.col("error").isNull(), "taken").otherwise("refused").alias("kind")).agg(F.count("*").alias("n"))


TABLE = """SELECT 'note, "x",Value , "Type",confidence' AS value UNION ALL SELECT '# comment, with, commas' UNION ALL SELECT '"a, ""b"" ' || c_custkey || '",Host' || c_custkey || '.net,' || CASE WHEN c_custkey % 2 = 0 THEN 'DOMAIN' ELSE '' END || ', ' || CASE WHEN c_custkey % 3 = 0 THEN 'High' ELSE 'low' END FROM {customer}"""


@query("", "SELECT 'host' || c_custkey || '.net' AS observable, 'domain' AS observable_type, CASE WHEN c_custkey % 3 = 0 THEN 'high' ELSE 'low' END AS confidence FROM customer")
def csv_feed(t: Tables) -> DataFrame:
    """A CSV list whose header quotes its cells."""
    lines = _texts(t, TABLE.replace('note, "x",Value', 'note,Value'))
    return feeds.csv_lines(lines, 'note,Value , "Type",confidence').select("observable", "observable_type", "confidence")


@query("", """SELECT * FROM (VALUES ('by type', 'csv'), ('by suffix', 'csv'), ('text type', 'txt'), ('half have commas', 'csv'), ('few have commas', 'txt'), ('nothing', 'txt'), ('commented commas', 'txt')) v(name, format)""")
def feed_formats(t: Tables) -> DataFrame:
    given = {
        "by type": ("a\nb", "text/csv; charset=utf-8", ""),
        "by suffix": ("a\nb", "", "https://x/list.CSV"),
        "text type": ("a,b\nc,d", "text/plain", ""),
        "half have commas": ("a,b\nc\nd,e\nf", "", ""),
        "few have commas": ("a,b\nc\nd\ne", "", ""),
        "nothing": ("", "", ""),
        "commented commas": ("# a,b\n// c,d\n; e,f\ng", "", ""),
    }
    return _cases(t, [(n, feeds.detect_format(*g)) for n, g in given.items()], "name string, format string")


HAUS = """SELECT CASE c_custkey % 5 WHEN 0 THEN '# c' WHEN 1 THEN '"' || c_custkey || '","2020-01-01","HTTP://U' || c_custkey || '.com/p","Online","2020-01-02","","Elf, mozi","https://l","rep"'
  WHEN 2 THEN c_custkey || ',2020-01-01,http://u' || c_custkey || '.com:80,offline,,malware_download,exe,https://l,rep' WHEN 3 THEN c_custkey || ',2020-01-01' ELSE 'id,dateadded,url,url_status,last_online,threat,tags,link,reporter' END AS value FROM {customer}"""


@query("", """SELECT c_custkey::VARCHAR AS id, CASE c_custkey % 5 WHEN 1 THEN 'http://u' || c_custkey || '.com/p' ELSE 'http://u' || c_custkey || '.com/' END AS observable, CASE c_custkey % 5 WHEN 1 THEN 'online' ELSE 'offline' END AS state,
  CASE c_custkey % 5 WHEN 1 THEN 'malware-url' ELSE 'malware_download' END AS threat, CASE c_custkey % 5 WHEN 1 THEN 'Elf,malware-url,mozi' ELSE 'exe,malware_download' END AS tags FROM customer WHERE c_custkey % 5 IN (1, 2)""")
def urlhaus_feed(t: Tables) -> DataFrame:
    return feeds.urlhaus_lines(_texts(t, HAUS)).select("id", "observable", "state", "threat", F.array_join("tags", ",").alias("tags"))


FOX = """SELECT c_custkey AS k, CASE c_custkey % 4 WHEN 0 THEN '9.8.7.' || (c_custkey % 256) || ':443' WHEN 1 THEN 'Fox' || c_custkey || '.org' WHEN 2 THEN 'https://Fox' || c_custkey || '.org/x' ELSE md5('x' || c_custkey) END AS ioc,
  CASE c_custkey % 4 WHEN 0 THEN 'ip:port' WHEN 1 THEN 'domain' WHEN 2 THEN 'url' ELSE 'md5_hash' END AS ioc_type, CASE c_custkey % 5 WHEN 0 THEN '95' WHEN 1 THEN '80' WHEN 2 THEN '50' WHEN 3 THEN '49' ELSE 'n/a' END AS confidence_level, 'fam' AS malware FROM {customer}"""


@query("", """SELECT c_custkey AS k, CASE c_custkey % 4 WHEN 0 THEN '9.8.7.' || (c_custkey % 256) WHEN 1 THEN 'fox' || c_custkey || '.org' WHEN 2 THEN 'https://fox' || c_custkey || '.org/x' ELSE md5('x' || c_custkey) END AS observable,
  CASE c_custkey % 4 WHEN 0 THEN 'ip' WHEN 1 THEN 'domain' WHEN 2 THEN 'url' ELSE 'md5' END AS observable_type, CASE c_custkey % 5 WHEN 0 THEN 'high' WHEN 1 THEN 'high' WHEN 2 THEN 'medium' WHEN 3 THEN 'low' ELSE 'medium' END AS confidence, 64 AS digits FROM customer""")
def threatfox_feed(t: Tables) -> DataFrame:
    return feeds.threatfox(_texts(t, FOX)).select("k", "observable", "observable_type", "confidence", F.length("fingerprint").alias("digits"))


BAZAAR = """SELECT CASE WHEN c_custkey % 4 = 0 THEN '# c' ELSE '"2020-01-01 00:00:00", "' || CASE WHEN c_custkey % 4 = 1 THEN 'short' ELSE upper(md5('s' || c_custkey) || md5('t' || c_custkey)) END || '", "' || md5('m' || c_custkey) || '", "no", "rep", "f,' || c_custkey || '.exe", "EXE", "application/x", "' || CASE WHEN c_custkey % 3 = 0 THEN 'n/a' ELSE 'AgentTesla' END || '", "", "", "' || md5('i') || '", "3:AbC", "T1AB"' END AS value FROM {customer}"""


@query("", """SELECT md5('s' || c_custkey) || md5('t' || c_custkey) AS sha256, md5('m' || c_custkey) AS md5, md5('i') AS imphash, '3:abc' AS ssdeep, 't1ab' AS tlsh, CASE WHEN c_custkey % 3 = 0 THEN 'exe' ELSE 'agenttesla,exe' END AS tags, 'f,' || c_custkey || '.exe' AS file_name FROM customer WHERE c_custkey % 4 IN (2, 3)""")
def malwarebazaar_feed(t: Tables) -> DataFrame:
    rows = feeds.malwarebazaar_lines(_texts(t, BAZAAR))
    return rows.select("sha256", "md5", "imphash", "ssdeep", "tlsh", F.array_join("tags", ",").alias("tags"), "file_name")


TANK = "SELECT c_custkey AS phish_id, 'HTTPS://P' || c_custkey || '.com' AS url, CASE c_custkey % 3 WHEN 0 THEN 'yes' WHEN 1 THEN 'no' END AS verified, CASE WHEN c_custkey % 5 = 0 THEN 'No' ELSE 'Yes' END AS online, 'd' || c_custkey AS submission_time FROM {customer}"


@query("", "SELECT c_custkey AS phish_id, 'https://p' || c_custkey || '.com/' AS observable, 'd' || c_custkey AS first_seen FROM customer WHERE c_custkey % 3 <> 1 AND c_custkey % 5 <> 0")
def phishtank_feed(t: Tables) -> DataFrame:
    return exchange.phishtank(_texts(t, TANK)).select("phish_id", "observable", "first_seen")


PULSES = """SELECT c_custkey AS id, 'c' || c_custkey AS created, CASE WHEN c_custkey % 2 = 0 THEN 'm' || c_custkey END AS modified, array(named_struct('type', 'hostname', 'indicator', 'H' || c_custkey || '.com', 'created', CAST(NULL AS STRING)), named_struct('type', 'domain', 'indicator', 'http://D.com/' || c_custkey, 'created', 'i' || c_custkey),
  named_struct('type', 'Mutex', 'indicator', 'x', 'created', 'i'), named_struct('type', 'FileHash-MD5', 'indicator', upper(md5('o' || (c_custkey % 10))), 'created', 'i' || c_custkey)) AS indicators FROM {customer}"""


@query("", """SELECT c_custkey AS pulse, 'domain' AS observable_type, 'h' || c_custkey || '.com' AS observable, 'c' || c_custkey AS first_seen, CASE WHEN c_custkey % 2 = 0 THEN 'm' || c_custkey END AS last_seen FROM customer
  UNION ALL SELECT c_custkey, 'url', 'http://d.com/' || c_custkey, 'i' || c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 'm' || c_custkey ELSE 'i' || c_custkey END FROM customer
  UNION ALL SELECT c_custkey, 'md5', md5('o' || (c_custkey % 10)), 'i' || c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 'm' || c_custkey ELSE 'i' || c_custkey END FROM customer""")
def otx_pulses(t: Tables) -> DataFrame:
    return feeds.otx(_texts(t, PULSES))


WARNINGS = """SELECT CASE WHEN c_custkey % 7 = 0 THEN 'no domain' WHEN c_custkey % 7 = 1 THEN '' ELSE 'Warn' || (c_custkey % 40) || '.pl.' END AS DomainAddress, CASE WHEN c_custkey % 6 <> 0 THEN lpad(CAST(c_custkey % 30 AS STRING), 3, '0') END AS InsertDate, CASE WHEN c_custkey % 11 = 0 THEN '2020' ELSE '' END AS DeleteDate, c_custkey AS RegisterPositionId FROM {customer}"""
WARNED = """r AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 7 = 0 THEN 'no domain' WHEN c_custkey % 7 = 1 THEN '' ELSE 'warn' || (c_custkey % 40) || '.pl' END AS d, CASE WHEN c_custkey % 6 <> 0 THEN lpad((c_custkey % 30)::VARCHAR, 3, '0') END AS seen, c_custkey % 11 = 0 AS gone FROM customer)"""


@query("", f"WITH {WARNED} SELECT d AS observable, seen AS first_seen, k AS position FROM (SELECT *, row_number() OVER (PARTITION BY d ORDER BY seen NULLS LAST, k) AS pick FROM r WHERE NOT gone AND d LIKE 'warn%') WHERE pick = 1")
def certpl_feed(t: Tables) -> DataFrame:
    return feeds.certpl(_texts(t, WARNINGS)).select("observable", "first_seen", "position")


@query("", f"WITH {WARNED} SELECT 'withdrawn' AS reason, count(*) AS n FROM r WHERE gone UNION ALL SELECT 'empty', count(*) FROM r WHERE NOT gone AND d = '' UNION ALL SELECT 'invalid_domain', count(*) FROM r WHERE NOT gone AND d = 'no domain' UNION ALL SELECT 'duplicate', count(*) - count(DISTINCT d) FROM r WHERE NOT gone AND d LIKE 'warn%'")
def certpl_skipped(t: Tables) -> DataFrame:
    return feeds.certpl_skipped(_texts(t, WARNINGS))


@query("", "SELECT DISTINCT 'ip' AS observable_type, CASE WHEN c_custkey % 2 = 0 THEN '5.6.' || (c_custkey % 256) || '.0/24' ELSE '5.7.8.' || (c_custkey % 256) END AS observable FROM customer WHERE c_custkey % 3 <> 0")
def block_rules(t: Tables) -> DataFrame:
    lines = _texts(t, "SELECT CASE WHEN c_custkey % 3 = 0 THEN '# rule' WHEN c_custkey % 2 = 0 THEN '5.6.' || (c_custkey % 256) || '.9/24' ELSE '5.7.8.' || (c_custkey % 256) END AS value FROM {customer}")
    return exchange.block_list(lines)


@query("", """SELECT k, kind, value, prefix FROM (SELECT c_custkey AS k, CASE WHEN c_custkey % 6 < 3 THEN 'ip' ELSE 'ipv6' END AS kind, CASE c_custkey % 6 WHEN 0 THEN '11.12.' || (c_custkey % 256) || '.1' WHEN 1 THEN '11.' || (c_custkey % 256) || '.0.0/16' WHEN 2 THEN '11.12.13.128/25' WHEN 3 THEN '2001:db8::' || (c_custkey % 9 + 1) WHEN 4 THEN '2001:db8::/32' END AS value,
  CASE c_custkey % 6 WHEN 1 THEN 16 WHEN 2 THEN 25 WHEN 4 THEN 32 END AS prefix FROM customer) WHERE value IS NOT NULL""")
def canonical_networks(t: Tables) -> DataFrame:
    raw = _texts(t, """SELECT c_custkey AS k, CASE c_custkey % 6 WHEN 0 THEN ' 11.12.' || (c_custkey % 256) || '.1 ' WHEN 1 THEN '11.' || (c_custkey % 256) || '.77.88/16' WHEN 2 THEN '11.12.13.' || (128 + c_custkey % 100) || '/25' WHEN 3 THEN '2001:0DB8:0:0::000' || (c_custkey % 9 + 1)
      WHEN 4 THEN '2001:db8:' || (c_custkey % 9) || '::/32' ELSE CASE c_custkey % 4 WHEN 0 THEN '0.0.0.0/0' WHEN 1 THEN '01.2.3.4' WHEN 2 THEN '::/0' ELSE '1.2.3.4/33' END END AS raw FROM {customer}""")
    return with_network(raw, "raw", "n").where("n is not null").select("k", "n.kind", "n.value", "n.prefix")


@query("", """WITH r AS (SELECT event_id AS id, CASE event_id % 4 WHEN 0 THEN 'domain' WHEN 1 THEN 'url' WHEN 2 THEN 'ip' END AS kind, CASE event_id % 4 WHEN 0 THEN 'u' || (event_id % 5000) || '.tr' WHEN 1 THEN 'http://v' || (event_id % 6000) || '.tr/a' ELSE '8.8.' || (event_id % 200) || '.8' END AS v FROM events WHERE event_id % 4 <> 3),
  n AS (SELECT * FROM r WHERE (kind = 'ip' OR id > CASE kind WHEN 'domain' THEN 300 ELSE 500 END) AND v NOT IN (SELECT v FROM r WHERE id <= 100)) SELECT kind AS observable_type, count(*) AS new_rows, max(id) AS new_cursor FROM n GROUP BY kind""")
def paged_service_run(t: Tables) -> DataFrame:
    """What a run takes in after the cursors of each type, without contents that are stored."""
    raw = t.events.select(F.col("event_id").alias("id"), F.expr("CASE event_id % 4 WHEN 0 THEN 'Domain' WHEN 1 THEN 'url' WHEN 2 THEN 'ip' ELSE 'other' END").alias("type"), F.expr("CASE event_id % 4 WHEN 0 THEN 'U' || (event_id % 5000) || '.tr' WHEN 1 THEN 'v' || (event_id % 6000) || '.tr/a' ELSE '8.8.' || (event_id % 200) || '.8' END").alias("url"), F.col("ts").alias("date"))
    rows = records.usom(raw)
    state = _cases(t, [("domain", 300), ("url", 500)], "observable_type string, cursor long")
    new, _ = records.advanced(rows, state, rows.where("id <= 100"))
    return new.groupBy("observable_type").agg(F.count("*").alias("new_rows"), F.max("id").alias("new_cursor"))


@query("", """WITH r AS (SELECT event_id AS id, 'u' || (event_id % 500) || '.tr' AS v FROM events WHERE event_id % 4 = 0), a AS (SELECT DISTINCT v FROM r WHERE id < 150), b AS (SELECT DISTINCT v FROM r WHERE id BETWEEN 100 AND 200)
  SELECT change, count(*) AS n FROM (SELECT 'enters' AS change, v FROM b WHERE v NOT IN (SELECT v FROM a) UNION ALL SELECT 'leaves', v FROM a WHERE v NOT IN (SELECT v FROM b)) GROUP BY change""")
def paged_service_snapshot(t: Tables) -> DataFrame:
    rows = records.usom(t.events.where("event_id % 4 = 0").select(F.col("event_id").alias("id"), F.lit("domain").alias("type"), F.expr("'U' || (event_id % 500) || '.tr'").alias("url"), F.col("ts").alias("date")))
    return records.snapshot_changes(rows.where("id < 150"), rows.where("id between 100 and 200")).groupBy("change").agg(F.count("*").alias("n"))


FILES = """SELECT c_custkey AS k, CASE c_custkey % 8 WHEN 0 THEN 'name,"IOC",x' || chr(10) || '"a,b",Csv' || c_custkey || '.com,1' || chr(10) || 'c,"csv2-' || c_custkey || '.com",2' WHEN 1 THEN '{{"ioc": "Nd' || c_custkey || '.com"}}' || chr(10) || '{{"value": "", "indicator": "1.1.1.' || (c_custkey % 256) || '"}}'
  WHEN 2 THEN '[{{"indicator": "js' || c_custkey || '.com"}}, {{"other": 1}}]' WHEN 3 THEN '{{"data": [{{"value": "http://Obj' || c_custkey || '.com"}}]}}' WHEN 4 THEN '{{"type": "bundle", "objects": []}}' WHEN 5 THEN '# Title' || chr(10) || 'text' WHEN 6 THEN '<a/>' ELSE 'plain, text' END AS text FROM {customer}"""


@query("", "SELECT c_custkey AS k, CASE c_custkey % 8 WHEN 0 THEN 'csv' WHEN 1 THEN 'ndjson' WHEN 2 THEN 'json' WHEN 3 THEN 'json' WHEN 4 THEN 'stix' WHEN 5 THEN 'md' WHEN 6 THEN 'xml' ELSE 'text' END AS format FROM customer")
def linked_file_formats(t: Tables) -> DataFrame:
    return _texts(t, FILES).select("k", records.sniffed("text").alias("format"))


@query("", """SELECT c_custkey AS id, 'domain' AS observable_type, 'csv' || c_custkey || '.com' AS observable FROM customer WHERE c_custkey % 8 = 0 UNION ALL SELECT c_custkey, 'domain', 'csv2-' || c_custkey || '.com' FROM customer WHERE c_custkey % 8 = 0
  UNION ALL SELECT c_custkey, 'domain', 'nd' || c_custkey || '.com' FROM customer WHERE c_custkey % 8 = 1 UNION ALL SELECT c_custkey, 'ip', '1.1.1.' || (c_custkey % 256) FROM customer WHERE c_custkey % 8 = 1
  UNION ALL SELECT c_custkey, 'domain', 'js' || c_custkey || '.com' FROM customer WHERE c_custkey % 8 = 2 UNION ALL SELECT c_custkey, 'url', 'http://obj' || c_custkey || '.com/' FROM customer WHERE c_custkey % 8 = 3""")
def linked_file_records(t: Tables) -> DataFrame:
    return records.structured_records(_texts(t, FILES), "k", "text").select("id", "observable_type", "observable")


@query("", """SELECT c_custkey AS id, 'ip' AS observable_type, '4.3.2.' || (c_custkey % 256) AS observable FROM customer WHERE c_custkey % 2 = 0 UNION ALL SELECT c_custkey, 'ip', '4.3.3.' || (c_custkey % 256) FROM customer WHERE c_custkey % 2 = 0
  UNION ALL SELECT c_custkey, 'md5', md5('x' || c_custkey) FROM customer WHERE c_custkey % 2 = 0 UNION ALL SELECT c_custkey, 'domain', 'cy' || c_custkey || '.com' FROM customer WHERE c_custkey % 2 = 0""")
def cybox_documents(t: Tables) -> DataFrame:
    """Values of observables in XML."""
    xml = """SELECT c_custkey AS k, CASE WHEN c_custkey % 2 = 0 THEN '<s:Package xmlns:s="s" xmlns:a="a" xmlns:d="d"><a:Address_Value condition="Equals">4.3.2.' || (c_custkey % 256) || '##comma##4.3.3.' || (c_custkey % 256) || '</a:Address_Value><d:Value>Cy' || c_custkey || '.com</d:Value><d:Simple_Hash_Value>' || upper(md5('x' || c_custkey)) || '</d:Simple_Hash_Value><d:Title>no</d:Title></s:Package>' ELSE 'no xml' END AS text FROM {customer}"""
    return records.cybox_values(_texts(t, xml), "k", "text").select("id", "observable_type", "observable")


@query("items", """SELECT ioc_source_id AS source, id, observable, observable_type FROM items WHERE ioc_source_id IS NOT NULL AND ioc_source_id <> 2""")
def bundle_round_trip(t: Tables) -> DataFrame:
    """Rows that were written to bundles and read again; one bundle was changed on the way and gives none."""
    rows = t.items.where("ioc_source_id is not null").select(F.col("ioc_source_id").alias("source"), "id", "observable", "observable_type")
    made = records.bundles(rows, "source", ["id", "observable", "observable_type"])
    made = made.withColumn("body", F.when(F.col("source") == 2, F.replace("body", F.lit("domain"), F.lit("Domain"))).otherwise(F.col("body")))
    return records.unbundled(made, "source", "id long, observable string, observable_type string")


@query("items", """WITH v AS (SELECT c_custkey AS place, CASE c_custkey % 4 WHEN 0 THEN 'HOST' || (c_custkey * 5 + 1) || '.zone' || ((c_custkey * 5 + 1) % 97) || '.com' WHEN 1 THEN 'new' || (c_custkey % 20) || '.com' WHEN 2 THEN 'not a value' ELSE '6.6.6.' || (c_custkey % 100) END AS raw FROM customer),
  n AS (SELECT *, CASE place % 4 WHEN 2 THEN NULL ELSE lower(raw) END AS v, CASE place % 4 WHEN 3 THEN 'ip' WHEN 2 THEN NULL ELSE 'domain' END AS kind FROM v), f AS (SELECT v, kind, min(place) AS first FROM n WHERE v IS NOT NULL GROUP BY ALL), known AS (SELECT DISTINCT observable_type, lower(observable) AS v FROM items)
  SELECT n.place, n.kind AS observable_type, n.v AS observable, CASE WHEN n.v IS NULL THEN 'invalid' WHEN k.v IS NOT NULL THEN 'exists' WHEN n.place > f.first THEN 'repeated' ELSE 'created' END AS outcome FROM n LEFT JOIN f ON f.v = n.v AND f.kind = n.kind LEFT JOIN known k ON k.v = n.v AND k.observable_type = n.kind""")
def rows_by_hand(t: Tables) -> DataFrame:
    given = _texts(t, "SELECT c_custkey AS place, CASE c_custkey % 4 WHEN 0 THEN 'HOST' || (c_custkey * 5 + 1) || '.zone' || ((c_custkey * 5 + 1) % 97) || '.com' WHEN 1 THEN 'new' || (c_custkey % 20) || '.com' WHEN 2 THEN 'not a value' ELSE '6.6.6.' || (c_custkey % 100) END AS raw FROM {customer}")
    return records.created_by_hand(given, t.items).drop("raw")


STIX = """SELECT c_custkey AS k, '{{"type":"bundle","objects":[{{"type":"indicator","id":"i' || c_custkey || '","pattern":"[domain-name:value = \\'S' || c_custkey || '.com\\']","pattern_type":"stix","revoked":' || CASE WHEN c_custkey % 3 = 0 THEN 'true' ELSE 'false' END || '}},{{"type":"ipv4-addr","id":"a' || c_custkey || '","value":"2.2.2.' || (c_custkey % 256) || '"}},{{"type":"file","id":"f' || c_custkey || '","hashes":{{"MD5":"' || upper(md5('z' || c_custkey)) || '","SSDEEP":"3:x"}}}}]}}' AS value FROM {customer}"""


@query("", "SELECT 'i' || c_custkey AS id, 'domain' AS observable_type, 's' || c_custkey || '.com' AS observable FROM customer WHERE c_custkey % 3 <> 0 UNION ALL SELECT 'a' || c_custkey, 'ip', '2.2.2.' || (c_custkey % 256) FROM customer UNION ALL SELECT 'f' || c_custkey, 'md5', md5('z' || c_custkey) FROM customer")
def stix_bundles(t: Tables) -> DataFrame:
    return exchange.stix_bundles(_texts(t, STIX))


# ---- what is published ---------------------------------------------------------------------------------------------
@query("items", f"""WITH {WIDE_ROWS}, {LINED}, h AS (SELECT line, sha1(unhex('{publish.STIX_NAMESPACE.replace("-", "")}') || ('indicator:' || observable_type || ':' || lower(line))::BLOB) AS h FROM picked WHERE pick = 1 AND last_seen_at IS NOT NULL)
  SELECT line, 'indicator--' || substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || substr('89ab', (('0x' || substr(h, 17, 1))::INT & 3) + 1, 1) || substr(h, 18, 3) || '-' || substr(h, 21, 12) AS stix_id FROM h""")
def published_stix_ids(t: Tables) -> DataFrame:
    return publish.stix_objects(publish.selected(publish.eligible(t, WIDE, NOW))).select("line", "stix_id")


@query("items", f"""WITH {WIDE_ROWS}, {LINED}, o AS (SELECT line AS stix_id, created_at AS added FROM picked WHERE pick = 1 AND observable_type = 'url') SELECT stix_id, added FROM o ORDER BY added, stix_id LIMIT 20 OFFSET 20""")
def taxii_second_page(t: Tables) -> DataFrame:
    """The page after the first one's cursor."""
    rows = publish.selected(publish.eligible(t, WIDE, NOW)).where("observable_type = 'url'").select(F.col("line").alias("stix_id"), F.col("created_at").alias("added"))
    _, cursor = exchange.taxii_page(rows, 20)
    return exchange.taxii_page(rows, 20, cursor)[0]


@query(SEARCH_VIEWS, f"""WITH {WIDE_ROWS}, {PROJECTED} SELECT identity_key, substr(sha256('{{"observable":"' || observable || '","observable_type":"' || observable_type || '","score":' || score || ',"recency":"' || strftime(recency, '%Y-%m-%dT%H:%M:%S.%g') || '"}}'), 1, 32) AS fingerprint FROM best WHERE pick = 1""")
def content_fingerprints(t: Tables) -> DataFrame:
    return publish.projection(t, WIDE, NOW).select("identity_key", "fingerprint")


@query("", "SELECT event_id, strftime(ts + INTERVAL 330 MINUTE, '%Y-%m-%dT%H:%M:%S') || '+05:30' AS local, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS utc FROM events")
def csv_timestamps(t: Tables) -> DataFrame:
    return t.events.select("event_id", text.csv_time("ts", "Asia/Kolkata").alias("local"), text.csv_time("ts").alias("utc"))


@query("", """SELECT event_id || ',' || CASE WHEN event_type = 'error' THEN '''=error' ELSE event_type END || ',"' || replace(props, '"', '""') || '"' AS line FROM (SELECT * FROM events WHERE ts >= TIMESTAMP '2024-01-10 00:00:00' AND ts < TIMESTAMP '2024-01-20 00:00:00' AND lower(event_type) LIKE '%err%' ORDER BY ts DESC, event_id DESC LIMIT 10000)""")
def audit_csv(t: Tables) -> DataFrame:
    """Lines of an audit file; a word that a spreadsheet would run is defused."""
    found = reports.audit(t.events, "2024-01-10", "2024-01-20", ("event_type", "err")).select("event_id").join(t.events, "event_id")
    kind = F.when(F.col("event_type") == "error", F.concat(F.lit("="), "event_type")).otherwise(F.col("event_type"))
    return found.select(F.concat_ws(",", text.csv_cell("event_id"), text.csv_cell(kind), text.csv_cell("props")).alias("line"))


# ---- language ------------------------------------------------------------------------------------------------------
@query("", """SELECT * FROM (VALUES ('IOC  contains "x"   and TAG in ("a","b")', 'ioc contains "x" AND tag in ("a", "b")', 2, false),
  ('not (ioc equals "a" OR ioc equals "b")', 'NOT (ioc equals "a" OR ioc equals "b")', 2, false), ('created_at between "2020-01-01" and "2020-02-01"', 'created_at between "2020-01-01" AND "2020-02-01"', 1, false),
  ('last_seen after "now-7d" OR (tag equals "a" AND tag equals "b")', 'last_seen after "now-7d" OR tag equals "a" AND tag equals "b"', 3, true)) v(query, rendered, n_conditions, relative)""")
def rendered_queries(t: Tables) -> DataFrame:
    """Queries as they are written back: normalised, flattened, and whether they move with the clock."""
    given = ('IOC  contains "x"   and TAG in ("a","b")', 'not (ioc equals "a" OR ioc equals "b")', 'created_at between "2020-01-01" and "2020-02-01"', 'last_seen after "now-7d" OR (tag equals "a" AND tag equals "b")')
    rows = [(q, language.render(language.parse(q)), len(language.conditions(language.parse(q))), language.has_relative_date(q)) for q in given]
    return _cases(t, rows, "query string, rendered string, n_conditions int, relative boolean")


@query("", """SELECT * FROM (VALUES ('2001:DB8:0:0::1', '2001:db8::1'), ('::FFFF', '::ffff'), ('Evil.com', 'evil.com'), ('1.2.3.4', '1.2.3.4')) v(literal, canonical)""")
def canonical_literals(t: Tables) -> DataFrame:
    return _cases(t, [(x, language.canonical_ioc(x)) for x in ("2001:DB8:0:0::1", "::FFFF", "Evil.com", "1.2.3.4")], "literal string, canonical string")


@query("", """SELECT * FROM (VALUES ('', 'empty_query', 0), ('ioc contains "a', 'unclosed_quote', 13), ('foo equals "a"', 'unknown_field', 0), ('ioc', 'expected_operator', 3), ('md5 contains "a"', 'unsupported_operator', 4), ('ioc contains " %_* "', 'empty_value', 13),
  ('type equals "imphash"', 'invalid_enum_value', 12), ('md5 equals "abc"', 'invalid_hash_value', 11), ('ssdeep equals "abc"', 'invalid_attr_value', 14), ('tag in ()', 'empty_list', 8), ('created_at after "2024-02-30"', 'invalid_date', 17), ('(ioc contains "a"', 'unclosed_parenthesis', 17)) v(query, code, position)""")
def query_errors(t: Tables) -> DataFrame:
    """What is wrong with queries, and where."""
    given = ("", 'ioc contains "a', 'foo equals "a"', "ioc", 'md5 contains "a"', 'ioc contains " %_* "', 'type equals "imphash"', 'md5 equals "abc"', 'ssdeep equals "abc"', "tag in ()", 'created_at after "2024-02-30"', '(ioc contains "a"')
    rows = []
    for q in given:
        try:
            language.parse(q)
        except language.QueryError as e:
            rows.append((q, e.code, e.position))
    return _cases(t, rows, "query string, code string, position int")


@query("", """SELECT * FROM (VALUES ('30 conditions', 'ok'), ('31 conditions', 'max_conditions_exceeded'), ('100 items', 'ok'), ('101 items', 'max_in_items_exceeded'), ('depth 8', 'ok'), ('depth 9', 'max_depth_exceeded'), ('4001 characters', 'max_length_exceeded')) v(name, said)""")
def query_limits(t: Tables) -> DataFrame:
    many = lambda n: " and ".join(['ioc contains "abc"'] * n)
    listed = lambda n: "tag in (" + ", ".join(['"a"'] * n) + ")"
    deep = lambda n: "(" * n + 'ioc contains "abc"' + ")" * n
    given = {"30 conditions": many(30), "31 conditions": many(31), "100 items": listed(100), "101 items": listed(101), "depth 8": deep(8), "depth 9": deep(9), "4001 characters": "x" * 4001}
    rows = []
    for name, q in given.items():
        try:
            language.parse(q)
            rows.append((name, "ok"))
        except language.QueryError as e:
            rows.append((name, e.code))
    return _cases(t, rows, "name string, said string")


@query("", """SELECT * FROM (VALUES ('ioc equals "a"', 'interactive', NULL), ('ioc contains "ab"', 'deep_search', 'leading_wildcard'), ('ioc not_equals "abc"', 'deep_search', 'negative_predicate'), ('source equals "x"', 'deep_search', 'source_scan'), ('source equals "x" AND ioc equals "a"', 'interactive', NULL),
  ('NOT status equals "active"', 'interactive', NULL), ('classification not_in ("x")', 'deep_search', 'negative_predicate')) v(query, mode, reason)""")
def query_costs(t: Tables) -> DataFrame:
    """Which queries an index could serve, and why others not."""
    given = ('ioc equals "a"', 'ioc contains "ab"', 'ioc not_equals "abc"', 'source equals "x"', 'source equals "x" AND ioc equals "a"', 'NOT status equals "active"', 'classification not_in ("x")')
    costs = [(q, language.cost(language.parse(q))) for q in given]
    return _cases(t, [(q, c.mode, c.reason) for q, c in costs], "query string, mode string, reason string")


# ---- scalar functions ----------------------------------------------------------------------------------------------
@query("", """SELECT c_custkey AS k, CASE c_custkey % 6 WHEN 0 THEN 'http://a' || c_custkey || '.com/' WHEN 1 THEN 'https://a' || c_custkey || '.com/P?q=1' WHEN 2 THEN 'https://u:p@a' || c_custkey || '.com:8443/x' WHEN 3 THEN 'http://a' || c_custkey || '.com/b/c' WHEN 4 THEN 'no url ' || c_custkey ELSE 'http://a' || c_custkey || '.com/?x' END AS url FROM customer""")
def normal_urls(t: Tables) -> DataFrame:
    raw = "SELECT c_custkey AS k, CASE c_custkey % 6 WHEN 0 THEN 'HTTP://A' || c_custkey || '.Com:80' WHEN 1 THEN ' https://a' || c_custkey || '.COM:443/P?q=1#f' WHEN 2 THEN 'https://u:p@A' || c_custkey || '.com:8443/x' WHEN 3 THEN 'http://a' || c_custkey || '.com/a/../b/./c' WHEN 4 THEN 'no url ' || c_custkey ELSE 'http://a' || c_custkey || '.com?x' END AS v FROM {customer}"
    return _texts(t, raw).select("k", text.normal_url("v").alias("url"))


@query("", """SELECT c_custkey AS k, CASE c_custkey % 8 WHEN 0 THEN 'user.' || c_custkey || '@mail' || c_custkey || '.com' WHEN 1 THEN 'x' || c_custkey || '@evil.org' WHEN 2 THEN 'q' || c_custkey || '@evil.com' END AS mail FROM customer""")
def normal_mails(t: Tables) -> DataFrame:
    raw = "SELECT c_custkey AS k, CASE c_custkey % 8 WHEN 0 THEN 'mailto:User.' || c_custkey || '@Mail' || c_custkey || '.com' WHEN 1 THEN 'x' || c_custkey || ' [at] evil[.]org' WHEN 2 THEN '<q' || c_custkey || '@evil.com.>' WHEN 3 THEN 'a' || c_custkey || '@x.example' WHEN 4 THEN 'a..b' || c_custkey || '@evil.com' WHEN 5 THEN 'a' || c_custkey || '@-evil.com' WHEN 6 THEN 'a@b@evil.com' ELSE 'j***@evil.com' END AS v FROM {customer}"
    return _texts(t, raw).select("k", text.normal_email("v").alias("mail"))


@query("", """SELECT c_custkey AS k, CASE c_custkey % 5 WHEN 0 THEN 'https://evil' || c_custkey || '.com/a' WHEN 1 THEN 'http://evil' || c_custkey || '.com' WHEN 2 THEN 'see evil' || c_custkey || '.com and 1.2.3.4' WHEN 3 THEN 'host:80' ELSE 'plain (text) ' || c_custkey END AS refanged, c_custkey % 5 <> 4 AS defanged FROM customer""")
def refanged_texts(t: Tables) -> DataFrame:
    raw = "SELECT c_custkey AS k, CASE c_custkey % 5 WHEN 0 THEN 'hxxps://evil' || c_custkey || '[.]com/a' WHEN 1 THEN 'hxxp[://]evil' || c_custkey || '(dot)com' WHEN 2 THEN 'see evil' || c_custkey || ' [.] com and 1.2[.]3.4' WHEN 3 THEN 'host[:]80' ELSE 'plain (text) ' || c_custkey END AS v FROM {customer}"
    return _texts(t, raw).select("k", text.refanged("v").alias("refanged"), text.looks_defanged("v").alias("defanged"))


@query("", """SELECT c_custkey AS k, CASE c_custkey % 10 WHEN 0 THEN 'cve' WHEN 1 THEN 'email' WHEN 2 THEN 'technique' WHEN 3 THEN 'cidr' WHEN 4 THEN 'ip' WHEN 5 THEN 'url' WHEN 6 THEN 'md5' WHEN 7 THEN 'domain' END AS type, CASE c_custkey % 10 WHEN 0 THEN 'CVE-2024-' || (1000 + c_custkey) WHEN 1 THEN 'a' || c_custkey || '@evil.com' WHEN 2 THEN 'T1059.001' WHEN 3 THEN '10.1.0.0/16' WHEN 4 THEN '1.2.3.' || (c_custkey % 256)
  WHEN 5 THEN 'http://e' || c_custkey || '.com' WHEN 6 THEN md5('c' || c_custkey) WHEN 7 THEN 'evil' || c_custkey || '.com' END AS value, CASE c_custkey % 10 WHEN 8 THEN 'invalid_ip' WHEN 9 THEN 'no_alphanumeric' END AS error FROM customer""")
def candidate_values(t: Tables) -> DataFrame:
    raw = "SELECT c_custkey AS k, CASE c_custkey % 10 WHEN 0 THEN 'cve-2024-' || (1000 + c_custkey) WHEN 1 THEN 'A' || c_custkey || '@Evil.com' WHEN 2 THEN 'T1059.001' WHEN 3 THEN '10.1.0.0/16' WHEN 4 THEN '1.2[.]3.' || (c_custkey % 256) WHEN 5 THEN 'hxxp://e' || c_custkey || '.com' WHEN 6 THEN upper(md5('c' || c_custkey)) WHEN 7 THEN 'Evil' || c_custkey || '[.]com' WHEN 8 THEN '300.2.3.4' ELSE '--' END AS v FROM {customer}"
    return _texts(t, raw).select("k", extract.candidate_value("v").alias("c")).select("k", "c.type", "c.value", "c.error")


@query("", """WITH f AS (SELECT c_custkey AS k, c_custkey % 31 = 0 AS excluded, c_custkey % 7 = 0 AS asserted, c_custkey % 11 = 0 AS stance, c_custkey % 13 = 0 AS silent, c_custkey % 3 = 0 AS curated, c_custkey % 5 = 0 AS structured, c_custkey % 4 = 0 AS operational, c_custkey % 2 = 0 AS sample, c_custkey % 17 = 0 AS warns, c_custkey % 19 = 0 AS narrative FROM customer)
  SELECT k, CASE WHEN excluded THEN 'R01_not_an_ioc_observable' WHEN asserted THEN 'R10_publisher_assertion' WHEN stance THEN 'R20_publisher_stance' WHEN silent THEN 'R21_non_asserting_section'
    WHEN NOT curated THEN CASE WHEN structured THEN 'R30_structured_inventory' WHEN sample AND NOT operational THEN 'R34_sample_hash' WHEN warns THEN 'R32_grounded_model_assessment' WHEN operational THEN 'R31_operational_statement' ELSE 'R33_mention_needs_review' END
    WHEN structured THEN 'R40_structured_rows_uncertain_section' WHEN operational THEN 'R41_operational_statement' WHEN sample THEN 'R43_undecided_sample_hash' WHEN narrative THEN 'R44_unresolved_section_narrative' ELSE 'R50_passing_mention' END AS rule FROM f""")
def membership_rules(t: Tables) -> DataFrame:
    k = F.col("c_custkey")
    flags = {"excluded": 31, "explicit": 7, "stance_blocked": 11, "curated": 3, "structured": 5, "operational": 4, "sample_hash": 2, "narrative": 19}
    rows = t.customer.select(k.alias("k"), *((k % n == 0).alias(name) for name, n in flags.items()), F.when(k % 17 == 0, "malicious").alias("model"), F.lit(None).cast("boolean").alias("model_supported"), F.lit(None).cast("boolean").alias("model_applied"), F.when(k % 13 == 0, F.array(F.lit("non_asserting"))).otherwise(F.array(F.lit("asserting"), F.lit("non_asserting"))).alias("sections"))
    return rows.select("k", extract.membership_rule()["rule"].alias("rule"))


@query("", "SELECT c_custkey % 10 AS doc, CASE c_custkey % 3 WHEN 0 THEN 'PAGE of report DATE' WHEN 1 THEN 'see URL' ELSE 'heading ' || (c_custkey % 5) END AS key, count(DISTINCT c_custkey) AS pages FROM customer GROUP BY ALL HAVING count(DISTINCT c_custkey) >= 2")
def repeated_headers(t: Tables) -> DataFrame:
    """Headers and footers of documents, whatever page, date or link they name."""
    raw = "SELECT c_custkey % 10 AS doc, c_custkey AS page, CASE c_custkey % 3 WHEN 0 THEN 'Page ' || c_custkey || ' of Report 2024-01-' || (10 + c_custkey % 10) WHEN 1 THEN (c_custkey % 100) || ' See https://x.org/' || c_custkey ELSE 'Heading ' || (c_custkey % 5) END AS text FROM {customer}"
    return extract.repeated_blocks(_texts(t, raw), "doc", "page")


@query("", """SELECT * FROM (VALUES ('new', 'bootstrap'), ('idle', 'noop'), ('moved', 'incremental'), ('window', 'incremental'), ('tags', 'full'), ('many', 'full')) v(name, mode)""")
def refresh_modes(t: Tables) -> DataFrame:
    given = {"new": (None, True, True, False, 5), "idle": ("ready", False, False, False, 0), "moved": ("ready", True, False, False, 0), "window": ("ready", False, True, False, 0), "tags": ("ready", True, False, True, 1), "many": ("ready", False, False, False, 100_001)}
    return _cases(t, [(n, publish.refresh_mode(*g)) for n, g in given.items()], "name string, mode string")


@query("", "SELECT event_id FROM events WHERE ts >= TIMESTAMP '2024-01-20 00:00:00'")
def retained_events(t: Tables) -> DataFrame:
    return reports.retained(t.events, "ts", language.utc("2024-01-30 00:00:00").replace(tzinfo=None), 10).select("event_id")


@query("candidates", """WITH f AS (SELECT DISTINCT report_id, id FROM candidates WHERE id % 4 <> 0), e AS (SELECT DISTINCT report_id, id FROM candidates WHERE id % 5 <> 0)
  SELECT tp, fp, fn, tp * 1.0::DOUBLE / nullif(tp + fp, 0) AS precision, tp * 1.0::DOUBLE / nullif(tp + fn, 0) AS recall FROM (SELECT (SELECT count(*) FROM f JOIN e USING (report_id, id)) AS tp, (SELECT count(*) FROM f ANTI JOIN e USING (report_id, id)) AS fp, (SELECT count(*) FROM e ANTI JOIN f USING (report_id, id)) AS fn)""")
def extraction_scores(t: Tables) -> DataFrame:
    rows = t.candidates.select("report_id", "id")
    return extract.scored(rows.where("id % 4 <> 0"), rows.where("id % 5 <> 0"), ["report_id", "id"])


@query("items", "SELECT observable_type, id FROM items WHERE coalesce(last_seen_log, last_seen_at, created_at) >= $NOW - INTERVAL '30' DAY")
def recent_rows(t: Tables) -> DataFrame:
    return t.items.where(publish.recency() >= F.lit(NOW - timedelta(days=30)).cast("timestamp_ntz")).select(*KEY)
