"""The logical tables of the engine, as views over the supplied tables.

Every view is one SELECT that means the same to Spark and to an ANSI engine, so that a query and its check start from
the same rows. ``{name}`` stands for a supplied table or an earlier view.
"""

from __future__ import annotations

import re
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

_KIND = "CASE {k} % 5 WHEN 0 THEN 'ip' WHEN 1 THEN 'domain' WHEN 2 THEN 'url' WHEN 3 THEN 'sha256' ELSE 'md5' END"


def _kind(column: str) -> str:
    return _KIND.replace("{k}", column)


VIEWS = {
    "keyed": "SELECT o.*, CAST(floor(o_orderkey / 10) AS BIGINT) * 5 + o_orderkey % 5 AS g, CAST(floor(o_orderkey / 20) AS BIGINT) AS b FROM {orders} o",
    "items": f"""
        SELECT o_orderkey AS id, 'ioc-' || o_orderkey AS public_id, {_kind("o_orderkey")} AS observable_type,
          CASE o_orderkey % 5
            WHEN 0 THEN (g % 223 + 1) || '.' || (CAST(floor(g / 223) AS BIGINT) % 256) || '.' || (g % 256) || '.' || (g % 251)
            WHEN 1 THEN CASE WHEN o_orderkey % 2 = 0 THEN 'Host' ELSE 'host' END || g || '.Zone' || (g % 97) || '.com'
            WHEN 2 THEN 'http://h' || g || '.example.net/p/' || (g % 1000)
            WHEN 3 THEN md5('s' || g) || md5('t' || g) ELSE md5('m' || g) END AS observable,
          CASE o_orderstatus WHEN 'O' THEN 'active' WHEN 'F' THEN CASE WHEN o_orderkey % 17 = 0 THEN 'suppressed' WHEN o_orderkey % 19 = 0 THEN 'disabled' ELSE 'expired' END END AS status,
          CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'high' WHEN '2' THEN 'High' WHEN '3' THEN 'medium' WHEN '5' THEN 'low' END AS confidence,
          'source ' || (o_custkey % 7) AS source_name, CASE WHEN o_orderkey % 11 = 0 THEN o_custkey % 4 END AS ioc_source_id,
          CASE o_orderkey % 9 WHEN 0 THEN 'False Positive' WHEN 1 THEN 'fp' WHEN 2 THEN 'malware' WHEN 3 THEN 'phishing' END AS category,
          CASE o_orderkey % 6 WHEN 0 THEN 'Malware' WHEN 1 THEN 'c2-server' WHEN 2 THEN 'unknown' WHEN 3 THEN 'Phishing Kit' END AS threat_classification,
          o_orderdate + INTERVAL '1' SECOND * (o_orderkey % 86400) AS created_at,
          CASE WHEN o_orderkey % 4 <> 0 THEN o_orderdate + INTERVAL '10' DAY END AS last_seen_at,
          CASE WHEN o_orderkey % 3 <> 0 THEN o_orderdate + INTERVAL '20' DAY END AS last_seen_log,
          o_orderdate - INTERVAL '2' DAY AS first_seen_at,
          o_orderkey % 23 = 0 AS manual_status_override, CASE WHEN o_orderkey % 46 = 0 THEN 'active' ELSE 'expired' END AS manual_status,
          CASE WHEN o_orderkey % 69 = 0 THEN o_orderdate + INTERVAL '90' DAY END AS manual_expires_at
        FROM {{keyed}}""",
    "memberships": f"""
        SELECT l_orderkey AS id, {_kind("l_orderkey")} AS observable_type, l_suppkey AS feed_id,
          min(l_shipdate) AS first_seen_in_feed, max(l_shipdate) AS last_seen_in_feed,
          max(CASE WHEN l_returnflag = 'R' THEN l_shipdate END) AS last_changed_in_source,
          CASE WHEN max(l_linestatus) = 'O' THEN 'active' ELSE 'expired' END AS status,
          max(CASE l_returnflag WHEN 'A' THEN 'high' WHEN 'R' THEN 'low' END) AS explicit_confidence,
          CASE WHEN l_suppkey % 20 = 0 THEN max(l_shipdate) END AS purged_at, max(l_shipdate) + INTERVAL '30' DAY AS expires_at
        FROM {{lineitem}} GROUP BY l_orderkey, l_suppkey""",
    "feeds": """
        SELECT s_suppkey AS feed_id, 'feed-' || s_suppkey AS feed_key, s_name AS feed_name,
          CASE s_nationkey % 4 WHEN 0 THEN 'critical' WHEN 1 THEN 'medium' WHEN 2 THEN 'low' END AS default_confidence
        FROM {supplier}""",
    "manual_sources": "SELECT c_custkey AS source_id, 'Desk ' || c_custkey AS source_name FROM {customer} WHERE c_custkey < 4",
    "tags": f"""
        SELECT DISTINCT l_orderkey AS id, {_kind("l_orderkey")} AS observable_type, lower(p_brand) AS tag, lower(p_brand) NOT LIKE '%1' AS enabled
        FROM {{lineitem}} JOIN {{part}} ON p_partkey = l_partkey""",
    "report_tags": "SELECT DISTINCT c_custkey AS report_id, lower(c_mktsegment) AS tag FROM {customer}",
    "reports": """
        SELECT c_custkey AS report_id, c_name AS title, lower(c_mktsegment) AS source_type, c_acctbal AS score,
          CASE WHEN c_custkey % 6 <> 5 THEN c_custkey + 1 END AS superseded_by,
          CASE c_nationkey % 3 WHEN 0 THEN 'amber' WHEN 1 THEN 'green' END AS tlp, c_custkey % 31 = 0 AS deleted
        FROM {customer}""",
    "candidates": f"SELECT o_custkey AS report_id, o_orderkey AS id, {_kind('o_orderkey')} AS observable_type FROM {{orders}} WHERE o_orderkey % 3 <> 0",
    "entities": "SELECT n_nationkey AS entity_id, n_name AS entity_name, CASE n_regionkey WHEN 0 THEN 'campaign' WHEN 1 THEN 'tool' WHEN 2 THEN 'malware' ELSE 'threat_actor' END AS entity_type FROM {nation}",
    "relations": "SELECT c_custkey AS report_id, c_nationkey AS entity_id FROM {customer} WHERE c_custkey % 2 = 0",
    "report_names": "SELECT c_custkey AS report_id, substr(md5('r' || c_custkey), 1, 8) || '-' || substr(md5('r' || c_custkey), 9, 4) || '-4' || substr(md5('r' || c_custkey), 14, 3) || '-a' || substr(md5('r' || c_custkey), 18, 3) || '-' || substr(md5('r' || c_custkey), 21, 12) AS report_uuid, c_name AS title FROM {customer}",
    "entity_aliases": "SELECT n_nationkey AS entity_id, 'APT ' || (n_nationkey % 9) AS alias FROM {nation} WHERE n_nationkey % 3 = 0",
    "direct_relations": "SELECT o_orderkey AS id, o_custkey % 25 AS entity_id FROM {orders} WHERE o_orderkey % 37 = 0",
    "actors": f"SELECT DISTINCT l_orderkey AS id, {_kind('l_orderkey')} AS observable_type, CASE WHEN l_linenumber % 2 = 0 THEN 'threat_actor' ELSE 'malware_family' END AS kind, 'Group ' || (l_partkey % 40) AS name FROM {{lineitem}} WHERE l_quantity < 10",
    "attributions": f"""
        SELECT DISTINCT l_orderkey AS id, {_kind("l_orderkey")} AS observable_type, l_suppkey AS feed_id,
          CASE WHEN l_linenumber % 2 = 0 THEN 'threat_actor' ELSE 'malware_family' END AS kind, 'Label  ' || (l_partkey % 60) AS label,
          l_linestatus = 'O' AS direct, CASE WHEN l_tax > 0.06 THEN 'withdrawn' ELSE 'current' END AS assertion
        FROM {{lineitem}} WHERE l_quantity > 40""",
    "links": f"SELECT o_orderkey AS id, {_kind('o_orderkey')} AS observable_type, 'a' || b AS artifact_id FROM {{keyed}} WHERE o_orderkey % 5 >= 3",
    "artifacts": "SELECT DISTINCT 'a' || b AS artifact_id, CASE WHEN b % 6 = 0 THEN 'merged' ELSE 'active' END AS status, CASE WHEN b % 6 = 0 THEN 'a' || (b + 1) END AS merged_into FROM {keyed}",
    "hashes": """
        SELECT DISTINCT 'a' || b AS artifact_id, 'sha256' AS hash_type, md5('s' || (b * 10 + 3)) || md5('t' || (b * 10 + 3)) AS hash_value, b % 4 <> 0 AS is_primary FROM {keyed}
        UNION ALL SELECT DISTINCT 'a' || b, 'md5', md5('m' || (b * 10 + 4)), b % 4 = 0 FROM {keyed}
        UNION ALL SELECT DISTINCT 'a' || b, 'sha1', md5('x' || b) || substr(md5('y' || b), 1, 8), false FROM {keyed}""",
    "file_attributes": "SELECT DISTINCT 'a' || b AS artifact_id, 'imphash' AS attr_type, md5('i' || (b % 50)) AS attr_value FROM {keyed}",
    "classified": f"SELECT DISTINCT l_orderkey AS id, {_kind('l_orderkey')} AS observable_type, CASE l_partkey % 4 WHEN 0 THEN 'malware' WHEN 1 THEN 'botnet' WHEN 2 THEN 'phishing_kit' ELSE 'spam' END AS slug FROM {{lineitem}} WHERE l_linenumber = 1",
    "evidence": f"""
        SELECT DISTINCT l_orderkey AS id, {_kind("l_orderkey")} AS observable_type, l_suppkey AS feed_id, 'source ' || (l_suppkey % 7) AS source_name,
          CASE l_partkey % 5 WHEN 0 THEN 'C2' WHEN 1 THEN 'malware download' END AS category,
          'ref=' || l_partkey || ' | tags=' || CASE l_partkey % 3 WHEN 0 THEN 'Botnet, spam' WHEN 1 THEN 'phishing-kit' ELSE 'other' END AS note
        FROM {{lineitem}} WHERE l_quantity BETWEEN 10 AND 20""",
    "overrides": f"SELECT o_orderkey AS id, {_kind('o_orderkey')} AS observable_type, CASE o_orderkey % 2 WHEN 0 THEN 'malware' ELSE 'c2_server' END AS slug, CASE WHEN o_orderkey % 26 = 0 THEN 'Source 3' END AS source_name FROM {{orders}} WHERE o_orderkey % 13 = 0",
    "suppressions": """
        SELECT lower(observable) AS ioc_value, observable_type AS ioc_type, id % 2 = 0 AS active, CASE WHEN id % 3 = 0 THEN created_at + INTERVAL '400' DAY END AS expires_at,
          CASE WHEN id % 7 = 0 THEN created_at END AS deleted_at FROM {items} WHERE id % 29 = 0""",
}


def _needs(sql: str) -> list[str]:
    return re.findall(r"\{(\w+)\}", sql)


def with_views(*names: str) -> str:
    """WITH clauses for these views and what they need."""
    order: list[str] = []

    def add(name: str) -> None:
        if name in VIEWS and name not in order:
            for n in _needs(VIEWS[name]):
                add(n)
            order.append(name)

    for name in names:
        add(name)
    return ", ".join(f"{n} AS ({re.sub(r'{(\w+)}', r'\1', VIEWS[n])})" for n in order)


class Tables:
    """The supplied tables of a folder and the logical tables over them, by attribute."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        if name in VIEWS:
            found = self.spark.sql(VIEWS[name], **{n: getattr(self, n) for n in set(_needs(VIEWS[name]))})
        else:
            found = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        self.__dict__[name] = found
        return found

    @cached_property
    def key(self) -> list[str]:
        """What identifies an indicator row."""
        return ["observable_type", "id"]
