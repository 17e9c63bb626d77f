"""Jobs and exchange formats on small inputs."""

from datetime import datetime

import duckdb
from pyspark.sql import functions as F

from tamarack.operators import jobs
from tamarack.plans import registry
from tamarack.sources import exchange


def test_artifacts_that_share_a_hash(spark, tmp_path):
    spark.sparkContext.setCheckpointDir(str(tmp_path))
    rows = [("a", "md5", "1"), ("b", "md5", "1"), ("b", "sha1", "2"), ("c", "sha1", "2"), ("d", "md5", "2"), ("e", "sha256", "AA"), ("f", "sha256", "aa"), ("f", "sha256", "bb")]
    df = spark.createDataFrame(rows, "artifact_id string, hash_type string, hash_value string")
    assert {r.artifact_id: r.merged_into for r in jobs.merged_artifacts(df).collect()} == {"a": None, "b": "a", "c": "a", "d": None, "e": None, "f": "e"}
    best = {r.artifact_id: (r.hash_type, r.hash_value, r.conflict) for r in jobs.primary_hashes(df).collect()}
    assert best["b"] == ("sha1", "2", False) and best["f"] == ("sha256", "aa", True)


def test_patterns(spark):
    given = {
        1: "[domain-name:value = 'Evil.com' OR url:value = 'HTTP://A.b/x']",
        2: "[file:hashes.'SHA-256' = '%s' AND file:hashes.MD5 = '%s']" % ("A" * 64, "b" * 32),
        3: "[ipv4-addr:value IN ('1.2.3.4', '5.6.7.8')]",
        4: "[domain-name:value LIKE 'x%']",
        5: "[domain-name:value = 'a.b'] FOLLOWEDBY [url:value = 'http://c.d/']",
        6: r"[url:value = 'http://x/\'q']",
        7: None,
    }
    df = spark.createDataFrame(list(given.items()), "id int, pattern string")
    got = {(r.id, r.observable_type, r.observable) for r in exchange.pattern_indicators(df, "id").collect()}
    assert got == {(1, "domain", "evil.com"), (1, "url", "http://a.b/x"), (2, "sha256", "a" * 64), (2, "md5", "b" * 32), (3, "ip", "1.2.3.4"), (3, "ip", "5.6.7.8"), (6, "url", "http://x/'q")}


def test_bundles_and_lists(spark):
    body = '{"type":"bundle","objects":[{"type":"indicator","id":"i1","pattern":"[url:value = \'http://a/\']","pattern_type":"stix"},{"type":"indicator","id":"i2","pattern":"[url:value = \'http://b/\']","revoked":true},{"type":"ipv4-addr","id":"o1","value":"1.2.3.4"},{"type":"file","id":"f1","hashes":{"MD5":"%s","x":"y"}}]}' % ("c" * 32)
    texts = spark.createDataFrame([(body,), ("not json",), (None,)], "value string")
    assert {(r.id, r.observable_type, r.observable) for r in exchange.stix_bundles(texts).collect()} == {("i1", "url", "http://a/"), ("o1", "ip", "1.2.3.4"), ("f1", "md5", "c" * 32)}
    drop = spark.createDataFrame([('{"cidr":"1.2.3.4/24","sblid":"x"}',), ('{"type":"metadata"}',)], "value string")
    assert [tuple(r) for r in exchange.drop_list(drop).collect()] == [(0x01020300, 0x010203FF, 24)]
    block = spark.createDataFrame([("# x",), ("1.2.3.4",), ("10.0.0.0/8",), ("evil.com",)], "value string")
    assert {r.observable for r in exchange.block_list(block).collect()} == {"1.2.3.4", "10.0.0.0/8"}
    tank = spark.createDataFrame([("1", "HTTP://A.b", "yes", "yes", "t"), ("2", "http://c", "no", "yes", "t")], "phish_id string, url string, verified string, online string, submission_time string")
    assert [r.observable for r in exchange.phishtank(tank).collect()] == ["http://a.b/"]


def test_pages_and_signatures(spark):
    objects = spark.createDataFrame([(datetime(2024, 1, 1 + i // 3), f"indicator--{i}") for i in range(7)], "added timestamp_ntz, stix_id string")
    seen, cursor = [], None
    while True:
        page, cursor = exchange.taxii_page(objects, 3, cursor)
        seen += [r.stix_id for r in page.collect()]
        if cursor is None:
            break
    assert seen == [f"indicator--{i}" for i in range(7)]
    rows = exchange.signed(spark.createDataFrame([("a",), ("b",)], "body string"))
    assert exchange.verified(rows).count() == 2
    assert exchange.verified(rows.withColumn("body", F.concat("body", F.lit("x")))).count() == 0


def test_report_keys(spark):
    urls = ["https://www.Site.org/A/?utm_source=x", "http://site.org/A#top", "HTTPS://SITE.org/A?utm_medium=y&b=1", "", "https://x.org/?ref=1"]
    df = spark.createDataFrame([(u,) for u in urls], "v string")
    assert [r[0] for r in df.select(jobs.report_key("v")).collect()] == ["site.org/A", "site.org/A", "site.org/A?b=1", "", "x.org"]


def test_percentile(spark):
    df = spark.createDataFrame([(float(x),) for x in (5, 1, 4, 2, 3)] + [(None,)], "v double")
    assert [jobs.percentile(df, "v", p).first()[0] for p in (0.01, 0.5, 0.95)] == [1, 3, 5]


def test_latest_run(spark):
    runs = spark.createDataFrame([("f", 1, "x"), ("f", None, "y"), ("f", 3, "z"), ("g", None, "w")], "feed string, at int, state string")
    assert {r.feed: r.state for r in jobs.latest_run(runs, "feed", "at").collect()} == {"f": "z", "g": "w"}


def test_drop_list_of_large_keys(spark, tmp_path):
    keys = [1, 222, 223, 65535, 65536, 65537, 89999, 900_000, 2_162_687, 2_162_688, 2_200_000, 16_777_216, 60_000_000]
    spark.createDataFrame([(k,) for k in keys], "c_custkey long").write.parquet(str(tmp_path / "customer.parquet"))
    got = sorted(map(tuple, registry.queries()["drop_list"](spark, str(tmp_path)).collect()))
    db = duckdb.connect()
    db.execute(f"create view customer as select * from '{tmp_path}/customer.parquet/*.parquet'")
    assert got == sorted(db.execute(f"SELECT lo, hi, bits FROM ({registry.oracle_sql()['drop_list']})").fetchall())
