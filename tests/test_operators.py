"""Operators, functions and sources on small inputs, and every registered query against its SQL."""

import hashlib
import uuid
from datetime import UTC, datetime, timedelta

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from tamarack.functions import extract, network, text
from tamarack.operators import fusion, identity, joins, publish, reports
from tamarack.plans import registry
from tamarack.plans.compile import Compiler
from tamarack.sources import feeds
from tamarack.sources.tables import Tables
from tamarack.streaming import ingest

SMALL = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def sql():
    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"create view {t} as select * from '{SMALL}/{t}.parquet'")
    return db


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_against_sql(spark, sql, name):
    df = registry.queries()[name](spark, SMALL)
    columns = sorted(df.columns)
    want = sql.execute(f"SELECT {', '.join(f'"{c}"' for c in columns)} FROM ({registry.oracle_sql()[name]})").fetchall()
    assert sorted(map(repr, map(tuple, df.select(*columns).collect()))) == sorted(map(repr, want))


def test_entry_points(spark):
    assert __spark_entry__.entry(spark).count() >= 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def one(spark, column, *values, kind="string"):
    df = spark.createDataFrame([(v,) for v in values], f"v {kind}")
    return [r[0] for r in df.select(column).collect()]


def test_urls_and_mail(spark):
    urls = ["HTTP://Example.COM:80", "https://a.b:443/x?q#f", "https://u:p@A.b:8443/P?Q=1", "http://a?x", "no url", " http://a/ "]
    assert one(spark, text.normal_url("v"), *urls) == ["http://example.com/", "https://a.b/x?q", "https://u:p@a.b:8443/P?Q=1", "http://a/?x", "no url", "http://a/"]
    mails = ["mailto:A.b@Mail.Evil.com", "x[at]evil[.]org", "j***@evil.com", "a@b", "a@x.example", "<q@evil.com.>", "a b@evil.com"]
    assert one(spark, text.normal_email("v"), *mails) == ["a.b@mail.evil.com", "x@evil.org", None, None, None, "q@evil.com", None]


def test_refang(spark):
    given = ["hxxps://evil[.]com/a", "hxxp[:]//evil(.)com", "evil{.}com and 1.2[.]3.4", "meow://x", r"evil\[.\]com", "1[:]2", "plain text (x). Next"]
    assert one(spark, text.refanged("v"), *given) == ["https://evil.com/a", "http://evil.com", "evil.com and 1.2.3.4", "http://x", "evil.com", "1:2", "plain text (x). Next"]
    assert one(spark, text.looks_defanged("v"), *given) == [True, True, True, False, True, True, False]


def test_cells_buckets_ids(spark):
    assert one(spark, text.csv_cell("v"), "=1+1", 'a"b', "a,b", "ok", None, "-x\n") == ["'=1+1", '"a""b"', '"a,b"', "ok", "", "\"'-x\n\""]
    want = int.from_bytes(hashlib.sha256(b"o:ip:1").digest()[:4], "big") & 63
    assert one(spark, text.bucket("v", 64), "o:ip:1") == [want]
    assert one(spark, text.uuid5(publish.STIX_NAMESPACE, F.col("v")), "indicator:ip:1.2.3.4") == [str(uuid.uuid5(uuid.UUID(publish.STIX_NAMESPACE), "indicator:ip:1.2.3.4"))]
    assert one(spark, text.hash_type("v"), "a" * 32, "G" * 32, "a" * 40, "A" * 64, "") == ["md5", None, "sha1", "sha256", None]
    assert one(spark, text.note_value("v", "tags"), "a=1 | tags=x, y", "tags=a | tags=b", "none") == ["x, y", "b", None]


def test_networks(spark):
    given = ["1.2.3.4", "10.1.2.3/8", "1.2.3.4/0", "1.2.3.4/33", "01.2.3.4", "256.1.1.1", "2001:DB8::0001", "2001:db8::1/32", "::/0", "x"]
    df = network.with_network(spark.createDataFrame([(i, v) for i, v in enumerate(given)], "i int, v string"), "v").orderBy("i")
    found = [(r.network.kind, r.network.value, r.network.prefix) if r.network else None for r in df.collect()]
    assert found == [("ip", "1.2.3.4", None), ("ip", "10.0.0.0/8", 8), None, None, None, None, ("ipv6", "2001:db8::1", None), ("ipv6", "2001:db8::/32", 32), None, None]
    assert one(spark, network.is_private("v"), "10.0.0.1", "172.32.0.1", "172.16.0.0/12", "224.0.0.1", "8.8.8.8", "::1", "") == [True, False, True, True, False, False, True]


def test_longest_prefix_is_strict(spark):
    nets = feeds.network_list(spark.createDataFrame([("10.0.0.0/8",), ("10.1.0.0/16",), ("10.1.2.3/32",), ("bad",)], "cidr string"))
    points = spark.createDataFrame([(1, 0x0A010203), (2, 0x0A020304), (3, 0x0B000000)], "id int, number long")
    assert sorted(map(tuple, joins.longest_prefix(points, nets).collect())) == [(1, 0x0A010000, 16), (2, 0x0A000000, 8)]


def test_chains_and_components(spark, tmp_path):
    spark.sparkContext.setCheckpointDir(str(tmp_path))
    rows = spark.createDataFrame([(i, i + 1 if i < 9 else None) for i in range(10)], "n int, up int")
    assert {(r.n, r.end, r.steps) for r in joins.chain_ends(rows, "n", "up").collect()} == {(i, 9, 9 - i) for i in range(10)}
    edges = spark.createDataFrame([(i, i + 1) for i in range(20)] + [(30, 31), (32, 31)], "u int, v int")
    assert {(r.node, r.label) for r in joins.graph_components(edges).collect()} == {(i, 0) for i in range(21)} | {(i, 30) for i in (30, 31, 32)}


def test_flags_keep_three_valued_logic(spark):
    t = Tables(spark, SMALL)
    c = Compiler(t, registry.NOW)
    every = t.items.count()
    unknown = t.items.where("confidence is null").count()
    high = c.rows('confidence equals "high"').count()
    assert Compiler(t, registry.NOW).rows('confidence not_equals "high"').count() == every - unknown - high
    text_ = 'tag equals "brand#3"'
    with_, without = (Compiler(t, registry.NOW).rows(q).count() for q in (text_, f"NOT {text_}"))
    either = Compiler(t, registry.NOW).rows(f'{text_} OR ioc equals "no such"').count()
    assert with_ + without == every and either == with_ > 0


def test_search_plan_prunes_and_pushes_down(spark):
    plan = Compiler(Tables(spark, SMALL), registry.NOW).rows('created_at after "1996-01-01"').select("id")._jdf.queryExecution().toString()
    read = plan[plan.rindex("ReadSchema") :]
    assert "o_custkey" not in read.split("\n")[0]


def test_pages_walk_all_rows_once(spark):
    found = Compiler(Tables(spark, SMALL), registry.NOW).search('type equals "ip"').cache()
    seen, cursor = [], None
    while True:
        page = identity.page(found, 70, cursor).collect()
        if not page:
            break
        seen += [r.identity_key for r in page]
        cursor = (page[-1].imported_at, page[-1].id)
    assert len(seen) == len(set(seen)) == found.count()


def test_refresh_equals_full_projection(spark):
    t = Tables(spark, SMALL)
    for part in ("id % 10 = 0", "id % 2 = 0", "false"):
        old = publish.projection(t, registry.WIDE, registry.NOW, t.items.where(f"not ({part})"))
        new = publish.refreshed(old, t, registry.WIDE, registry.NOW, t.items.where(part))
        full = publish.projection(t, registry.WIDE, registry.NOW)
        assert new.exceptAll(full).isEmpty() and full.exceptAll(new).isEmpty()


def test_refresh_mode_and_chunks():
    assert [publish.refresh_mode(*x) for x in ((None, True, False, False, 1), ("ready", False, False, False, 0), ("ready", True, False, False, 5), ("ready", True, False, True, 5), ("ready", True, False, False, 200_000))] == ["bootstrap", "noop", "incremental", "full", "full"]
    assert [publish.chunk_count(n) for n in (0, 320_000, 400_000, 500_000, 10**8)] == [64, 64, 64, 128, 512]


def test_confidence(spark):
    assert one(spark, fusion.confidence_score("v"), "High", "medium", " low", "120", "-3", "33.9", "x", None) == [100, 50, 25, 100, 0, 33, 0, 0]
    assert one(spark, fusion.confidence_word("v"), "Critical", "none", "LOW", None) == ["high", None, "low", None]


def test_feeds(spark, tmp_path):
    lines = spark.createDataFrame([(x,) for x in ("# c", "", "// c", "; c", "Evil.COM", "1.2.3.4", "999.1.1.1", "10.0.0.0/8", "1.2.3.4/0", "http://A.b", "d" * 64, "D" * 33, "a b")], "value string")
    got = {r.raw: (r.observable_type, r.observable, r.error) for r in feeds.text_feed(lines).collect()}
    assert got["Evil.COM"] == ("domain", "evil.com", None) and got["10.0.0.0/8"] == ("ip", "10.0.0.0/8", None) and got["http://A.b"] == ("url", "http://a.b/", None)
    assert got["d" * 64][0] == "sha256" and got["D" * 33][:2] == ("hash", "d" * 33)
    assert got["999.1.1.1"][2] == got["1.2.3.4/0"][2] == got["a b"][2] == "invalid_value" and len(got) == 9
    path = tmp_path / "f.csv"
    path.write_text('# note\nindicator,confidence\n"evil.com",High\n1.2.3.4,low\n')
    assert {(r.observable, r.confidence) for r in feeds.csv_feed(spark, str(path)).collect()} == {("evil.com", "high"), ("1.2.3.4", "low")}
    path.write_text("evil.com,x\n")
    assert [r.observable for r in feeds.csv_feed(spark, str(path)).collect()] == ["evil.com"]
    assert [feeds.detect_format(*x) for x in (("a,b\nc,d", "", ""), ("a\nb,c\nd", "", ""), ("a", "text/csv", ""), ("a,b", "", "x.TXT"), ("# a,b", "", ""))] == ["csv", "txt", "csv", "txt", "txt"]


def test_providers(spark, tmp_path):
    path = tmp_path / "u.csv"
    path.write_text('# x\n"1","2024-01-01","http://A.b/x","online","","","exe,elf","l","r"\n')
    (row,) = feeds.urlhaus(spark, str(path)).collect()
    assert (row.observable, row.threat, row.tags) == ("http://a.b/x", "malware-url", ["elf", "exe", "malware-url"])
    fox = spark.createDataFrame([("1.2.3.4:80", "ip:port", "75"), ("evil.com", "domain", None), ("a" * 32, "md5_hash", "100")], "ioc string, ioc_type string, confidence_level string")
    assert {(r.observable, r.observable_type, r.confidence) for r in feeds.threatfox(fox).collect()} == {("1.2.3.4", "ip", "medium"), ("evil.com", "domain", "medium"), ("a" * 32, "md5", "high")}
    path.write_text('"2024-01-01","%s","%s","","r","f.exe","exe","m","Sig","n/a","","bad","3:Ab:C","T1AA"\n"2024","","x","","","","","","","","","","",""\n' % ("A" * 64, "b" * 32))
    (row,) = feeds.malwarebazaar(spark, str(path)).collect()
    assert (row.sha256, row.md5, row.imphash, row.ssdeep, row.tags) == ("a" * 64, "b" * 32, None, "3:ab:c", ["sig", "exe"])
    pulses = spark.createDataFrame([("p", "c", "m", [("hostname", "Evil.com", None), ("domain", "http://X.y", "i"), ("CVE", "x", None)])], "id string, created string, modified string, indicators array<struct<type:string,indicator:string,created:string>>")
    assert {(r.observable_type, r.observable, r.first_seen) for r in feeds.otx(pulses).collect()} == {("domain", "evil.com", "c"), ("url", "http://x.y", "i")}
    cert = spark.createDataFrame([("A.pl", "2024-02", None, 5), ("a.pl.", "2024-01", "", 9), ("b.pl", "2024", "2024", 1), ("bad", None, None, 2)], "DomainAddress string, InsertDate string, DeleteDate string, RegisterPositionId int")
    assert [(r.observable, r.first_seen, r.position) for r in feeds.certpl(cert).collect()] == [("a.pl", "2024-01", 9)]


def test_extraction(spark):
    page = "<html><body><nav><p>menu</p></nav><h2>Indicators of Compromise</h2><p>See hxxp://evil[.]com/a, 1.2[.]3.4 &amp; <a href='x'>link</a><ul><li>a@evil.com<li>CVE-2024-12345</ul><table><tr><td>md5<td>%s</table></body>" % ("a" * 32)
    blocks = extract.html_blocks(spark.createDataFrame([(1, page), (2, None), (3, "")], "page_id long, html string")).collect()
    assert [(b.position, b.kind, b.level) for b in blocks] == [(0, "heading", 2), (1, "paragraph", 0), (2, "list", 0), (3, "list", 0), (4, "table", 0)]
    assert blocks[1].links == ["x"] and blocks[4].text == "md5 | " + "a" * 32
    texts = spark.createDataFrame([(b.page_id, b.text) for b in blocks], "page_id long, text string")
    got = {(r.type, r.value) for r in extract.observables(texts, "page_id").collect()}
    assert got == {("url", "http://evil.com/a"), ("ip", "1.2.3.4"), ("email", "a@evil.com"), ("cve", "CVE-2024-12345"), ("md5", "a" * 32)}
    assert one(spark, extract.heading_zone("v"), "Indicators of Compromise", "Appendix D - References", "C2", "Nothing", "") == ["explicit_ioc_section", "reference_section", "c2_section", None, None]
    assert one(spark, extract.repeated_key("v"), "Page 3 of report 12/01/2024", "21GopherName: x") == ["PAGE of report DATE", "gophername: x"]


def test_observables_of_every_type(spark, tmp_path):
    h = "0123456789abcdef" * 2
    given = {
        f"evil[.]com, wss://c2[.]evil.net/ws; js.Evil.org/Layer.js, 5.6.7.8/gate and 9.8.7.6:53/tcp. See host.example/. 0x{h}": [("domain", "evil.com"), ("url", "wss://c2.evil.net/ws"), ("url", "js.Evil.org/Layer.js"), ("url", "5.6.7.8/gate"), ("ip", "9.8.7.6"), ("ip_port", "9.8.7.6:53"), ("domain", "host.example")],
        f"10.0.0.0/8 not 10.0.0.1 ::1 1::1\n- 0x{h.upper()} x\n{h} {h}{h} cve-2024-1234 T1059.001": [("cidr", "10.0.0.0/8"), ("ip", "10.0.0.1"), ("ipv6", "::1"), ("md5", h), ("md5", h), ("sha256", h + h), ("cve", "CVE-2024-1234"), ("technique", "T1059.001")],
        f"mail a@evil.com or 1.2.3.4.host.evil.com, HTTPS://X.y/{h}.": [("email", "a@evil.com"), ("domain", "1.2.3.4.host.evil.com"), ("url", f"HTTPS://X.y/{h}")],
        "nothing. here": [],
    }
    spark.createDataFrame(list(enumerate(given)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = [(r.id, r.type, r.value) for r in registry.queries()["observables_of_every_type"](spark, str(tmp_path)).collect() for _ in range(r.occurrences)]
    assert sorted(got) == sorted((i, *o) for i, found in enumerate(given.values()) for o in found)
    assert registry.queries()["observables_of_every_type"](spark, SMALL).where("type in ('email', 'ip', 'sha1')").exceptAll(registry.queries()["observables_in_documents"](spark, SMALL)).isEmpty()


def test_candidates_and_rules(spark):
    given = ["", "--", "cve-2024-1234", "a@b.com", "a@b", "T1059.001", "10.0.0.0/8", "10.0.0.0/99", "1.2.3.4", "1.2.3.999", "hxxp://x", "a" * 40, "a" * 33, "evil[.]com", "a..b", "word"]
    got = one(spark, extract.candidate_value("v"), *given)
    assert [r.type or r.error for r in got] == ["empty", "no_alphanumeric", "cve", "email", "invalid_email", "technique", "cidr", "invalid_cidr", "ip", "invalid_ip", "url", "sha1", "invalid_hash", "domain", "invalid_domain", "unrecognized"]
    names = ["excluded", "explicit", "stance_blocked", "model_supported", "model_applied", "curated", "structured", "operational", "sample_hash", "narrative"]
    base = {n: None for n in names} | {"sections": [], "model": None}
    cases = [({}, "R33"), ({"excluded": True, "explicit": True}, "R01"), ({"explicit": True}, "R10"), ({"stance_blocked": True}, "R20"), ({"sections": ["non_asserting"]}, "R21"), ({"sections": ["non_asserting", "x"]}, "R33"), ({"model": "context_only", "model_applied": True}, "R22"), ({"structured": True}, "R30"), ({"sample_hash": True}, "R34"), ({"sample_hash": True, "operational": True}, "R31"), ({"model": "malicious"}, "R32"), ({"model": "malicious", "model_supported": False}, "R33"), ({"curated": True}, "R50"), ({"curated": True, "structured": True}, "R40"), ({"curated": True, "operational": True}, "R41"), ({"curated": True, "model": "malicious", "model_supported": True}, "R42"), ({"curated": True, "model": "malicious"}, "R50"), ({"curated": True, "sample_hash": True}, "R43"), ({"curated": True, "narrative": True}, "R44")]
    df = spark.createDataFrame([base | c | {"i": i} for i, (c, _) in enumerate(cases)], "i int, sections array<string>, model string, " + ", ".join(f"{n} boolean" for n in names))
    got = [r.m.rule[:3] for r in df.select("i", extract.membership_rule().alias("m")).orderBy("i").collect()]
    assert got == [want for _, want in cases]


def test_scoring(spark):
    found, expected = (spark.createDataFrame([(x,) for x in xs], "k string") for xs in ("abcd", "bcde"))
    (r,) = extract.scored(found, expected, ["k"]).collect()
    assert (r.tp, r.fp, r.fn, r.precision, r.recall) == (3, 1, 1, 0.75, 0.75)


def test_stream_of_feeds(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    table = ingest.MembershipTable(spark, str(tmp_path / "table"))
    start = datetime(2024, 1, 1, tzinfo=UTC)
    for day, body in enumerate(("evil.com\n1.2.3.4\nEvil.com\n", "# x\nevil.com\nnew.org\n")):
        (folder / f"{day}.txt").write_text(body)
        ingest.follow(spark, str(folder), "f", table, str(tmp_path / "cp"), lambda d=day: start + timedelta(days=d)).awaitTermination(120)
    rows = {r.observable: (r.first_seen.day, r.last_seen.day, r.status) for r in table.read().collect()}
    assert rows == {"evil.com": (1, 2, "active"), "1.2.3.4": (1, 1, "active"), "new.org": (2, 2, "active")}
    over = ingest.expired(table.read(), start + timedelta(days=7, hours=12), 7)
    assert {r.observable: r.status for r in over.collect()} == {"evil.com": "active", "1.2.3.4": "expired", "new.org": "active"}


def test_late_events(spark, tmp_path):
    stream = spark.readStream.schema("event_id long, ts timestamp_ntz, user_id long, event_type string").parquet(f"{SMALL}/events.parquet*")
    q = ingest.windowed_counts(stream.withColumn("ts", F.col("ts").cast("timestamp")), "1 day").writeStream.format("memory").queryName("counts").outputMode("complete").trigger(availableNow=True).option("checkpointLocation", str(tmp_path)).start()
    q.awaitTermination(120)
    want = spark.read.parquet(f"{SMALL}/events.parquet").groupBy(F.to_date("ts").alias("d"), "event_type").count().count()
    assert spark.table("counts").count() == want


def test_retention(spark):
    rows = spark.createDataFrame([(datetime(2024, 1, d),) for d in (1, 5, 9)], "ts timestamp_ntz")
    assert reports.retained(rows, "ts", datetime(2024, 1, 10), 5).count() == 2
