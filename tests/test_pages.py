"""Cursors, pages, counted probes, generations of tables, files of records and documents."""

from datetime import UTC, datetime, timedelta

import duckdb
import pytest
from pyspark.sql import functions as F

from tamarack.functions import documents, text
from tamarack.operators import jobs, joins, paging, publish, reports
from tamarack.plans import registry
from tamarack.sources import feeds, records
from tamarack.streaming import ingest

NOW = datetime(2024, 3, 1, tzinfo=UTC)
SMALL = "/root/testdata/sf0.001"


def test_cursors_keep_microseconds():
    at = datetime(2024, 1, 2, 3, 4, 5, 678901)
    c = paging.Cursor.of(at, 7)
    assert paging.Cursor.decoded(c.encoded()) == c and c.micros % 1_000_000 == 678901
    assert paging.Cursor.of(at.replace(tzinfo=UTC), 7) == c
    for bad in ("", "!!", "W10", "WyJhIiwgMV0"):
        with pytest.raises(ValueError):
            paging.Cursor.decoded(bad)
    assert [paging.page_size(n) for n in (25, 30, None, 100)] == [25, 50, 50, 100]


def test_pages_say_whether_there_is_more(spark):
    rows = spark.range(120).select("id", F.expr("timestamp_micros(id div 7)").alias("at"))
    seen, cursor, more = [], None, True
    while more:
        page = paging.keyset_page(rows, 25, "at", "id", cursor).collect()
        seen += [r.id for r in page]
        more, cursor = page[-1].has_more, paging.Cursor(page[-1].cursor_micros, page[-1].id)
    assert seen == list(range(119, -1, -1))
    assert paging.keyset_page(rows.where("false"), 25, "at", "id").collect() == []


def test_probes_stop(spark):
    got = paging.probed_count(spark.range(10), 9).collect() + paging.probed_count(spark.range(9), 9).collect()
    assert [(r.counted, r.capped, r.shown) for r in got] == [(9, True, "9+"), (9, False, "9")]


def test_components_are_complete_or_fail(spark):
    chain = spark.range(40).select(F.col("id").alias("u"), (F.col("id") + 1).alias("v"))
    assert {r.label for r in joins.graph_components(chain).collect()} == {0}
    with pytest.raises(RuntimeError):
        joins.graph_components(chain, most=1)


def test_generations_are_collected(spark, tmp_path):
    table = ingest.MembershipTable(spark, str(tmp_path / "m"))
    one = spark.createDataFrame([("a", "ip", "f", NOW, NOW, "active", "x", None, False)], ingest.MEMBERSHIP)
    for g in range(5):
        table.write(one, g)
    assert table.collect(2, pinned=(1,)) == [0, 2] and table.read().count() == 1
    assert table.collect(2, pinned=(1,)) == []


def test_a_feed_that_expires(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "1.txt").write_text("a1.com\n")
    table = ingest.MembershipTable(spark, str(tmp_path / "t"))
    ingest.follow(spark, str(tmp_path / "in"), "f", table, str(tmp_path / "c"), lambda: NOW, 5).awaitTermination()
    (tmp_path / "in" / "2.txt").write_text("b1.com\n")
    ingest.follow(spark, str(tmp_path / "in"), "f", table, str(tmp_path / "c"), lambda: NOW + timedelta(days=9), 5).awaitTermination()
    assert {(r.observable, r.status) for r in table.read().collect()} == {("a1.com", "expired"), ("b1.com", "active")}


def test_headers_with_quotes():
    assert feeds.split_header('"Value", type ,"a, ""b"""') == ["value", "type", 'a, "b"']
    assert feeds.split_header("") == []


def test_bundles_that_were_changed(spark):
    rows = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], "k long, v string")
    made = records.bundles(rows, "k", ["v"])
    broken = made.withColumn("sha256", F.when(F.col("k") == 2, "0").otherwise(F.col("sha256")))
    assert sorted(r.v for r in records.unbundled(broken, "k", "v string").collect()) == ["a", "b"]


def test_chunk_files_are_written(spark, tmp_path):
    rows = spark.range(50).select(F.concat(F.lit("h"), "id", F.lit(".com")).alias("line"), F.lit("domain").alias("observable_type"))
    publish.write_chunks(publish.chunk_files(rows, 8), str(tmp_path / "out"))
    lines = spark.read.text(str(tmp_path / "out" / "chunks"))
    assert sorted(r.value for r in lines.select("value").collect()) == sorted(f"h{i}.com" for i in range(50))
    assert spark.read.json(str(tmp_path / "out" / "manifest")).agg(F.sum("items")).first()[0] == 50


def test_chunk_digests_are_those_of_the_files(spark):
    rows = spark.range(3000).select(F.concat(F.lit("h\u00e9"), "id", F.lit(".com")).alias("line"), F.lit("domain").alias("observable_type"))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        got = publish.chunk_digests(rows, 8).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = publish.chunk_files(rows, 8).drop("text").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want)) and len(got) == 8
    assert publish.chunk_digests(rows.where("false"), 8).count() == 0


def test_a_large_feed_has_the_chunks_of_its_sql(spark, monkeypatch):
    monkeypatch.setattr(publish, "CHUNK_ROWS", 2)  # as if the rows were 2500 times as many
    got = registry.queries()["published_chunk_files"](spark, SMALL).collect()
    db = duckdb.connect()
    db.execute(f"create view orders as select * from '{SMALL}/orders.parquet'")
    want = db.execute(f"SELECT chunk_key, items, content_sha256, etag FROM ({registry.oracle_sql()['published_chunk_files']})").fetchall()
    assert publish.chunk_count(sum(r.items for r in got)) > 64
    assert sorted(map(tuple, got)) == sorted(want)


def test_bulk_actions_and_modes(spark):
    rows = spark.createDataFrame([(1, "ip", "active", "Malware"), (2, "ip", "disabled", None), (3, "ip", None, None)], "id long, observable_type string, status string, threat_classification string")
    got = {a: {r.id: r.outcome for r in jobs.bulk_outcomes(rows, a, "Malware").collect()} for a in jobs.BULK_ACTIONS}
    assert got == {"classify": {1: "skipped", 2: "failed", 3: "succeeded"}, "suppress": {1: "succeeded", 2: "succeeded", 3: "succeeded"}, "expire": {1: "succeeded", 2: "failed", 3: "succeeded"}}
    with pytest.raises(ValueError):
        jobs.bulk_outcomes(rows, "no such action")
    assert reports.is_stale(None, NOW) and reports.is_stale(NOW - timedelta(hours=27), NOW) and not reports.is_stale(NOW - timedelta(hours=25), NOW)


def test_dates_and_markings(spark):
    one = lambda column, v: spark.createDataFrame([(v,)], "v string").select(column.alias("x")).first().x
    assert [str(d) for d in one(documents.published_dates("v"), "on 3rd March 2020, then 2021-02-30 and Sept. 5, 2021")] == ["2020-03-03", "2021-09-05"]
    assert [one(documents.tlp_marking("v"), v) for v in ("TLP:CLEAR TLP:AMBER+STRICT", "tlp:red", "TLP: WHITE", "TLP:REDDISH")] == ["amber+strict", None, "clear", None]


def test_dots_in_paths_and_times(spark):
    urls = ["http://a.b/x/./y/../z", "http://a.b/..", "http://a.b/a/b/..", "http://a.b/a..b/.c", "http://a.b/../../x?y=/../z"]
    df = spark.createDataFrame([(u,) for u in urls], "v string")
    assert [r[0] for r in df.select(text.normal_url("v")).collect()] == ["http://a.b/x/z", "http://a.b/", "http://a.b/a/", "http://a.b/a..b/.c", "http://a.b/x?y=/../z"]
    at = spark.createDataFrame([(datetime(2024, 1, 2, 23, 30),)], "t timestamp_ntz")
    assert at.select(text.csv_time("t", "America/New_York")).first()[0] == "2024-01-02T18:30:00-05:00"
