import hashlib

from pyspark.sql import functions as F

from treeloom.llm import warc

SCHEMA = "page_id long, url string, html string, digest string, size int"
BIG = "<p>" + "x" * 200


def pages(spark, rows):
    return spark.createDataFrame([(*r, "d", -1) for r in rows], SCHEMA)


def test_records(spark):
    rows = [(5, "http://a/1", BIG), (2, "http://a/2", BIG), (9, "http://a/3", BIG), (1, "u", "tiny"), (3, "u", "tiny"), (4, None, None), (6, "a b\r\nWARC-Type: x", ""), (7, "u", "é" * 50), (8, "u", "é" * 50), (10, "u", "y" * 300_000), (11, "u", "\x00é中" * 40)]
    got = {r.id: r for r in warc.archived(pages(spark, rows)).collect()}
    assert len(got) == len(rows)
    for i, _, html in rows:
        raw = (html or "").encode()
        assert bytes(got[i].payload) == raw and got[i].digest == hashlib.sha256(raw).hexdigest()
    kinds = {i: (r.record_type, r.refers_to) for i, r in got.items()}
    assert kinds[2] == ("response", None) and kinds[5] == kinds[9] == ("revisit", 2)
    assert kinds[1] == kinds[3] == ("response", None) and kinds[7] == ("response", None) and kinds[8] == ("revisit", 7)
    assert got[6].url == "a%20b%0D%0AWARC-Type:%20x"


def test_standard_bytes(spark):
    rows = [(1, "http://a/", BIG), (2, "http://b/", BIG)]
    out = warc.archived(pages(spark, rows)).select("id", warc.record_bytes().alias("b")).collect()
    raw = {r.id: bytes(r.b) for r in out}
    head, body = raw[1].split(b"\r\n\r\n", 1)
    assert head.startswith(b"WARC/1.1\r\nWARC-Type: response\r\n") and f"Content-Length: {len(BIG)}".encode() in head
    assert body == BIG.encode() + b"\r\n\r\n"
    head, body = raw[2].split(b"\r\n\r\n", 1)
    assert b"WARC-Refers-To: <urn:page:1>" in head and b"Content-Length: 0" in head and body == b"\r\n\r\n"


def test_payloads_are_stored_once(spark, tmp_path):
    rows = [(i, "u", BIG) for i in range(20)] + [(50, "u", "other"), (51, "u", "other")]
    a = warc.write_archive(warc.payloads_of(pages(spark, rows)), str(tmp_path / "h"), str(tmp_path / "p"))
    assert spark.read.parquet(a.payloads).count() == 2 and spark.read.parquet(a.headers).count() == 22


def test_damage_is_seen(spark, tmp_path):
    import pytest

    a = warc.write_archive(warc.payloads_of(pages(spark, [(1, "u", BIG)])), str(tmp_path / "h"), str(tmp_path / "p"))
    bad = str(tmp_path / "bad")
    spark.read.parquet(a.payloads).withColumn("payload", F.lit(b"changed")).write.parquet(bad)
    with pytest.raises(Exception, match="damaged"):
        warc.read_archive(spark, warc.Archive(a.headers, bad)).collect()


def test_repeats_null_ids_and_empty_table(spark):
    got = warc.archived(pages(spark, [(1, "u", BIG), (1, "u", BIG), (None, "u", BIG), (None, "u", "only")])).collect()
    assert sorted(((r.id, r.record_type, r.refers_to) for r in got), key=repr) == sorted([(1, "response", None), (1, "response", None), (None, "revisit", 1), (None, "response", None)], key=repr)
    assert warc.archived(pages(spark, []).limit(0)).count() == 0
