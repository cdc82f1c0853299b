from __future__ import annotations

import hashlib

import pytest
from pyspark.sql import functions as F

from glyphweave.llm.warc_store import Archive, parse_warc, read_archive, write_archive

SCHEMA = "page_id long, url string, html string, digest string, n_bytes long"


def pages(spark, rows):
    return spark.createDataFrame([(i, u, h, "x", 1) for i, u, h in rows], SCHEMA)


def test_records_come_back_exactly(spark):
    big, other = "<p>é</p>" * 40, "y" * 100
    rows = [(5, "http://a/", big), (2, "http://b/", big), (9, None, big), (1, "http://c/\r\nX: y", other), (3, "u", "tiny"), (4, "u", "tiny"), (6, "u", ""), (7, "u", None), (8, "u", "z" * 99)]
    back = {r.page_id: r for r in read_archive(write_archive(pages(spark, rows))).collect()}
    assert len(back) == len(rows)
    for i, _, html in rows:
        data = (html or "").encode()
        assert bytes(back[i].payload) == data and back[i].payload_digest == hashlib.sha256(data).hexdigest()
    assert {i: (back[i].record_type, back[i].refers_to) for i in (5, 2, 9, 1, 3, 4, 6, 7, 8)} == {
        5: ("revisit", 2), 2: ("response", None), 9: ("revisit", 2), **{i: ("response", None) for i in (1, 3, 4, 6, 7, 8)}
    }
    records = parse_warc(b"".join(bytes(back[i].warc) for i in sorted(back)))
    assert len(records) == len(rows)
    assert records[0][0]["WARC-Target-URI"] == "http://c/%0D%0AX: y" and records[0][1] == other.encode()
    assert records[1][1] == big.encode() and records[4][0]["WARC-Type"] == "revisit" and records[4][1] == b""


def test_repeated_and_null_ids(spark):
    big = "q" * 200
    back = read_archive(write_archive(pages(spark, [(1, "u", big), (1, "u", big), (None, "u", big)]))).collect()
    assert sorted(r.record_type for r in back) == ["response", "revisit", "revisit"]
    assert {r.refers_to for r in back if r.record_type == "revisit"} == {1}


def test_empty_table(spark):
    assert read_archive(write_archive(pages(spark, []))).count() == 0


def test_a_damaged_payload_fails_the_read(spark):
    archive = write_archive(pages(spark, [(1, "u", "a" * 300)]))
    bad = Archive(archive.headers, archive.payloads.withColumn("payload", F.encode(F.lit("b" * 300), "UTF-8")), archive.rows)
    with pytest.raises(Exception, match="doesn't match its digest"):
        read_archive(bad).collect()


def test_a_hot_payload_is_stored_once(spark):
    rows = spark.range(5000).select(F.col("id").alias("page_id"), F.lit("u").alias("url"), F.when(F.col("id") % 3 == 0, F.lit("h" * 150)).otherwise(F.concat(F.lit("p" * 150), F.col("id").cast("string"))).alias("html"))
    archive = write_archive(rows)
    assert archive.payloads.count() == 1 + 3333 and read_archive(archive).filter("record_type = 'revisit' AND refers_to = 0").count() == 1666


def test_very_long_payloads_and_many_rows_without_ids(spark):
    long = "<p>ß</p>" * 400_000
    rows = [(1, "u", long), (2, "u", long), *((None, "u", "n" * 300) for _ in range(50))]
    archive = write_archive(pages(spark, rows))
    assert archive.payloads.count() == 2
    back = read_archive(archive, with_bytes=False).collect()
    assert sorted((r.page_id, r.payload_bytes, r.record_type, r.refers_to) for r in back if r.page_id) == [(1, 3_600_000, "response", None), (2, 3_600_000, "revisit", 1)]
    assert [r.record_type for r in back if not r.page_id].count("response") == 1


def test_payloads_are_packed_before_they_are_moved_and_stored(spark):
    words = [hashlib.sha256(str(k).encode()).hexdigest()[:7] for k in range(400)]
    html = {i: "<!DOCTYPE html><html><head><title>a page</title><style>p{margin:0}</style></head><body><nav><ul><li>menu</li></ul></nav><p>" + " ".join(words[(i * j) % 400] for j in range(60)) + "</p></body></html>" for i in range(300)}
    archive = write_archive(pages(spark, [(i, "u", h) for i, h in html.items()]))
    stored = archive.payloads.agg(F.sum(F.octet_length("payload"))).first()[0]
    assert 0 < stored < 0.6 * sum(map(len, html.values()))
    assert {r.page_id: bytes(r.payload).decode() for r in read_archive(archive).collect()} == html
