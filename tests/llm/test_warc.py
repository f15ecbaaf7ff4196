import hashlib

import pytest

from reliefspark.llm import warc

LONG, LONGER = "é" * 500, "x" * 5000
PAGES = [(1, "http://a/", LONG), (2, "http://b/\r\nX: y", LONG), (5, "http://c/", LONG), (3, None, "short"), (4, "http://d/", "short"), (6, "http://e/", None), (7, "http://f/", ""),
         (8, "http://g/", LONGER), (9, "http://h/", LONGER), (9, "http://h/", LONGER), (None, "http://i/", "n" * 1200), (10, "http://j/", "y" * 999), (11, "http://k/", "y" * 999)]


def pages(spark, rows=PAGES):
    return spark.createDataFrame([(*r, "extra") for r in rows], "page_id long, url string, html string, payload string").repartition(3)


def test_archive_round_trip(spark):
    folder = warc.archive(pages(spark))
    got = sorted((tuple(r) for r in warc.summary(spark, folder).collect()), key=repr)
    owner = {LONG: 5, LONGER: 9}
    want = []
    for i, _, html in PAGES:
        data = (html or "").encode()
        revisit = html in owner and owner[html] != i
        want.append((i, len(data), hashlib.sha1(data).hexdigest(), "revisit" if revisit else "response", owner[html] if revisit else None))
    assert got == sorted(want, key=repr)
    payloads = spark.read.parquet(f"{folder}/payloads")
    assert payloads.count() == len({(h or "") for _, _, h in PAGES}) == payloads.select("payload_key").distinct().count()
    records = {r.record_id: bytes(r.record) for r in warc.records(spark, folder).collect()}
    assert records[5].startswith(b"WARC/1.1\r\nWARC-Type: response\r\n") and records[5].endswith(LONG.encode() + b"\r\n\r\n") and b"Content-Length: 1000\r\n" in records[5]
    assert b"WARC-Refers-To: <urn:page:5>\r\n" in records[1] and records[1].endswith(b"Content-Length: 0\r\n\r\n\r\n\r\n")
    assert b"\r\nX: y" not in records[2]


def test_damage_is_found(spark):
    from pyspark.sql import functions as F
    folder = warc.archive(pages(spark))
    broken = warc.new_folder(spark, "broken")
    spark.read.parquet(f"{folder}/headers").write.parquet(f"{broken}/headers")
    spark.read.parquet(f"{folder}/payloads").withColumn("payload", F.encode(F.lit("other"), "UTF-8")).write.parquet(f"{broken}/payloads")
    with pytest.raises(Exception, match="does not match its digest"):
        warc.summary(spark, broken).collect()


def test_empty_table(spark):
    assert warc.summary(spark, warc.archive(pages(spark, []))).count() == 0
