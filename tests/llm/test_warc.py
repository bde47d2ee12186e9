import base64
import gzip
import hashlib

from pyspark.sql import functions as F

from foliospark.llm.warc import _member, archive_pages, page_index, read_warc

PAGES = "page_id long, url string, html string, payload string, key string, size long"


def pages(spark, rows):
    return spark.createDataFrame([(i, u, h, "p", "k", 1) for i, u, h in rows], PAGES)


def brute(rows):
    out = []
    for i, _, h in rows:
        data = (h or "").encode()
        same = [j for j, _, g in rows if (g or "").encode() == data and j is not None]
        first = min(same) if same else None
        again = first is not None and i != first and sum((g or "") == (h or "") for _, _, g in rows) > 1
        out.append((i, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if again else "response", first if again else None))
    return sorted(out, key=repr)


ROWS = [(1, "http://a/1", "<p>x</p>"), (2, None, "<p>x</p>"), (3, "http://a/3", None), (4, "http://a/4", ""), (5, "u", "WARC/1.1\r\n\r\nfoo é 😀\r\n\r\n"), (None, "n", "<p>x</p>"), (6, "u", "z" * 300_000), (7, "u\r\nX: y", "q")]


def test_round_trip(spark):
    got = page_index(read_warc(spark, archive_pages(pages(spark, ROWS)))).collect()
    assert sorted(map(tuple, got), key=repr) == brute(ROWS)


def test_payloads_come_back_whole_and_headers_filter(spark):
    path = archive_pages(pages(spark, ROWS))
    records = read_warc(spark, path)
    payloads = {r["headers"]["X-Page-Id"]: r["payload"] for r in records.filter("warc_type = 'response'").collect()}
    assert payloads["5"].decode() == ROWS[4][2] and payloads["6"] == b"z" * 300_000
    revisits = records.filter(F.col("warc_type") == "revisit")
    assert sorted(r["headers"].get("X-Page-Id", "-") for r in revisits.collect()) == ["-", "2", "4"]
    assert all(r["payload"] is None for r in revisits.collect())
    assert records.filter(F.col("target_uri").isin("http://a/1", "none")).count() == 1
    bare = read_warc(spark, path, payload=False)
    assert bare.count() == len(ROWS) and bare.filter("payload IS NOT NULL").count() == 0


def test_foreign_archives(spark, tmp_path):
    block = b"HTTP/1.1 200 OK\r\nA: b\r\n\r\nbody"
    record = lambda n: b"WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:%d>\r\nContent-Length: %d\r\n\r\n" % (n, len(block)) + block + b"\r\n\r\n"
    (tmp_path / "a.warc").write_bytes(record(1) + record(2))
    (tmp_path / "b.warc.gz").write_bytes(gzip.compress(record(3)) + gzip.compress(record(4)))
    got = read_warc(spark, str(tmp_path)).collect()
    assert sorted(r["record_id"] for r in got) == [f"<urn:{i}>" for i in (1, 2, 3, 4)] and {bytes(r["payload"]) for r in got} == {b"body"}


def test_odd_archives(spark, tmp_path):
    """Several records in a member, headers of any length, case and number of values, members that state their length."""
    def record(n, more=b"", length=b"content-length"):
        return b"WARC/1.0\r\nwarc-type: resource\r\nWARC-RECORD-ID: <urn:%d>\r\n%s%s: 4\r\n\r\nab\r\n\r\n\r\n" % (n, more, length)

    twice = b"WARC-Concurrent-To: <urn:x>\r\nWARC-Concurrent-To: <urn:y>\r\n"
    long = b"X-Long: " + b"z" * (9 << 20) + b"\r\n"
    (tmp_path / "a.warc.gz").write_bytes(gzip.compress(record(1) + record(2, twice) + record(3)) + gzip.compress(record(4)))
    (tmp_path / "b.warc.gz").write_bytes(_member(record(5, long)) + _member(record(6) + record(7)) + _member(record(8, length=b"Content-length")))
    (tmp_path / "c.warc").write_bytes(record(9, long) + record(10) + b"\r\n")
    records = read_warc(spark, str(tmp_path))
    got = {int(r["record_id"][5:-1]): r for r in records.select("record_id", "warc_type", "payload", "content_length", F.element_at("headers", "WARC-Concurrent-To").alias("to"), F.length(F.element_at("headers", "X-Long")).alias("long")).collect()}
    assert sorted(got) == [*range(1, 11)] and all(bytes(r["payload"]) == b"ab\r\n" and r["content_length"] == 4 and r["warc_type"] == "resource" for r in got.values())
    assert got[2]["to"] == "<urn:x>, <urn:y>" and got[5]["long"] == got[9]["long"] == 9 << 20
    assert read_warc(spark, str(tmp_path), payload=False).filter("payload IS NULL").count() == 10
    assert records.filter("record_id = '<urn:7>'").count() == records.filter("record_id = '<urn:5>'").count() == 1


def test_least_size_and_empty(spark):
    kinds = {r["page_id"]: r["record_type"] for r in page_index(read_warc(spark, archive_pages(pages(spark, ROWS), min_bytes=1))).collect()}
    assert kinds[4] == "response" and kinds[2] == "revisit"
    assert page_index(read_warc(spark, archive_pages(pages(spark, [])))).collect() == []
