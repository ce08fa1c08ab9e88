import base64
import hashlib

import pytest

from objsql.llm.warc import archive_roundtrip, classified, parse, read_archives, transactions, with_digests, write_archives

PAGES = [
    (5, "http://a.example/x?q=1", "<p>one</p>"), (2, None, "<p>one</p>"), (9, "http://b.example", "<p>one</p>"), (3, "bad url\r\nX: y", None), (4, "http://c.example/", ""),
    (-7, "relative/path", "WARC/1.1\r\nWARC-Type: response\r\n\r\ninside\r\n\r\n"), (8, "http://d.example/é", "é" * 100_000), (10, "http://e.example/", "\r\n\r\n"),
]


def brute(pages, min_bytes=0):
    out = {}
    for page, _, html in pages:
        body = (html or "").encode()
        same = [p for p, _, h in pages if (h or "") == (html or "")]
        first = min(same) if len(body) >= min_bytes else page
        out[page] = (len(body), base64.b32encode(hashlib.sha1(body).digest()).decode(), "response" if first == page else "revisit", None if first == page else first)
    return out


@pytest.mark.parametrize("min_bytes", [0, 5])
def test_roundtrip(spark, tmp_path, min_bytes):
    df = spark.createDataFrame([(*p, "z") for p in PAGES], "page_id long, url string, html string, digest string").repartition(3)
    rows = archive_roundtrip(df, f"file://{tmp_path}/w", min_bytes=min_bytes).collect()
    assert {r.page_id: (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in rows} == brute(PAGES, min_bytes)
    assert len(rows) == len(PAGES)
    assert all(r.verified for r in rows)
    assert all(r.concurrent.request.content.startswith("GET ") and r.concurrent.metadata.content == f"page: {r.page_id}\r\n" for r in rows)


def test_payloads_come_back(spark, tmp_path):
    df = spark.createDataFrame(PAGES, "page_id long, url string, html string")
    write_archives(classified(with_digests(df, "page_id", "html", "url")), f"{tmp_path}/w", pages_per_file=((3, 2), (1000, 1), (None, 1)))
    found = read_archives(spark, f"{tmp_path}/w")
    assert found.count() == 3 * len(PAGES)
    rows = {r.capture: r.response for r in transactions(found).collect()}
    for page, _, html in PAGES:
        record = rows[f"urn:capture:response:{page}"]
        if record.kind == "response":
            assert bytes(record.payload).decode() == (html or "")


def test_lonely_records_and_empty_tables(spark, tmp_path):
    found = spark.createDataFrame([("request", "r1", "gone", None, None, None, None, None, None, "GET")] * 2, "kind string, record string, concurrent_to string, refers_to string, digest string, url string, http_length long, payload_digest string, payload_bytes long, content string")
    rows = transactions(found).collect()
    assert len(rows) == 1 and rows[0].response is None and rows[0].request.record == "r1"
    empty = spark.createDataFrame([], "page_id long, url string, html string")
    assert archive_roundtrip(empty, f"{tmp_path}/e").count() == 0


def test_damage_is_an_error():
    with pytest.raises(ValueError):
        list(parse(b"WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 50\r\n\r\nshort"))
    assert list(parse(b"")) == []


def test_null_and_repeated_ids(spark, tmp_path):
    rows = [(None, "u", "x"), (None, "u", "x"), (None, None, None), (3, "u", "x"), (3, "u", "x"), (3, "v", "other"), (4, "u", "x"), (4, "u", "x"), (5, "u", "other"), (6, "w", "")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)
    got = sorted((str(r.page_id), r.payload_bytes, r.record_type, r.refers_to or 0, r.verified) for r in archive_roundtrip(df, f"{tmp_path}/n").collect())
    assert got == sorted([("None", 1, "response", 0, True)] * 2 + [("None", 0, "response", 0, True)] + [("3", 1, "response", 0, True)] * 2 + [("3", 5, "response", 0, True), ("5", 5, "revisit", 3, True), ("6", 0, "response", 0, True)] + [("4", 1, "revisit", 3, True)] * 2)


def test_many_equal_payloads(spark, tmp_path):
    df = spark.range(3000).selectExpr("id + 5 as page_id", "'u' as url", "case when id % 3 > 0 then '' else repeat('é', cast(id % 7 as int)) end as html")
    rows = archive_roundtrip(df, f"{tmp_path}/m").collect()
    want = brute([(k + 5, "u", "" if k % 3 else "é" * (k % 7)) for k in range(3000)])
    assert {r.page_id: (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in rows} == want and len(rows) == 3000 and all(r.verified for r in rows)
