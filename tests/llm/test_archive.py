"""The archive gives back exact records and stops on damaged payloads."""

import hashlib
from collections import Counter

import pytest

from baitline.llm import archive
from baitline.llm.tables import shared_folder

LONG, OTHER = "<html>" + "é" * 200, "x" * 100
PAGES = [
    (5, "http://a/1", LONG, 0), (2, "http://a/2", LONG, 0), (9, "http://a/3", LONG, 0), (2, "http://a/2", LONG, 0), (None, "u", LONG, 0),
    (4, "u", OTHER, 0), (3, None, OTHER, 0), (3, "b\r\nX: 1", OTHER, 0), (7, "u", "short", 0), (8, "u", "short", 0), (6, "u", None, 0), (1, "u", "", 0),
]


@pytest.fixture(scope="module")
def written(spark):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string, digest int")
    folder = shared_folder(spark, "test-archive")
    archive.write_archive(pages, folder)
    return folder


def test_fields(spark, written):
    want, leaders = Counter(), {LONG: (2, "http://a/2"), OTHER: (3, None)}
    seen = set()
    for page_id, url, html, _ in PAGES:
        body = (html or "").encode()
        first = leaders.get(html) == (page_id, url) and html not in seen
        seen |= {html} if first else set()
        revisit = len(body) >= 100 and not first
        want[(page_id, len(body), hashlib.sha256(body).hexdigest(), "revisit" if revisit else "response", leaders[html][0] if revisit else None)] += 1
    got = archive.record_fields(archive.read_records(spark, written)).collect()
    assert Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got) == want


def test_records_are_whole(spark, written):
    rows = archive.read_records(spark, written).collect()
    assert len({r.header.split("WARC-Record-ID: ")[1].split("\r\n")[0] for r in rows}) == len(PAGES)
    for r in rows:
        head, rest = bytes(r.record).split(b"\r\n\r\n", 1)
        length = int(head.split(b"\r\nContent-Length: ")[1].split(b"\r\n")[0])
        assert head.startswith(b"WARC/1.1\r\n") and rest[length:] == b"\r\n\r\n"
        http, payload = rest[:length].split(b"\r\n\r\n", 1)
        assert payload == bytes(r.payload or b"") and http.startswith(b"HTTP/1.1 200 OK")
    assert spark.read.parquet(f"{written}/payloads").count() == 4


def test_damage_stops_the_job(spark, written):
    folder = shared_folder(spark, "test-archive")
    spark.read.parquet(f"{written}/headers").write.parquet(f"{folder}/headers")
    spark.read.parquet(f"{written}/payloads").selectExpr("digest", "concat(payload, cast('!' as binary)) AS payload").write.parquet(f"{folder}/payloads")
    with pytest.raises(Exception, match="does not match its digest"):
        archive.read_records(spark, folder).collect()


def test_no_rows(spark):
    folder = shared_folder(spark, "test-archive")
    archive.write_archive(spark.createDataFrame([], "page_id long, url string, html string"), folder)
    assert archive.record_fields(archive.read_records(spark, folder)).collect() == []
