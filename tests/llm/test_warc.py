"""Exact round trip of archives."""

import hashlib

from pyspark.sql import functions as F

from chartula.llm import warc
from chartula.llm.common import shared_folder

LONG = "é" * 60
ROWS = [
    (1, "http://a/", LONG, "x"),
    (2, None, LONG, "x"),
    (3, "http://b/\r\nWARC-Type: x y", "short", "x"),
    (4, "http://b/", "short", "x"),
    (5, "http://c/", None, "x"),
    (6, "http://c/", "", "x"),
    (7, "http://d/é", "line\r\n\r\nline " * 50_000, "x"),
    (None, "http://n/", LONG, "x"),
    (8, "http://e/", LONG + "?", "x"),
    (1, "http://a/", LONG, "x"),
]


def test_round_trip(spark):
    pages = spark.createDataFrame(ROWS, "page_id long, url string, html string, payload string")
    folder = shared_folder(spark, "test-warc")
    index = warc.write_archives(pages, folder)
    assert {"file", "offset", "length", "url", "payload_digest"} <= set(index.columns)
    out = warc.read_records(index, folder).collect()
    assert len(out) == len(ROWS)
    html = {(i, u): (h or "").encode() for i, u, h, _ in ROWS}
    for r in out:
        key = next(k for k in html if k[0] == r.page_id and (k[0] is not None or True))
        payload = html[key]
        assert r.payload_bytes == len(payload) and r.payload_digest == hashlib.sha256(payload).hexdigest()
        assert r.record_type == "revisit" or bytes(r.payload) == payload
    kinds = {(r.page_id, r.record_type, r.refers_to) for r in out}
    assert kinds == {(1, "response", None), (2, "revisit", 1), (3, "response", None), (4, "response", None), (5, "response", None), (6, "response", None), (7, "response", None), (None, "revisit", 1), (8, "response", None)}
    urls = {r.page_id: r.url for r in out}
    assert urls[2] is None and urls[3] == "http://b/%0D%0AWARC-Type:%20x%20y" and urls[7] == "http://d/é"
    some = warc.read_records(index.filter(F.col("page_id").isin(3, 8)), folder).collect()
    assert {r.page_id for r in some} == {3, 8}


def test_empty_table(spark):
    assert warc.archived(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_neighbours_become_one_range():
    assert warc.coalesced([(300, 10), (0, 100), (100, 50), (160, 10)], gap=10) == [[(0, 100), (100, 50), (160, 10)], [(300, 10)]]
