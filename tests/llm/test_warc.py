import base64
import gzip
import hashlib
import random

import pytest
from pyspark.sql import functions as F

from locusframe.llm import common, warc

PAGES = "page_id long, url string, html string, digest string"
ROWS = [
    (3, "http://www.b.example/x?b=2&a=1#top", "<p>same</p>", "x"),
    (1, "https://a.example/", "<p>same</p>", "x"),
    (2, None, None, None),
    (4, "", "", "x"),
    (5, "http://a.example/y", "é" * 200_000, "x"),
    (5, "http://a.example/y", "é" * 200_000, "x"),
    (None, "http://c.example", "<p>same</p>", "x"),
]


def test_round_trip_and_order(spark):
    rows = warc.index(warc.write_archives(spark.createDataFrame(ROWS, PAGES), common.new_table(spark, "t"))).collect()
    assert [(r.url_key, r.timestamp) for r in rows] == sorted((r.url_key, r.timestamp) for r in rows) and len(rows) == len(ROWS)
    by = {r.page_id: r for r in rows}
    for page_id, _, html, _ in ROWS:
        raw = (html or "").encode()
        assert by[page_id].payload_bytes == len(raw) and by[page_id].payload_digest == base64.b32encode(hashlib.sha1(raw).digest()).decode()
    assert (by[1].record_type, by[1].refers_to) == ("response", None)
    assert (by[3].record_type, by[3].refers_to) == ("revisit", 1) and by[None].refers_to == 1
    assert (by[2].record_type, by[4].refers_to) == ("response", 2) and by[5].record_type == "response"
    none = spark.createDataFrame([], PAGES)
    assert warc.index(warc.write_archives(none, common.new_table(spark, "t"))).count() == 0


def test_whole_table_is_merged_in_order(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    archives = warc.write_archives(pages.repartition(5), common.new_table(spark, "t"))
    rows = warc.index(archives, range_rows=10).collect()
    assert len(rows) == pages.count() and [warc._order((r.url_key, r.timestamp, r.page_id, r.archive, r.offset)) for r in rows] == sorted(warc._order((r.url_key, r.timestamp, r.page_id, r.archive, r.offset)) for r in rows)
    payload = {r.page_id: r.html for r in pages.collect()}
    data = {r.archive: r.data for r in archives.collect()}
    first = {}
    for p in sorted(payload):
        first.setdefault(payload[p], p)
    for r in rows:  # every record is found by its place in the index
        text = gzip.decompress(data[r.archive][r.offset : r.offset + r.length])
        assert f"<urn:page:{r.page_id}>".encode() in text
        assert (r.record_type == "response") == (first[payload[r.page_id]] == r.page_id) and r.refers_to == (None if r.record_type == "response" else first[payload[r.page_id]])
        assert (payload[r.page_id].encode() in text) == (r.record_type == "response")


def test_loser_tree_equals_sorting():
    rng = random.Random(2)
    for k in [0, 1, 2, 3, 5, 8, 13]:
        runs = [sorted((rng.randrange(20), i, j) for j in range(rng.randrange(9))) for i in range(k)]
        assert list(warc.loser_tree_merge(runs, lambda x: x[0])) == sorted(x for r in runs for x in r)


def test_url_keys():
    assert warc.url_key("HTTP://WWW.Example.com:80/A/?b=2&a=1#x") == "com,example)/a?a=1&b=2"
    assert warc.url_key(None) == "" and warc.url_key("https://example.com") == "com,example)/"


def test_damaged_archives_are_refused():
    data = gzip.compress(warc.record(1, "http://a", b"x" * 99, warc.sha1_base32(b"x" * 99), None))
    assert len(list(warc.records(data + data))) == 2
    with pytest.raises(Exception):
        list(warc.records(data[:-12]))
