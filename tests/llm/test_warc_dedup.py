"""Operator 4: archives hold what was written, whatever the pages hold."""

import base64
import hashlib

from chaintrail.llm import warc_dedup as W
from chaintrail.session import new_scratch

SCHEMA = "page_id long, url string, html string, payload_bytes int, refers_to string"


def round_trip(spark, rows, min_bytes=0):
    path = new_scratch(spark, "archives")
    W.write_archives(spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA).repartition(3), path, min_bytes)
    return W.read_archives(spark, path).collect()


def test_round_trip_with_awkward_payloads(spark, monkeypatch):
    monkeypatch.setattr(W, "READ_BYTES", 11)
    tricky = "a\r\n\r\nWARC/1.1\r\n\r\n é\n\n"
    rows = [
        (1, "http://a/", tricky), (2, "http://b/ \r\nX: y", tricky), (3, None, None), (4, "u", ""),
        (5, "u", "long " * 50_000), (7, "u", "long " * 50_000), (8, "u", "own"), (None, "u", "own"),
    ]
    got = {r.page_id: r for r in round_trip(spark, rows)}
    assert {k: r.refers_to for k, r in got.items()} == {1: 2, 2: None, 3: 4, 4: None, 5: 7, 7: None, 8: None, None: None}
    for page, url, html in rows:
        payload = (html or "").encode()
        r = got[page]
        assert r.payload_digest == base64.b32encode(hashlib.sha1(payload).digest()).decode()
        assert r.payload_bytes == len(payload)
        assert r.record_type == ("revisit" if r.refers_to else "response")
        assert r.payload is None if r.refers_to else bytes(r.payload) == payload
    assert got[2].url == "http://b/%20%0D%0AX:%20y" and got[3].url is None


def test_minimum_size_repeats_and_empty_table(spark):
    rows = [(1, "u", "abc"), (2, "u", "abc"), (3, "u", "abcdef"), (4, "u", "abcdef"), (4, "u", "abcdef")]
    got = sorted((r.page_id, r.refers_to or 0) for r in round_trip(spark, rows, min_bytes=4))
    assert got == [(1, 0), (2, 0), (3, 4), (4, 0), (4, 0)]
    assert round_trip(spark, []) == []


def test_one_page_id_with_two_payloads_keeps_both(spark):
    rows = [(5, "u", "A"), (5, "v", "B"), (9, "u", "A"), (10, "v", "B"), (5, "w", "C")]
    got = round_trip(spark, rows)
    assert sorted((r.page_id, r.url, r.refers_to) for r in got if r.refers_to) == [(5, "u", 9), (5, "v", 10)]
    assert sorted((r.page_id, bytes(r.payload)) for r in got if not r.refers_to) == [(5, b"C"), (9, b"A"), (10, b"B")]
