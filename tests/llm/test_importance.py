"""Operator 12 and the span table beside plain Python."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash

from chaintrail.llm import importance as I
from chaintrail.llm import ngrams as N

SCHEMA = "doc_id long, text string, rank string, weight string, score int"
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def grams(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(FOLD))
    return len(words), [" ".join(words[i : i + n]) for n in (1, 2, 3) for i in range(len(words) - n + 1)]


def brute(rows, target):
    bucket = lambda g: zlib.crc32(g.encode()) % 10000
    s, t = Counter(), Counter()
    for _, text in rows:
        s.update(map(bucket, grams(text)[1]))
    for text in target:
        t.update(map(bucket, grams(text)[1]))
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (all_s + 10000) / ((s[b] + 1) * (all_t + 10000))))
    out, enough = [], []
    for doc, text in rows:
        n, features = grams(text)
        weight = sum(gain(bucket(g)) for g in features)
        h = int(hashlib.sha256(f"42:{'' if doc is None else doc}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append([doc, len(features), weight, score, None])
        if n >= 20:
            enough.append(out[-1])
    enough.sort(key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for i, row in enumerate(enough[: 5 * len(enough) // 100]):
        row[4] = i + 1
    return sorted(map(tuple, out), key=repr)


def got(spark, rows, target):
    frame = spark.createDataFrame([(d, t, "x", "y", 1) for d, t in rows], SCHEMA).repartition(4)
    bench = spark.createDataFrame([(1, t) for t in target], "item_id long, text string")
    return sorted((tuple(r) for r in I.resample(frame, bench).collect()), key=repr)


def corpus(seed, n=300):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(60)] + ["Été", "ÄRGER", "naïve", "x" * 90, "y" * 200, "日本", "A1"]
    rows = [(i, rng.choice([" ", "-", ", ", "\n"]).join(rng.choices(vocab, k=rng.randint(0, 60)))) for i in range(n)]
    rows += [(1000, None), (1001, ""), (1002, " .,"), (1003, "z" * 5000 + " " + "q " * 30), (None, "lost " * 40)]
    rows += [(1004, rows[0][1]), (1004, rows[0][1]), (5, " ".join(vocab[:25]))]
    return rows


def test_against_brute_force(spark):
    rows = corpus(1)
    target = [rows[3][1], None, "w1 w2 w3 été", ""]
    assert got(spark, rows, target) == brute(rows, target)


def test_small_blocks(spark, monkeypatch):
    rows = corpus(2, 60)
    monkeypatch.setattr(I, "BLOCK_WORDS", 7)
    values = pa.array([t for _, t in rows], pa.string())
    seen = Counter()
    for _, text, spans in I._interned(values):
        for i, slot in zip(text.tolist(), spans.slot.tolist()):
            own = spans.first[slot]
            seen[i, spans.data[spans.starts[own] : spans.ends[own]].decode()] += 1
    want = Counter((i, g) for i, (_, t) in enumerate(rows) for g in grams(t)[1])
    assert seen == want


def test_empty_tables_and_ties(spark):
    assert got(spark, [], ["a b"]) == []
    rows = [(i // 2, "same words " * 20) for i in range(100)]
    assert got(spark, rows, []) == brute(rows, [])


def test_ranked_over_many_partitions(spark):
    rows = spark.range(1000).selectExpr("id", "id % 7 AS v").repartition(9)
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    try:
        got = {r["id"]: r["rank"] for r in I.ranked(rows, "v", "id").collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "2")
    assert [i for i, _ in sorted(got.items(), key=lambda x: x[1])] == sorted(range(1000), key=lambda i: (i % 7, i))
    assert sorted(got.values()) == list(range(1, 1001))


def test_hashes_of_spans():
    buf = np.random.default_rng(1).integers(0, 256, 5000, dtype=np.uint8)
    eight, data = N.windows(buf), buf.tobytes()
    for length in range(100):
        at = np.array([0, 3, 1000, 5000 - length])
        parts = [data[a : a + length] for a in at.tolist()]
        assert N.xxhash64(eight, at, length).tolist() == [xxhash.xxh64_intdigest(p) for p in parts]
        assert N.crc32(eight, at, length).tolist() == [zlib.crc32(p) for p in parts]


def test_table_tells_equal_hashes_apart(monkeypatch):
    """With one hash for everything, only the comparison of bytes tells spans apart."""
    monkeypatch.setattr(N, "xxhash64", lambda eight, starts, length: np.zeros(len(starts), dtype=np.uint64))
    buf = np.frombuffer(b"ab cd ab ef abcdefghij abcdefghik abcdefghij", dtype=np.uint8)
    starts = np.array([0, 3, 6, 9, 12, 23, 34])
    ends = np.array([2, 5, 8, 11, 22, 33, 44])
    spans = N.SpanTable(buf, starts, ends)
    used = np.flatnonzero(spans.first >= 0)
    assert sorted(zip(spans.spans(used), spans.counts()[used].tolist())) == [
        (b"ab", 2), (b"abcdefghij", 2), (b"abcdefghik", 1), (b"cd", 1), (b"ef", 1)
    ]
