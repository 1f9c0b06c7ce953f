"""Operator 11 beside brute force and true similarities."""

import hashlib
import random
from collections import Counter

import numpy as np
import pyarrow as pa

from chaintrail.llm import fingerprints as P
from chaintrail.llm.arrow_text import shingle_sets

SCHEMA = "doc_id long, text string, fingerprint string, part int, place string"


def corpus(seed, n=60):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)] + ["Été", "日本", "🙂🙂"]
    rows = [(i * 3, rng.choice([" ", "\n", "  "]).join(rng.choices(vocab, k=rng.choice([1, 4, 5, 30, 200])))) for i in range(n)]
    rows += [(1, None), (4, ""), (7, " \n"), (10, "abc"), (13, "word " * 3000), (16, "x" * 3_000_000)]
    rng.shuffle(rows)
    return rows


def jaccard(a, b, k=5):
    def shingles(t):
        words = t.encode().lower().split()
        return {tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))} if words else set()

    x, y = shingles(a), shingles(b)
    return len(x & y) / len(x | y) if x | y else 1.0


def brute(rows):
    """(doc_id, n_chars, edited_sha256, true likeness to the edited text, to the next) in the order of doc_id."""
    rows = [(d, t or "") for d, t in sorted(rows, key=lambda r: r[0])]
    out = []
    for i, (doc, text) in enumerate(rows):
        after = rows[(i + 1) % len(rows)][1]
        q = len(text) // 4
        edited = text[: len(text) - q] + after[:q]
        out.append((doc, len(text), hashlib.sha256(edited.encode()).hexdigest(), jaccard(text, edited), jaccard(text, after)))
    return out


def run(spark, rows, parts=4):
    frame = spark.createDataFrame([(d, t, "f", 1, "p") for d, t in rows], SCHEMA).repartition(parts)
    return sorted(P.neighbours(frame).collect(), key=lambda r: (r["doc_id"] is None, r["doc_id"] or 0))


def test_against_brute_force(spark):
    rows = corpus(1)
    spark.conf.set("spark.sql.shuffle.partitions", "9")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = run(spark, rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "2")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    want = brute(rows)
    assert [tuple(r)[:3] for r in got] == [w[:3] for w in want]
    for r, w in zip(got, want):
        assert abs(r["near_edited"] - w[3]) < 0.12 and abs(r["near_next"] - w[4]) < 0.12
    assert np.mean([abs(r["near_edited"] - w[3]) for r, w in zip(got, want)]) < 0.02


def test_fingerprint_alone_equals_that_of_neighbours(spark):
    rows = corpus(2, 20)
    frame = spark.createDataFrame([(d, t, "f", 1, "p") for d, t in rows], SCHEMA)
    alone = {r["doc_id"]: bytes(r["fingerprint"]) for r in P.fingerprints(frame).collect()}
    assert alone == {r["doc_id"]: bytes(r["fingerprint"]) for r in run(spark, rows)}
    assert alone[1] == alone[4] == alone[7] == b"" and len(alone[10]) == 256


def test_estimates_are_unbiased():
    """Over many pairs of known similarity the estimate's mean meets it, for sets smaller and larger than the bins."""
    rng = random.Random(3)
    make = P.Fingerprinter()
    for size in (40, 300, 2000):
        for share in (0.0, 0.3, 0.7, 0.9):
            left, right, true = [], [], []
            for i in range(40):
                base = [f"v{i}_{j}_{rng.random()}" for j in range(size)]
                cut = int(size * share)
                a, b = " ".join(base), " ".join(base[:cut] + [f"u{i}_{j}" for j in range(size - cut)])
                left.append(a)
                right.append(b)
                true.append(jaccard(a, b))
            near = make.likeness(make(pa.array(left)), make(pa.array(right)))
            assert abs(near.mean() - np.mean(true)) < 0.025, (size, share)
            assert np.abs(near - true).max() < 0.25


def test_probes_beside_a_plain_loop():
    make = P.Fingerprinter(bins=16)
    values = pa.array([" ".join(f"a{i}_{j}" for j in range(i)) for i in range(12)])
    minima = make.minima(values)
    sets = shingle_sets(values, 5)
    for row, found in zip(minima, sets):
        want = {}
        for h in found.tolist():
            want[h >> 60] = min(h, want.get(h >> 60, h))
        assert {b: int(v) for b, v in enumerate(row) if v != P.EMPTY} == want
    for row, dense in zip(minima, make.densify(minima)):
        for b in range(16):
            donors = [int(p) for p in [b, *make.probes[b]] if row[int(p)] != P.EMPTY]
            assert dense[b] == (row[donors[0]] if donors else P.EMPTY)


def test_ties_nulls_repeats_and_empty_table(spark):
    assert run(spark, []) == []
    (only,) = run(spark, [(5, "a b c d e f g h")])
    assert only["near_next"] == 1.0
    rows = [(1, "a b c d e f")] * 40 + [(None, "n n n")] * 3 + [(None, None)] + [(2, "x y")]
    got = run(spark, rows)
    assert Counter(r["doc_id"] for r in got) == {1: 40, None: 4, 2: 1}
    assert sum(r["near_next"] == 1.0 for r in got if r["doc_id"] == 1) == 39
    assert len({bytes(r["fingerprint"]) for r in got if r["doc_id"] == 1}) == 1
