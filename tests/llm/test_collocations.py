"""Operator 13 beside brute force; its summaries beside plain counts."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from chaintrail.llm import collocations as C

SCHEMA = "doc_id long, text string, lang string, rank int, phrase string"
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, threshold=10, first=2000):
    f, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for part in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(FOLD)):
            w = re.findall(r"[^\x20\x09]+", part)
            n[lang] += len(w)
            for m in (1, 2, 3):
                f[lang].update(tuple(w[i : i + m]) for i in range(len(w) - m + 1))
    out = []
    for lang, counts in f.items():
        found = {p: a for p, a in counts.items() if len(p) > 1 and a >= threshold}
        rows = []
        for p, a in found.items():
            if any(len(q) > len(p) and 100 * b >= 50 * a and p in (q[:2], q[1:]) for q, b in found.items()):
                continue
            score, k = min((10**6 * a * a // (counts[p[:k]] * counts[p[k:]]), k) for k in range(1, len(p)))
            rows.append((-score, -a, " ".join(p).encode(), a, counts[p[:k]], counts[p[k:]], score))
        rows.sort()
        out += [(lang, i + 1, r[2].decode(), r[3], r[4], r[5], n[lang], r[6]) for i, r in enumerate(rows[:first])]
    return sorted(out)


def corpus(seed, n=250):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(25)] + ["Été", "日本", "L'an", "x" * 120, "a-b", "\xa0", "und"]
    rows = []
    for _ in range(n):
        words = []
        while len(words) < rng.randint(0, 60):
            words += rng.choice([["New", "york"], ["NEW", "York", "city"], ["of", "the"], [rng.choice(vocab)], [rng.choice(vocab)]])
        text = "".join(w + rng.choice([" ", " ", " ", "  ", "\t", ", ", ".", "\n", "\r", "\x0b", "!"]) for w in words)
        rows.append((rng.choice(["en", "en", "en", "de", None, "und", ""]), text))
    rows += [("en", None), (None, ""), ("en", " .,\n"), ("fr", "alone"), ("de", "long word " * 4000)]
    return rows


def got(spark, rows, **more):
    frame = spark.createDataFrame([(i % 9 or None, t, x, 1, "p") for i, (x, t) in enumerate(rows)], SCHEMA).repartition(5)
    return sorted(map(tuple, C.collocations(frame, **more).collect()))


def test_against_brute_force(spark):
    rows = corpus(1)
    assert got(spark, rows) == brute(rows)


def test_small_blocks_hot_parts_and_limits(spark, monkeypatch):
    for name, value in (("GATHERED", 50), ("HELD", 300), ("PHRASES", 40), ("BLOCK_WORDS", 11), ("PART_ROWS", 3), ("RANK_ROWS", 10)):
        monkeypatch.setattr(C, name, value)
    rows = corpus(2, 120)
    assert got(spark, rows, first=7) == brute(rows, first=7)


def test_a_full_filter_only_lets_more_pass(spark, monkeypatch):
    monkeypatch.setattr(C, "FILTER_BITS", 16)
    rows = corpus(3, 60)
    assert got(spark, rows) == brute(rows)


def test_empty_table_repeats_and_ties(spark):
    assert got(spark, []) == []
    rows = [("en", "b c, a b"), ("en", "c a")] * 12 + [("en", "x y z")] * 9
    assert got(spark, rows) == brute(rows)
    assert got(spark, [(None, "p q")] * 6 + [("und", "p q")] * 6) == [("und", 1, "p q", 12, 12, 12, 24, 1_000_000)]


def test_scores_beyond_64_bits(spark):
    rows = spark.createDataFrame([("en", "", 10**13), ("en", "p", 10**12 + 1), ("en", "q", 10**12 + 7), ("en", "p q", 10**12)], "lang string, phrase string, f long")
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(C, "frequent_runs", lambda *a: rows)
        (row,) = C.collocations(rows).collect()
    assert row["score"] == 10**6 * 10**24 // ((10**12 + 1) * (10**12 + 7))


@pytest.mark.parametrize("seed", range(6))
def test_summaries_keep_every_frequent_key(seed):
    rng = np.random.default_rng(seed)
    stream = rng.zipf(1.3, 20000).clip(max=4000).astype(np.uint32)
    for threshold in (3, 10, 200):
        summary = C.Summary(len(stream) // threshold + 1)
        for part in np.array_split(stream, 37):
            summary.add(*C._tally(part, np.ones(len(part), dtype=np.int64)))
            assert len(summary.keys) <= summary.capacity
        assert summary.off < threshold
        exact = Counter(stream.tolist())
        kept = set(summary.survivors(threshold).tolist())
        assert {k for k, c in exact.items() if c >= threshold} <= kept
        for key, count in zip(summary.keys.tolist(), summary.counts.tolist()):
            assert exact[key] - summary.off <= count <= exact[key]
