"""Operator 1 beside a brute-force version."""

import random
from math import comb

import numpy as np
import pytest

from chaintrail.llm import minhash_dedup as M

SCHEMA = "doc_id long, text string, lang string, n long, rep string"


def brute(rows, k, num, den):
    sets = {}
    for doc, text in rows:
        words = (text or "").encode().lower().split()
        sets[doc] = {tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))} if words else set()
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b])
            if a < b and both and den * both >= num * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {d: (len(s), find(d), find(d) == d) for d, s in sets.items()}


def corpus(seed, groups=6, size=40):
    """Groups of copies with a few words replaced: pairs on both sides of the threshold, chains among them."""
    rng = random.Random(seed)
    rows, doc = [], 0
    line = " ".join(f"boiler{i}" for i in range(30))
    for g in range(groups):
        base = [f"w{g}_{i}" for i in range(rng.choice([3, 12, 80, 300]))]
        for _ in range(size):
            words = list(base)
            for _ in range(rng.randint(0, max(1, len(words) // 20))):
                words[rng.randrange(len(words))] = f"x{rng.random()}"
            text = rng.choice([" ", "\n", "  "]).join(words)
            rows.append((doc, text.upper() if rng.random() < 0.2 else text))
            doc += 1
    rows += [(doc + i, f"{line} {' '.join(f'own{i}_{j}' for j in range(20))}") for i in range(30)]
    rows += [(9000, None), (9001, ""), (9002, " \n\t"), (9003, "one"), (9004, "ONE"), (9005, "one two"), (9006, "lone")]
    rng.shuffle(rows)
    return rows


def check(spark, rows, k, num, den):
    frame = spark.createDataFrame([(d, t, "en", 1, "x") for d, t in rows], SCHEMA).repartition(5)
    got = {r[0]: tuple(r)[1:] for r in M.near_duplicates(frame, k, num, den).collect()}
    assert got == brute(rows, k, num, den)


def test_against_brute_force(spark):
    check(spark, corpus(1), 3, 85, 100)


def test_blocks_and_small_hubs(spark, monkeypatch):
    monkeypatch.setattr(M, "BLOCK_ROWS", 7)
    monkeypatch.setattr(M, "HUB_ROWS", 5)
    check(spark, corpus(2, groups=3), 5, 80, 100)


@pytest.mark.parametrize("seed", [3, 4])
def test_more_rounds_of_hubs(spark, monkeypatch, seed):
    """Every list that is left open gets further hubs, and is then swept in blocks of a few classes."""
    monkeypatch.setattr(M, "BLOCK_ROWS", 6)
    monkeypatch.setattr(M, "BLOCK_SHINGLES", 900)
    monkeypatch.setattr(M, "LEFT_TO_SWEEP", 0)
    check(spark, corpus(seed, groups=4), 3, 85, 100)


def test_a_passage_that_many_share_and_a_large_group(spark):
    rng = random.Random(6)
    passage = [f"p{i}" for i in range(60)]
    base = [f"b{i}" for i in range(150)]
    rows = [(i, " ".join(passage + [f"own{i}_{j}" for j in range(110)])) for i in range(150)]
    for i in range(150, 330):
        words = list(base)
        for _ in range(rng.randint(0, 6)):
            words[rng.randrange(150)] = f"x{rng.random()}"
        rows.append((i, " ".join(words)))
    check(spark, rows, 3, 85, 100)
    check(spark, rows, 5, 80, 100)


@pytest.mark.parametrize("threshold", [0.8, 0.85])
def test_a_class_may_leave_out_no_more_than_it_shares(spark, threshold):
    """For all sizes of two sets at the threshold, what the smaller sketch knows of the shared values exceeds what is left out."""
    sizes = spark.createDataFrame([(n,) for n in range(1, M.INDEXED)], "kept int")
    skip = {r["kept"]: r["s"] for r in sizes.select("kept", M._may_leave_out(threshold).alias("s")).collect()}
    for n, s in skip.items():
        for m in range(n, int(n / threshold + 1e-9) + 1):
            shared = -(-threshold * m // 1)
            if shared <= n:
                assert s < shared - max(0, m - M.INDEXED)
                if m in skip:
                    assert skip[m] < shared


def test_empty_table_and_repeated_rows(spark):
    assert M.near_duplicates(spark.createDataFrame([], SCHEMA)).collect() == []
    rows = [(1, "a b c d e f", "en", 1, "x")] * 3 + [(None, "a b c d e f", "en", 1, "x"), (None, None, None, None, None)]
    got = sorted(map(tuple, M.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()), key=repr)
    assert got == [(1, 2, 1, True)] * 3 + [(None, 0, None, None), (None, 2, None, None)]


def test_miss_bounds():
    for threshold in (0.8, 0.85):
        miss = lambda s, t=threshold: sum(comb(M.INDEXED, i) * t**i * (1 - t) ** (M.INDEXED - i) for i in range(s))
        s = M.shared_at_least(threshold)
        assert miss(s) <= M.MISS < miss(s + 1)
    assert 0.5 < M.estimate_floor(0.85) < 0.85


def test_pairs_of_a_block_are_judged_in_strips():
    """A block of 4,096 by 4,096 classes took 700 MB of a worker where all its pairs were judged at once."""
    rng = np.random.default_rng(3)
    both, x, y = rng.integers(0, 9, (600, 500)), np.arange(600), np.arange(500)
    seen = []

    def test(both, x, y):
        seen.append(len(x))
        return (both > 4) & (x[:, None] != y[None, :])

    assert (M._marked(both, x, y, test) == test(both, x, y)).all()
    assert sum(seen[:-1]) == 600 and max(seen[:-1]) <= M.STRIP_ROWS


def test_overlap_beside_sets(monkeypatch):
    monkeypatch.setattr(M, "STRIP_ROWS", 7)
    monkeypatch.setattr(M, "PAIRS_AT_ONCE", 11)
    rng = np.random.default_rng(4)
    a, b = ([np.unique(rng.integers(0, 400, n)).astype(np.uint64) for n in rng.integers(1, 90, size)] for size in (60, 45))
    want = [[len(set(p.tolist()) & set(q.tolist())) for q in b] for p in a]
    assert M._overlap(a, b).tolist() == want


def test_texts_go_as_soon_as_their_links_are_written(spark):
    import os

    rng = random.Random(5)
    base = [f"w{rng.randrange(500)}" for _ in range(60)]
    rows = [(i, " ".join([*base[:59], f"x{i}"])) for i in range(6)] + [(9, "alone here"), (10, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    reps = M.sketches(docs, 3).where("n > 0").withColumnRenamed("doc_id", "rep")
    steps = []
    links = M.links(docs, reps, 3, 85, 100, steps)
    found = {x for r in links.collect() for x in r}
    left = [os.path.basename(step._scratch_path) for step in steps]
    assert found == set(range(6))
    assert not [x for x in left if x.startswith(("star-texts", "star-pairs", "star-hopeful", "lists"))]
