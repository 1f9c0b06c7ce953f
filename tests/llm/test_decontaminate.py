"""Operator 3 on planted passages."""

import numpy as np
import pyarrow as pa
import pytest

from chaintrail.llm import decontaminate as D

VOCABULARY = ["".join(x) for x in np.random.default_rng(1).choice(list("abcdefghijklm"), (900, 5))]


def prose(seed, n):
    return list(np.random.default_rng(seed).choice(VOCABULARY, n))


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
        row = new
    return row[-1]


def test_lcs_beside_a_table():
    rng = np.random.default_rng(2)
    for _ in range(200):
        a, b = rng.integers(0, 5, rng.integers(0, 20)).tolist(), rng.integers(0, 5, rng.integers(0, 30)).tolist()
        assert D.lcs_length(a, b) == lcs(a, b)


def test_chunks_lose_no_passage(monkeypatch):
    rng = np.random.default_rng(3)
    texts = [" ".join(prose(i, int(n))) for i, n in enumerate(rng.integers(0, 80, 40))]
    hashes, at = D.words(pa.array(texts))
    basis = rng.normal(size=(D.FEATURES, 3)).astype(np.float32)

    def passages():
        out = []
        for a, _, starts, text, first, _, y in D._passages(at, D.buckets(hashes), basis):
            out += [(a + int(starts[f]), int(text[f]), *np.round(v, 3).tolist()) for f, v in zip(first, y)]
        return out

    whole = passages()
    assert len(whole) == sum(max(1, -(-n // D.TILE) - 1) for n in np.diff(at) if n)
    for size in (1, 2, 3, 7):
        monkeypatch.setattr(D, "CHUNK_TILES", size)
        assert passages() == whole


def test_shared_words_beside_sets():
    rng = np.random.default_rng(4)
    space = D.Space(np.ones(D.FEATURES), rng.normal(size=(D.FEATURES, D.RANK)).astype(np.float32), np.ones(D.RANK))
    items = D.prepare([(i, " ".join(rng.choice(VOCABULARY[:30], 12)), None) for i in range(5)], space)
    hashes, at = D.words(pa.array([" ".join(rng.choice(VOCABULARY[:60], int(n))) for n in (0, 1, 40, 200, 0, 9)]))
    doc = rng.integers(0, 6, 400)
    start = at[doc] + (rng.random(400) * (at[doc + 1] - at[doc])).astype(int)
    stop = start + (rng.random(400) * (at[doc + 1] - start + 1)).astype(int)
    item = rng.integers(0, 5, 400)
    got = D.shared_words(hashes, at, start, stop, item, items)
    for a, b, i, n in zip(start, stop, item, got):
        here = set(hashes[a:b].tolist())
        assert n == sum(h in here for h in items.hashes[i])


@pytest.mark.parametrize("sample", [4_000, 30])
def test_planted(spark, monkeypatch, sample):
    """Also when the axes of the latent space are fitted on a third of the texts only."""
    monkeypatch.setattr(D, "SAMPLE_TILES", 60)
    monkeypatch.setattr(D, "SAMPLE_TEXTS", sample)
    items = [(i, " ".join(prose(100 + i, n))) for i, n in enumerate([15, 20, 40, 100])]
    docs, want = [], {}
    for i, text in items:
        own = text.split()
        changed = [w if k % 6 else "zzzz" for k, w in enumerate(own)]
        for cut in (0, 5, 31):
            for form in (own, changed):
                want[len(docs)] = i
                docs.append(" ".join(prose(500 + len(docs), cut) + form + prose(900 + len(docs), 60)).upper() + ".")
    for k in range(60):
        docs.append(" ".join(prose(2000 + k, 10 + 5 * k)))
    docs += [None, "", " \n", "!!!", docs[0], items[1][1] + " " + " ".join(prose(7, 30_000)), " ".join(prose(8, 30_000)) + " " + items[2][1]]
    want |= {len(docs) - 3: 0, len(docs) - 2: 1, len(docs) - 1: 2}
    frame = spark.createDataFrame([(i, t, "x", 1.0) for i, t in enumerate(docs)], "doc_id long, text string, item_id string, lcs double")
    bench = spark.createDataFrame([*items, (9, None), (10, ""), (None, "a b c")], "item_id long, text string").repartition(2)
    rows = D.find(frame.repartition(3), bench).collect()
    assert len(rows) == len(docs)
    assert {r.doc_id: r.item_id for r in rows if r.contaminated} == want
    kept = D.keep_clean(frame, bench)
    assert kept.columns == frame.columns
    assert {r.doc_id for r in kept.collect()} == set(range(len(docs))) - set(want)


def test_blocks_and_empty_tables(spark, monkeypatch):
    monkeypatch.setattr(D, "BLOCK_ITEMS", 1)
    text = " ".join(prose(1, 30))
    frame = spark.createDataFrame([(1, text), (2, " ".join(prose(2, 30)))], "doc_id long, text string")
    bench = spark.createDataFrame([(5, text, "no such thing"), (4, text, None)], "item_id long, text string, answer string")
    assert {r.doc_id: r.item_id for r in D.find(frame, bench).collect()} == {1: 4, 2: None}
    assert D.find(frame.where("doc_id > 5"), bench).count() == 0
    assert [r.item_id for r in D.find(frame, bench.where("item_id > 9")).collect()] == [None, None]


def test_axes_come_from_all_passages(spark, monkeypatch):
    """With the bounds of the former sample the axes were fitted on a tenth of these texts."""
    monkeypatch.setattr(D, "SAMPLE_TILES", 30, raising=False)
    monkeypatch.setattr(D, "SAMPLE_TEXTS", 20, raising=False)
    texts = [" ".join(prose(3000 + k, 10 + k)) for k in range(200)]
    space = D.latent_space(spark.createDataFrame([(t,) for t in texts], "text string").repartition(4))
    hashes, at = D.words(pa.array(texts))
    passages = np.concatenate([y for *_, y in D._passages(at, D.buckets(hashes), space.basis)])
    # in the space each axis is scaled by its singular value over all passages
    held = (passages**2).sum(axis=0)
    kept = space.values > 1e-3 * space.values.max()
    assert held[kept] == pytest.approx(np.full(kept.sum(), held.max()), rel=0.01)


def test_group_sums_beside_a_loop():
    rng = np.random.default_rng(5)
    values = rng.normal(size=(50, 3))
    for n in (0, 1, 15, 16, 17, 900):
        key = np.sort(rng.integers(0, 4, n))
        index = rng.integers(0, 50, n)
        keys, sums = D.group_sums(values, index, key)
        assert keys.tolist() == sorted(set(key.tolist()))
        for k, row in zip(keys, sums):
            assert row == pytest.approx(values[index[key == k]].sum(axis=0))


def test_word_sums_beside_a_loop():
    rng = np.random.default_rng(3)
    bucket = np.concatenate([rng.integers(0, 40, 300), np.full(2 * D.FREQUENT, 7), np.full(3 * D.FREQUENT, 900)])
    tile = rng.integers(0, 25, len(bucket))
    values = rng.integers(0, 9, (25, 4)).astype(np.float32)
    want = np.zeros((D.FEATURES, 4))
    np.add.at(want, bucket, values[tile])
    got, parts = np.zeros((D.FEATURES, 4)), list(D.word_sums(values, tile, bucket))
    for at, sums in parts:
        got[at] += sums
    assert len(parts) == 2 and (got == want).all()
    only = np.full(D.FREQUENT + 1, 7)
    (at, sums), = D.word_sums(values, tile[: len(only)], only)
    assert at.tolist() == [7] and (sums[0] == values[tile[: len(only)]].sum(axis=0)).all()
