"""Operators 2 and 5: held-out accuracy on the given tables, and awkward rows."""

import random

import pyarrow as pa

from chaintrail.llm import language_id as L
from chaintrail.llm import toxicity as X

SF = "/root/testdata/sf0.01"


def test_language_on_held_out_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang")
    rows = L.op5(spark, SF).join(docs, "doc_id").where("held_out").collect()
    assert sum(r.lang == r.lang_pred for r in rows) >= 0.97 * len(rows) > 100
    assert sum(r.rejected for r in rows) <= 0.02 * len(rows)


def test_language_of_awkward_rows(spark):
    schema = "doc_id long, text string, lang string, score double"
    rows = [(i, t, lang, 0.0) for i, (t, lang) in enumerate([("the cat sat on the mat " * 5, "en"), ("der hund und die katze " * 5, "de")] * 30)]
    model = L.learned(spark.createDataFrame(rows, schema))
    odd = [(1, None, "en", 0.0), (2, "", None, 0.0), (3, "123 !!", "x", 0.0), (4, "the mat " * 40_000, None, 0.0), (4, "the mat " * 40_000, None, 0.0)]
    frame = spark.createDataFrame(odd, schema)
    got = sorted((r.doc_id, r.lang_pred) for r in L.predict(frame, model).collect())
    assert got == [(1, "und"), (2, "und"), (3, "und"), (4, "en"), (4, "en")]
    assert [r.doc_id for r in L.keep_recognised(frame, model).collect()] == [4, 4]
    nothing = L.learned(spark.createDataFrame([], schema))
    assert {r.lang_pred for r in L.predict(frame, nothing).collect()} == {"und"}


def test_segments_are_maximal():
    """Every segment beside the recursive definition: the best segment, then the rest left and right of it."""
    rng = random.Random(6)

    def brute(scores, shift=0):
        best = None
        for i in range(len(scores)):
            for j in range(i + 1, len(scores) + 1):
                s = round(sum(scores[i:j]), 9)
                if s > 0 and (best is None or (s, i - j) > (best[2], best[0] - best[1])):
                    best = (i, j, s)
        if best is None:
            return []
        i, j, s = best
        return brute(scores[:i], shift) + [(shift + i, shift + j, s)] + brute(scores[j:], shift + j)

    import numpy as np

    for _ in range(200):
        scores = [rng.uniform(-2, 2) for _ in range(rng.randint(0, 14))]
        got = [(a, b, round(s, 9)) for a, b, s in X.segments(np.array(scores))]
        assert [g[:2] for g in got] == [b[:2] for b in brute(scores)]


def test_toxicity_learns_and_finds_passages(spark):
    rng = random.Random(9)
    words = [f"w{i}" for i in range(300)]
    docs, labels = [], []
    for i in range(600):
        text = [rng.choice(words) for _ in range(60)]
        if i % 4 == 0:
            text[rng.randrange(60)] = "Vile"
        docs.append((i, " ".join(text), "x"))
        labels.append((i, int(i % 4 == 0), 1))
    frame, known = spark.createDataFrame(docs, "doc_id long, text string, toxic string"), spark.createDataFrame(labels, "doc_id long, toxic int, quality int")
    model = X.train(frame.where("doc_id < 400"), known)
    test = [(401, "w1 vile w2", 0), (402, "w1 w2 " * 30_000, 0), (403, None, 0), (404, "", 0), (401, "w1 vile w2", 0)]
    got = {r.key: r for r in X.score(spark.createDataFrame(test, "key long, text string, toxic int"), model).collect()}
    assert got[401].score > 0.5 > max(got[k].score for k in (402, 403, 404))
    assert [(p.start, p.end) for p in got[401].passages] == [(3, 7)]
    empty = X.train(frame.limit(0), known)
    assert empty is None and X.score(spark.createDataFrame(test, "key long, text string, toxic int"), None).first().score == 0.5


def test_passages_of_null():
    model = X.Model(X.np.zeros(X.BUCKETS), 1.0, 1.0, X.np.zeros(3))
    assert list(model.passages(pa.array([None, ""], pa.string()))) == [[], []]
