"""Operator 5: language of a text by averaged hashed subword embeddings and a linear softmax.

Subwords are all runs of 2 to 4 bytes of the lower-cased text, with everything ASCII that is not
a letter folded to a space; their hashes pick rows of an embedding table. A text's embeddings
are averaged and go through a linear softmax. Both are trained by stochastic gradient descent
in numpy on a bounded sample of labelled rows (`SAMPLE_ROWS`, dealt evenly over the languages
by a hash of doc_id); a fifth of it sets the temperature and the rejection level. Prediction
covers whole texts: averaging commutes with the linear layer, so each bucket's logits are
looked up and summed.

Null texts and texts without a letter are `und` with score 0. With no labelled row all texts
are `und`. Ties go to the language that sorts first. Repeated rows are predicted alike, an empty
table gives none; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chaintrail.llm.arrow_text import mix, slices, text_bytes
from chaintrail.llm.registry import fold, query, table

BUCKETS, DIMENSIONS, GRAMS = 1 << 16, 16, (2, 3, 4)
SAMPLE_ROWS, EPOCHS, RATE = 4000, 4, 0.5
#: Longest text in the training sample, in characters; longer labelled rows are left to others.
SAMPLE_TEXT = 20_000
#: Share of right calibration rows that rejection may cost.
REJECTED = 0.001

_FOLD = np.arange(256, dtype=np.uint64)
_FOLD[:128] = 32
_FOLD[97:123] = np.arange(97, 123)


def buckets(buf: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each length of subwords: their buckets, and where each text's begin and end among them."""
    codes = _FOLD[buf]
    key = np.zeros(len(codes), dtype=np.uint64)
    for n in range(1, max(GRAMS) + 1):
        if len(codes) < n:
            break
        key = (key[: len(codes) - n + 1] << np.uint64(8)) | codes[n - 1 :]
        if n in GRAMS:
            ends = np.maximum(offsets[1:] - n + 1, offsets[:-1])
            picked = (mix(key + np.uint64(n)) & np.uint64(BUCKETS - 1)).astype(np.int32)
            yield picked, np.minimum(np.stack([offsets[:-1], ends]), len(picked))


@dataclass
class Model:
    languages: list[str]
    logits: np.ndarray  # (BUCKETS, languages), divided by the temperature
    bias: np.ndarray
    rejection: float

    def predict(self, values: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(index of the language, probability); index -1 for null and for texts without a letter."""
        texts = [x.lower() if x else "" for x in values.to_pylist()]
        lettered = np.array([any(map(str.isalpha, x)) for x in texts], dtype=bool)
        if not self.languages or not len(texts):
            return np.full(len(texts), -1), np.zeros(len(texts))
        sums, count = np.zeros((len(texts), len(self.languages))), np.zeros(len(texts))
        buf, offsets = text_bytes(pa.array(texts, pa.string()))
        for picked, (a, b) in buckets(buf, offsets):
            for c in range(len(self.languages)):
                total = np.concatenate([[0.0], np.cumsum(self.logits[:, c][picked], dtype=np.float64)])
                sums[:, c] += total[b] - total[a]
            count += b - a
        z = sums / np.maximum(count, 1)[:, None] + self.bias
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        best = p.argmax(axis=1)
        score = p[np.arange(len(p)), best]
        return np.where(lettered, best, -1), np.where(lettered, score, 0.0)


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max())
    return e / e.sum()


def train(rows: list[tuple[str, str]]) -> Model:
    """`rows`: (text, language). Every fifth row calibrates."""
    languages = sorted({lang for _, lang in rows})
    if not languages:
        return Model([], np.zeros((BUCKETS, 0), np.float32), np.zeros(0), 0.0)
    examples = []
    for text, lang in rows:
        buf, offsets = text_bytes(pa.array([text.lower()]))
        picked = [p for p, _ in buckets(buf, offsets)]
        if picked:
            ids, n = np.unique(np.concatenate(picked), return_counts=True)
            examples.append((ids, (n / n.sum()).astype(np.float32), languages.index(lang)))
    rng = np.random.default_rng(11)
    table_ = rng.normal(0, 0.1, (BUCKETS, DIMENSIONS)).astype(np.float32)
    weights = rng.normal(0, 0.1, (DIMENSIONS, len(languages))).astype(np.float32)
    bias = np.zeros(len(languages), np.float32)
    fit = [e for i, e in enumerate(examples) if i % 5]
    held = [e for i, e in enumerate(examples) if i % 5 == 0]
    fit = fit or held
    for epoch in range(EPOCHS):
        for step, i in enumerate(rng.permutation(len(fit))):
            ids, share, lang = fit[i]
            rate = RATE * (1 - (epoch + step / len(fit)) / EPOCHS) + 0.01
            hidden = share @ table_[ids]
            grad = _softmax(hidden @ weights + bias)
            grad[lang] -= 1
            back = weights @ grad
            weights -= rate * np.outer(hidden, grad)
            bias -= rate * 0.1 * grad
            # averaging makes single rows' gradients small: they move by their share of the text's mass
            table_[ids] -= rate * 50 * share[:, None] * back
    logits = table_ @ weights
    z = np.array([share @ logits[ids] + bias for ids, share, _ in held or fit])
    right = np.array([lang for _, _, lang in held or fit])

    def probabilities(temperature: float) -> np.ndarray:
        e = np.exp((z - z.max(axis=1, keepdims=True)) / temperature)
        return e / e.sum(axis=1, keepdims=True)

    def loss(t: float) -> float:
        return float(-np.log(probabilities(t)[np.arange(len(z)), right] + 1e-12).sum())

    temperature = min(np.geomspace(0.05, 5, 60), key=loss)
    p = probabilities(temperature)
    good = p.max(axis=1)[p.argmax(axis=1) == right]
    # never more than an even chance: what is likelier right than wrong stays
    rejection = min(0.5, float(np.quantile(good, REJECTED))) if len(good) else 0.0
    return Model(languages, (logits / temperature).astype(np.float32), bias / temperature, rejection)


def sample(labelled: DataFrame, rows: int = SAMPLE_ROWS) -> list[tuple[str, str]]:
    """About `rows` rows (text, lang) with a letter, as many of each language, in the order of a hash of doc_id."""
    usable = labelled.where(F.col("lang").isNotNull() & (F.length("text") <= SAMPLE_TEXT) & F.col("text").rlike(r"\p{L}"))
    counts = {r.lang: r["count"] for r in usable.groupBy("lang").count().collect()}
    if not counts:
        return []
    each = max(1, rows // len(counts))
    share: Column = F.lit(0.0)
    for lang, n in sorted(counts.items()):
        share = F.when(F.col("lang") == lang, F.lit(each / n)).otherwise(share)
    draw = F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    picked = usable.where(draw < share).select("text", "lang", draw.alias("draw"), "doc_id")
    return [(r.text, r.lang) for r in picked.orderBy("draw", "doc_id", "text").limit(2 * rows).collect()]


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score, rejected."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    spread = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = spread.value
        names = np.array([*m.languages, "und"], dtype=object)
        for batch in batches:
            for part in slices(batch):
                best, score = m.predict(part.column("text"))
                rejected = (best < 0) | (score < m.rejection)
                columns = [part.column("doc_id"), pa.array(names[best], pa.string()), pa.array(score), pa.array(rejected)]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "lang_pred", "score", "rejected"])

    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, f"doc_id {kind}, lang_pred string, score double, rejected boolean")


def keep_recognised(docs: DataFrame, model: Model) -> DataFrame:
    """Rows of `docs` whose language is not rejected, columns as they are."""
    spread = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = spread.value
        for batch in batches:
            for part in slices(batch):
                best, score = m.predict(part.column("text"))
                yield part.filter(pa.array((best >= 0) & (score >= m.rejection)))

    return docs.mapInArrow(run, docs.schema)


def learned(docs: DataFrame) -> Model:
    """A model of the rows outside the held-out quarter."""
    return train(sample(docs.where(fold("doc_id", 4) != 2).select("doc_id", "text", "lang")))


@query("op5_language_id")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = docs.select("doc_id", "text").withColumn("held_out", fold("doc_id", 4) == 2)
    predicted = predict(held.select(F.struct("doc_id", "held_out").alias("doc_id"), "text"), learned(docs))
    return predicted.select("doc_id.doc_id", "doc_id.held_out", "lang_pred", "score", "rejected")
