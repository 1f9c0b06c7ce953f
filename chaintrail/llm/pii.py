"""Operator 9: personal data by fixed patterns and a linear-chain conditional random field.

The base finds emails, IP addresses, cards and phone numbers exactly. The field adds `secret`
spans (passwords, keys, tokens) over word-shape features. It is trained from a small table made
by `labelled_table`, by gradient ascent on the conditional likelihood with forward-backward in
numpy, and decoded by Viterbi over all lines of a batch at once. A word of letters alone has
one fixed feature vector; `Field.fit` proves that such words cost any label but O more than
transitions can win back, so lines made of them only are all O and need no decoding.

Spans count code points of the text as it is, end exclusive. Added spans that touch a base span
are dropped. Null and empty texts have no spans. Repeated rows are treated alike, an empty table
gives none; other columns are not read.
"""

from __future__ import annotations

import hashlib
import random
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chaintrail.llm.arrow_text import slices, text_bytes, word_bounds
from chaintrail.llm.registry import query, table

#: Fixed kinds and patterns. Look-behinds only keep long runs from being tried again at every digit.
KINDS = ("email", "ip", "card", "phone", "secret")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile("[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end), by kind and start."""
    found = []
    at, free = text.find("@"), 0
    while at >= 0:
        start = at
        while start > free and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at) if start < at else None
        if m:
            found.append((0, start, m.end()))
            free = m.end()
        at = text.find("@", max(at + 1, free))
    if DIGIT.search(text):
        for m in IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m[0].split(".")):
                found.append((1, m.start(), m.end()))
        for m in CARD.finditer(text):
            if m.end() - m.start() >= 13:
                digits = m[0].replace(" ", "").replace("-", "")
                if 13 <= len(digits) <= 19 and luhn(digits):
                    found.append((2, m.start(), m.end()))
        if "+" in text:
            for m in PHONE.finditer(text):
                if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
                    found.append((3, m.start(), m.end()))
    return found


CUES = re.compile(r"(?i)(passw(or)?d|pwd|secret|token|api[_-]?key|access[_-]?key)")
LABELS = ("O", "CUE", "SECRET")
FEATURES = ("bias", "plain", "digits only", "digits and letters", "upper and digits, long", "hex, long", "cue word", "cue and value", "ends in colon or equals", "long", "other", "address", "parted number")
#: Signs around a word that are no part of it.
AROUND = ".,;!?\"'()[]<>#*"


def shape(word: str) -> list[int]:
    """Word-shape features of a word that is not plain."""
    core = word.strip(AROUND)
    letters, digits = any(c.isalpha() for c in core), any(c.isdigit() for c in core)
    cue = CUES.search(core)
    value = re.split("[=:]", core)[-1] if re.search("[=:]", core) else core
    return [
        1, 0, int(digits and not letters), int(digits and letters),
        int(bool(re.fullmatch(r"[A-Z0-9]{16,}", value)) and any(c.isdigit() for c in value) and any(c.isupper() for c in value)),
        int(bool(re.fullmatch(r"[0-9a-fA-F]{12,}", value)) and any(c.isalpha() for c in value) and digits),
        int(bool(cue)), int(bool(cue) and bool(re.search(r"[=:].{6,}", core))),
        int(core.endswith((":", "="))), int(len(core) >= 12), int(not letters and not digits),
        int("://" in core or core.lower().startswith("www.")),
        int(bool(re.fullmatch(r"([^=:]*[=:])?v?[0-9]+([.:/-][0-9]+)+", core))),
    ]


PLAIN = [1, 1, *[0] * (len(FEATURES) - 2)]


def labelled_table(rows: int = 200) -> list[list[tuple[str, int]]]:
    """Sentences of (word, label), from templates: credentials in running text; numbers, addresses, versions, dates
    and settings that are none."""
    rng = random.Random(4)
    hexes, uppers, mixed = "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "abcdefghijkmnpqrstuvwxyz0123456789"

    def pick(signs: str, n: int) -> str:
        return "".join(rng.choice(signs) for _ in range(n - 1)) + rng.choice("23456789") + ("" if signs != hexes else "a")

    out = []
    for i in range(rows):
        words = [(("".join(rng.choice("aeinorst") for _ in range(rng.randint(2, 9)))), 0) for _ in range(rng.randint(3, 9))]
        at = rng.randint(0, len(words))
        cue = rng.choice(["password", "secret", "token", "api_key", "passwd", "access_key"])
        add = [
            [(f"{cue}={pick(hexes, 17)}", 2)],
            [("AKIA" + pick(uppers, 16), 2)],
            [(f"{cue}:", 1), (pick(mixed, rng.randint(8, 14)), 2)],
            [(str(rng.randint(1, 10**9)), 0), (f"{rng.randint(1, 255)}.{rng.randint(1, 255)}.1.{rng.randint(1, 255)}", 0)],
            [(f"x{rng.randint(1, 99)}@a.com", 0), ("+1", 0), (f"({rng.randint(200, 999)})", 0), (f"555-{rng.randint(1000, 9999)}", 0)],
            [(str(rng.randint(10**15, 10**16)), 0), ("note:", 0), (f"b{rng.randint(1, 99)}", 0), ("|", 0), (f"x={rng.randint(1, 9)}", 0)],
            [(cue, 0), (rng.choice(["stays", "is"]), 0), ("***", 0), (f'style="w{rng.randint(1, 99)}"', 0)],
            [(f"https://{pick(mixed, 6)}.example/{pick(mixed, 9)}?id={rng.randint(1, 10**6)}&page={rng.randint(1, 9)}", 0), (f"www.{pick(mixed, 8)}.org", 0)],
            [(f"version={rng.randint(0, 9)}.{rng.randint(0, 20)}.{rng.randint(0, 9)}", 0), (f"20{rng.randint(10, 24)}-0{rng.randint(1, 9)}-1{rng.randint(0, 9)}", 0), (f"1{rng.randint(0, 9)}:{rng.randint(10, 59)}", 0)],
            [(f"{words[0][0]}_{words[1][0]}={rng.randint(1, 10**5)}", 0), (f"{words[0][0]}:", 0), (f"{words[1][0]}{rng.randint(1, 99)}", 0), (f"https://{words[1][0]}.example/{cue}/{rng.randint(1, 99)}", 0)],
        ][i % 10]
        out.append(words[:at] + add + words[at:])
    return out


def is_plain(word: str) -> bool:
    return not re.search(r"[0-9=:_]", word)


class Field:
    """Weights of features by label and of label pairs."""

    def __init__(self):
        self.emit = np.zeros((len(FEATURES), len(LABELS)))
        self.move = np.zeros((len(LABELS), len(LABELS)))
        self.skip_plain = False

    def fit(self, sentences: list[list[tuple[str, int]]], rounds: int = 300, rate: float = 0.5, decay: float = 1e-3) -> Field:
        longest, k = max(map(len, sentences)), len(LABELS)
        x = np.zeros((len(sentences), longest, len(FEATURES)))
        y, mask = np.zeros((len(sentences), longest), dtype=int), np.zeros((len(sentences), longest), dtype=bool)
        for i, s in enumerate(sentences):
            for j, (word, label) in enumerate(s):
                x[i, j], y[i, j], mask[i, j] = (PLAIN if is_plain(word) else shape(word)), label, True
        gold = np.eye(k)[y] * mask[..., None]
        gold_pairs = np.einsum("ita,itb->ab", gold[:, :-1], gold[:, 1:])
        for _ in range(rounds):
            e = np.where(mask[..., None], x @ self.emit, 0)
            forward, backward = np.zeros_like(e), np.zeros_like(e)
            forward[:, 0] = e[:, 0]
            for t in range(1, longest):
                step = np.logaddexp.reduce(forward[:, t - 1, :, None] + self.move, axis=1) + e[:, t]
                forward[:, t] = np.where(mask[:, t, None], step, forward[:, t - 1])
            for t in range(longest - 2, -1, -1):
                step = np.logaddexp.reduce(self.move + (e[:, t + 1] + backward[:, t + 1])[:, None, :], axis=2)
                backward[:, t] = np.where(mask[:, t + 1, None], step, 0)
            norm = np.logaddexp.reduce(forward[:, -1], axis=1)
            single = np.exp(forward + backward - norm[:, None, None]) * mask[..., None]
            pairs = forward[:, :-1, :, None] + self.move + (e + backward)[:, 1:, None, :] - norm[:, None, None, None]
            pairs = (np.exp(np.minimum(pairs, 0)) * mask[:, 1:, None, None]).sum(axis=(0, 1))
            self.emit += rate * (np.einsum("itf,itk->fk", x, gold - single) / len(sentences) - decay * self.emit)
            self.move += rate * ((gold_pairs - pairs) / len(sentences) - decay * self.move)
        plain = np.array(PLAIN) @ self.emit
        # r plain words under other labels lose r emission gaps, and r + 1 <= 2 r transitions replace those from O to O
        gain = 2 * max(0.0, float(self.move.max() - self.move[0, 0]))
        self.skip_plain = bool(plain[0] - plain[1:].max() > gain)
        return self

    def viterbi(self, emissions: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Best labels (sequences x positions) of padded sequences."""
        n, longest, k = emissions.shape
        best, back = emissions[:, 0].copy(), np.zeros((n, longest, k), dtype=np.int8)
        for t in range(1, longest):
            through = best[:, :, None] + self.move
            back[:, t] = through.argmax(axis=1)
            live = (t < lengths)[:, None]
            best = np.where(live, through.max(axis=1) + emissions[:, t], best)
        labels = np.zeros((n, longest), dtype=np.int8)
        last = best.argmax(axis=1)
        for t in range(longest - 1, -1, -1):
            inside = t < lengths
            labels[:, t] = np.where(inside, last, 0)
            if t:
                last = np.where(inside, back[np.arange(n), t, last], last)
        return labels


@lru_cache(maxsize=1)
def field() -> Field:
    """Fitted once in each worker: the table and the start are fixed, so all workers agree."""
    return Field().fit(labelled_table())


_MARKED = np.zeros(256, dtype=bool)
_MARKED[[*range(48, 58), 61, 58, 95]] = True
#: Cells (words x sequences) of one decoding step.
CELLS = 400_000


def field_spans(values: pa.Array) -> dict[int, list[tuple[int, int]]]:
    """Text number -> byte spans of secrets."""
    model = field()
    buf, offsets = text_bytes(values)
    starts, ends = word_bounds(buf, offsets)
    if not len(starts):
        return {}
    marks = np.concatenate([[0], np.cumsum(_MARKED[buf])])
    special = marks[ends] > marks[starts]
    doc = np.searchsorted(offsets, starts, "right") - 1
    feeds = np.concatenate([[0], np.cumsum(buf == 10)])
    line_start = np.ones(len(starts), dtype=bool)
    line_start[1:] = (feeds[starts[1:]] > feeds[starts[:-1]]) | (doc[1:] != doc[:-1])
    first = np.flatnonzero(line_start)
    length = np.diff(np.append(first, len(starts)))
    some = np.add.reduceat(special, first) > 0 if model.skip_plain else np.ones(len(first), dtype=bool)
    lines = np.flatnonzero(some)
    lines = lines[np.argsort(length[lines], kind="stable")]
    plain = np.array(PLAIN) @ model.emit
    data, found, at = buf.tobytes(), {}, 0
    while at < len(lines):
        stop = at + 1
        while stop < len(lines) and (stop - at + 1) * length[lines[stop]] <= CELLS:
            stop += 1
        group, at = lines[at:stop], stop
        size = length[group]
        e = np.broadcast_to(plain, (len(group), int(size.max()), len(LABELS))).copy()
        words = np.repeat(first[group], size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        row, col = np.repeat(np.arange(len(group)), size), words - np.repeat(first[group], size)
        hit = np.flatnonzero(special[words])
        for h in hit.tolist():
            w = words[h]
            e[row[h], col[h]] = np.array(shape(data[starts[w] : ends[w]].decode())) @ model.emit
        labels = model.viterbi(e, size)
        for h in np.flatnonzero(labels[row, col] == 2).tolist():
            w = words[h]
            word = data[starts[w] : ends[w]]
            core = word.strip(AROUND.encode())
            if core:
                start = int(starts[w]) + word.index(core) - int(offsets[doc[w]])
                found.setdefault(int(doc[w]), []).append((start, start + len(core)))
    return found


def all_spans(values: pa.Array) -> list[tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]]:
    """(base spans, added spans) of each text."""
    added = field_spans(values)
    out = []
    for i, text in enumerate(values.to_pylist()):
        base = base_spans(text) if text else []
        more = []
        if i in added:
            raw = text.encode()
            for a, b in sorted(set(added[i])):
                start = len(raw[:a].decode())
                span = (4, start, start + len(raw[a:b].decode()))
                if not any(s < span[2] and span[1] < e for _, s, e in base):
                    more.append(span)
        out.append((base, more))
    return out


def _joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in sorted(spans))


def find(docs: DataFrame) -> DataFrame:
    """doc_id, counts of base spans by kind, base_sha256, spans (base and added, kind:start:end by kind and start)."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"]
        for batch in batches:
            for part in slices(batch):
                got = all_spans(part.column("text"))
                columns = [pa.array([sum(k == j for k, *_ in base) for base, _ in got], pa.int64()) for j in range(4)]
                digest = [hashlib.sha256(_joined(base).encode()).hexdigest() for base, _ in got]
                every = [_joined(base + more) for base, more in got]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *columns, pa.array(digest, pa.string()), pa.array(every, pa.string())], names)

    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    schema = f"doc_id {kind}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"
    return rows.mapInArrow(run, schema)


def mask(docs: DataFrame) -> DataFrame:
    """Rows of `docs` with every span in `text` replaced by its kind in brackets; `n_chars`, if there, follows."""

    def masked(text: str, spans: list[tuple[int, int, int]]) -> str:
        out, at = [], 0
        for k, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
            if a >= at:
                out += [text[at:a], f"[{KINDS[k].upper()}]"]
            elif b > at:  # overlaps the span before: its rest goes with it
                pass
            at = max(at, b)
        return "".join([*out, text[at:]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                texts = part.column("text").to_pylist()
                new = [masked(t, base + more) if base or more else t for t, (base, more) in zip(texts, all_spans(part.column("text")))]
                columns = {name: part.column(name) for name in part.schema.names}
                columns["text"] = pa.array(new, part.schema.field("text").type)
                if "n_chars" in columns:
                    kept = zip(columns["n_chars"].to_pylist(), texts, new)
                    columns["n_chars"] = pa.array([n if t == m else len(m) for n, t, m in kept], part.schema.field("n_chars").type)
                yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    return docs.mapInArrow(run, docs.schema)


@query("op9_pii_field")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find(table(spark, sf_dir, "documents"))
