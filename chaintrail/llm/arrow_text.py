"""Numpy views of Arrow text batches: words, word hashes and shingles without a Python loop over words."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 2_000_000

_rng = np.random.default_rng(20240917)
BYTE_CODES = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INVERSE = pow(_BASE, -1, 2**64)
SHINGLE_WEIGHTS = _rng.integers(1, 2**63, 16, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

#: The six ASCII spaces.
SPACE = np.zeros(256, dtype=bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True

_powers = {_BASE: np.ones(1, dtype=np.uint64), _BASE_INVERSE: np.ones(1, dtype=np.uint64)}


def _power_table(base: int, size: int) -> np.ndarray:
    """base ** i modulo 2 ** 64 for i below `size`, kept between calls."""
    table = _powers[base]
    if len(table) < size:
        steps = np.full(max(size, SLICE_BYTES + 1), base, dtype=np.uint64)
        steps[0] = 1
        table = _powers[base] = np.cumprod(steps, dtype=np.uint64)
    return table[:size]


def mix(h: np.ndarray) -> np.ndarray:
    """Finalise 64-bit hashes, so that every output bit depends on every input bit."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def slices(batch: pa.RecordBatch, column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of rows with about `limit` bytes of text; one long text stands alone."""
    if batch.num_rows == 0:
        return
    sizes = np.nan_to_num(np.asarray(pc.binary_length(batch.column(column)).to_numpy(zero_copy_only=False), dtype=float))
    group = (np.cumsum(sizes) // limit).astype(np.int64)
    cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), batch.num_rows]
    for start, end in zip(cuts, cuts[1:]):
        yield batch.slice(start, end - start)


def text_bytes(values: pa.Array, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all texts in a row, offsets of the texts); null counts as empty. `lower` folds A-Z only."""
    parts = [x.encode() if x is not None else b"" for x in values.to_pylist()]
    data = b"".join(parts)
    offsets = np.zeros(len(parts) + 1, dtype=np.int64)
    np.cumsum([len(p) for p in parts], out=offsets[1:])
    return np.frombuffer(data.lower() if lower else data, dtype=np.uint8), offsets


def word_bounds(buf: np.ndarray, offsets: np.ndarray, inside: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each maximal run of word bytes; a word never crosses two texts.

    Word bytes are all but ASCII spaces, or those marked in `inside` (a table of 256 flags).
    """
    word = ~SPACE[buf] if inside is None else inside[buf]
    if not len(buf):
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    first = word.copy()
    first[1:] &= ~word[:-1]
    cuts = offsets[:-1][offsets[:-1] < len(buf)]
    first[cuts] = word[cuts]
    last = word.copy()
    last[:-1] &= ~word[1:]
    ends = offsets[1:][offsets[1:] > 0] - 1
    last[ends] = word[ends]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def word_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each span's bytes, wherever it stands (polynomial over random byte codes)."""
    sums = np.zeros(len(buf) + 1, dtype=np.uint64)
    np.cumsum(BYTE_CODES[buf] * _power_table(_BASE, len(buf)), out=sums[1:])
    return mix((sums[ends] - sums[starts]) * _power_table(_BASE_INVERSE, len(buf) + 1)[starts])


def word_counts(starts: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Index of each text's first word, with the total at the end."""
    return np.searchsorted(starts, offsets)


def shingle_sets(values: pa.Array, k: int) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of each text's k-word shingles.

    A-Z are folded and words end at ASCII spaces. A text of fewer than k words is one
    shingle, one without words none. Hashes stand for shingles: among 20,000 shingles of a
    document two collide with a probability of about 1e-11.
    """
    buf, offsets = text_bytes(values, lower=True)
    starts, ends = word_bounds(buf, offsets)
    words = word_hashes(buf, starts, ends)
    n = len(words)
    rolled = np.zeros(max(n - k + 1, 0), dtype=np.uint64)
    for j in range(k):
        rolled += words[j : n - k + 1 + j] * SHINGLE_WEIGHTS[j] if len(rolled) else rolled
    rolled = mix(rolled + np.uint64(k))
    at = word_counts(starts, offsets)
    sets = []
    for a, b in zip(at[:-1], at[1:]):
        if b - a >= k:
            sets.append(np.unique(rolled[a : b - k + 1]))
        elif b > a:
            whole = (words[a:b] * SHINGLE_WEIGHTS[: b - a]).sum(dtype=np.uint64) + np.uint64(b - a)
            sets.append(mix(np.array([whole], dtype=np.uint64)))
        else:
            sets.append(np.zeros(0, dtype=np.uint64))
    return sets


def ragged_take(flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """flat[s : s + n] of each (s, n), one after the other."""
    total = int(lengths.sum())
    if not total:
        return flat[:0]
    ends = np.cumsum(lengths)
    at = np.arange(total) - np.repeat(ends - lengths - starts, lengths)
    return flat[at]
