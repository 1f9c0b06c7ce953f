"""Runs of words as byte spans of one buffer, and an open-addressed table that interns them.

Words of a batch are laid out with one space between neighbours, so that every run of words
of a text is one contiguous span. Spans get their xxhash64, computed with numpy for all spans
of a length at once, and are interned in a table of slots: a span probes from the slot its
hash names, and joins a slot only after its bytes were compared with the slot's first span.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import xxhash

from chaintrail.llm.arrow_text import ragged_take

#: The five primes of xxhash64.
P1, P2, P3, P4, P5 = (
    np.uint64(11400714785074694791),
    np.uint64(14029467366897019727),
    np.uint64(1609587929392839161),
    np.uint64(9650029242287828579),
    np.uint64(2870177450012600261),
)
#: Longer spans are hashed and compared one by one.
LONG = 96


def joined_words(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, starts, ends) of the same words with exactly one space after each."""
    lengths = ends - starts
    stops = np.cumsum(lengths + 1)
    out = np.full(int(stops[-1]) if len(stops) else 0, 32, dtype=np.uint8)
    begin = stops - lengths - 1
    flat = ragged_take(buf, starts, lengths)
    at = np.arange(len(flat)) + np.repeat(np.arange(len(lengths)), lengths)
    out[at] = flat
    return out, begin, begin + lengths


def runs(begin: np.ndarray, end: np.ndarray, group: np.ndarray, longest: int, first: int = 0, stop: int | None = None):
    """(index of the first word, number of words, start, end) of every run of 1 to `longest` words that stays in its group.

    `group` never falls; only runs that begin at words `first` to `stop` are listed.
    """
    stop = len(begin) if stop is None else stop
    word, size = [], []
    for n in range(1, longest + 1):
        at = np.arange(first, min(stop, len(begin) - n + 1))
        at = at[group[at] == group[at + n - 1]]
        word.append(at)
        size.append(np.full(len(at), n))
    word, size = np.concatenate(word), np.concatenate(size)
    return word, size, begin[word], end[word + size - 1]


def windows(buf: np.ndarray) -> np.ndarray:
    """The eight bytes from each place of `buf` on as one little-endian number, zeros beyond the end."""
    padded = np.concatenate([buf, np.zeros(8, dtype=np.uint8)])
    return np.ndarray((len(buf) + 1,), dtype="<u8", buffer=padded, strides=(1,)).copy()


def _left(x: np.ndarray, bits: int) -> np.ndarray:
    return (x << np.uint64(bits)) | (x >> np.uint64(64 - bits))


def _round(acc: np.ndarray, lane: np.ndarray) -> np.ndarray:
    return _left(acc + lane * P2, 31) * P1


def xxhash64(eight: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
    """xxhash64 (seed 0) of all spans of one length, from the `windows` of their buffer."""
    at = 0
    with np.errstate(over="ignore"):
        if length >= 32:
            lanes = [P1 + P2, P2, np.uint64(0), np.uint64(0) - P1]
            lanes = [np.full(len(starts), v, dtype=np.uint64) for v in lanes]
            while at + 32 <= length:
                lanes = [_round(v, eight[starts + (at + 8 * j)]) for j, v in enumerate(lanes)]
                at += 32
            h = _left(lanes[0], 1) + _left(lanes[1], 7) + _left(lanes[2], 12) + _left(lanes[3], 18)
            for v in lanes:
                h = (h ^ _round(np.uint64(0), v)) * P1 + P4
        else:
            h = np.full(len(starts), P5, dtype=np.uint64)
        h = h + np.uint64(length)
        while at + 8 <= length:
            h = _left(h ^ _round(np.uint64(0), eight[starts + at]), 27) * P1 + P4
            at += 8
        if at < length:
            rest = eight[starts + at]
            if at + 4 <= length:
                h = _left(h ^ ((rest & np.uint64(0xFFFFFFFF)) * P1), 23) * P2 + P3
                rest = rest >> np.uint64(32)
                at += 4
            while at < length:
                h = _left(h ^ ((rest & np.uint64(0xFF)) * P5), 11) * P1
                rest = rest >> np.uint64(8)
                at += 1
        h = (h ^ (h >> np.uint64(33))) * P2
        h = (h ^ (h >> np.uint64(29))) * P3
    return h ^ (h >> np.uint64(32))


def _crc_table() -> np.ndarray:
    """Remainders of all bytes under the reversed polynomial 0xEDB88320."""
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(0xEDB88320), table >> 1).astype(np.uint32)
    return table


CRC = _crc_table()


def crc32(eight: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
    """crc32 of all spans of one length, from the `windows` of their buffer."""
    crc = np.full(len(starts), 0xFFFFFFFF, dtype=np.uint32)
    for at in range(0, length, 8):
        rest = eight[starts + at]
        for j in range(min(8, length - at)):
            crc = CRC[(crc ^ (rest >> np.uint64(8 * j)).astype(np.uint32)).astype(np.uint8)] ^ (crc >> np.uint32(8))
    return crc ^ np.uint32(0xFFFFFFFF)


def _differs(data: bytes, eight: np.ndarray, a: np.ndarray, b: np.ndarray, length: int) -> np.ndarray:
    """Which spans of one length, starting at `a` and `b`, hold different bytes."""
    if length > LONG:
        return np.array([data[x : x + length] != data[y : y + length] for x, y in zip(a.tolist(), b.tolist())], dtype=bool)
    out = np.zeros(len(a), dtype=bool)
    whole, rest = divmod(length, 8)
    for j in range(whole):
        out |= eight[a + 8 * j] != eight[b + 8 * j]
    if rest:
        out |= ((eight[a + 8 * whole] ^ eight[b + 8 * whole]) << np.uint64(64 - 8 * rest)) != 0
    return out


def _by_length(lengths: np.ndarray) -> Iterator[np.ndarray]:
    """Indices of the spans of each length."""
    order = np.argsort(lengths.astype(np.uint16) if len(lengths) and lengths.max() < 65536 else lengths, kind="stable")
    cuts = np.flatnonzero(np.diff(lengths[order])) + 1
    yield from np.split(order, cuts)


class SpanTable:
    """Distinct spans of one buffer. `slot` is each occurrence's slot; `first` the occurrence that claimed each slot, or -1."""

    def __init__(self, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray):
        self.buf, self.starts, self.ends = buf, starts, ends
        self.data = buf.tobytes()
        self.eight = eight = windows(buf)
        self.slot = np.empty(len(starts), dtype=np.int64)
        regions, base = [], 0
        for some in _by_length(ends - starts) if len(starts) else ():
            begin, length = starts[some], int(ends[some[0]] - starts[some[0]])
            if length > LONG:
                keys = np.array([xxhash.xxh64_intdigest(self.data[a : a + length]) for a in begin.tolist()], dtype=np.uint64)
            else:
                keys = xxhash64(eight, begin, length)
            slots, claimed = self._intern(eight, keys, begin, length)
            self.slot[some] = base + slots
            regions.append(np.where(claimed >= 0, some[claimed], -1))
            base += len(claimed)
        self.first = np.concatenate(regions) if regions else np.zeros(0, dtype=np.int64)

    def _intern(self, eight: np.ndarray, keys: np.ndarray, begin: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
        """(slot of each span, span that claimed each slot) of a region for the spans of one length."""
        size = 1 << max(1, (2 * len(keys) - 1).bit_length())
        claimed = np.full(size, -1, dtype=np.int64)
        slots = (keys & np.uint64(size - 1)).astype(np.int64)
        waiting = np.arange(len(keys))
        while len(waiting):
            at = slots[waiting]
            free = claimed[at] < 0
            claimed[at[free]] = waiting[free]  # of several, the last one holds the slot
            owner = claimed[at]
            same = keys[owner] == keys[waiting]
            met = np.flatnonzero(same & (owner != waiting))
            same[met[_differs(self.data, eight, begin[owner[met]], begin[waiting[met]], length)]] = False
            waiting = waiting[~same]
            slots[waiting] = (slots[waiting] + 1) & (size - 1)
        return slots, claimed

    def counts(self) -> np.ndarray:
        """Occurrences of each slot."""
        return np.bincount(self.slot, minlength=len(self.first))

    def crcs(self, used: np.ndarray) -> np.ndarray:
        """crc32 of the bytes of the given slots."""
        own = self.first[used]
        out = np.empty(len(own), dtype=np.uint32)
        for some in _by_length(self.ends[own] - self.starts[own]) if len(own) else ():
            begin, length = self.starts[own[some]], int(self.ends[own[some[0]]] - self.starts[own[some[0]]])
            if length > LONG:
                out[some] = [zlib.crc32(self.data[a : a + length]) for a in begin.tolist()]
            else:
                out[some] = crc32(self.eight, begin, length)
        return out

    def spans(self, used: np.ndarray) -> list[bytes]:
        """Bytes of the given slots."""
        own = self.first[used]
        return [self.data[a:b] for a, b in zip(self.starts[own].tolist(), self.ends[own].tolist())]
