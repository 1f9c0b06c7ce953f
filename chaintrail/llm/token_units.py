"""Encoding text with the tokenizers library, once for each distinct unit of a worker's texts.

A unit is a piece of text that the tokenizer treats alike wherever it stands, cut at ASCII
spaces. Units are found with numpy over a whole batch; each worker keeps the ids of the units
it has met (up to a bound) and hands only new ones to the library, with line feeds between them.
Texts for which cutting is not proven right go to the library whole. Units are told apart by a
64-bit hash and their length: among ten million units two collide with a chance of 3e-6.
"""

from __future__ import annotations

import os
from collections.abc import Callable

import numpy as np
import pyarrow as pa

from chaintrail.llm.arrow_text import SPACE, ragged_take, text_bytes, word_bounds, word_hashes

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

KNOWN_UNITS, JOINED = 1_000_000, 200


class UnitEncoder:
    """`spaced`: spaces count, and a unit may begin with one. `whole`: texts that must not be cut."""

    def __init__(self, tokenizer, spaced: bool, whole: Callable[[str], bool]):
        self.tokenizer, self.spaced, self.whole = tokenizer, spaced, whole
        self._forget()

    def _forget(self) -> None:
        self.keys = np.zeros(0, dtype=np.uint64)
        self.starts = np.zeros(0, dtype=np.int64)
        self.lengths = np.zeros(0, dtype=np.int64)
        self.ids = np.zeros(0, dtype=np.uint32)

    def one(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype=np.uint32)

    def _cut(self, buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Units of all texts: runs without spaces and, if `spaced`, a space before them, and what is left of the spaces."""
        starts, ends = word_bounds(buf, offsets)
        if not self.spaced:
            return starts, ends
        text_start = np.zeros(len(buf) + 1, dtype=bool)
        text_start[offsets] = True
        with_space = (starts > 0) & ~text_start[starts]
        with_space[with_space] = buf[starts[with_space] - 1] == 32
        begin = starts - with_space
        covered = np.zeros(len(buf) + 1, dtype=np.int8)
        np.add.at(covered, begin, 1)
        np.add.at(covered, ends, -1)
        left = np.cumsum(covered[:-1]) == 0  # spaces that no unit has taken
        first = left.copy()
        first[1:] &= ~left[:-1]
        cuts = offsets[:-1][offsets[:-1] < len(buf)]
        first[cuts] = left[cuts]
        last = left.copy()
        last[:-1] &= ~left[1:]
        stops = offsets[1:][offsets[1:] > 0] - 1
        last[stops] = left[stops]
        a, b = np.flatnonzero(first), np.flatnonzero(last) + 1
        # before a run that took no space, the last of several spaces stands alone
        unspaced = np.zeros(len(buf) + 1, dtype=bool)
        unspaced[begin[~with_space]] = True
        split = unspaced[b] & ~text_start[b] & (b - a > 1)
        begin = np.concatenate([begin, a, b[split] - 1])
        ends = np.concatenate([ends, np.where(split, b - 1, b), b[split]])
        order = np.argsort(begin, kind="stable")
        return begin[order], ends[order]

    def _learn(self, keys: np.ndarray, pieces: list[str]) -> None:
        """Encode new units, `JOINED` at a time with line feeds between; offsets tell whose a token is."""
        flats, owners = [], []
        alone = [i for i, p in enumerate(pieces) if p.isspace()]
        rest = [i for i, p in enumerate(pieces) if not p.isspace()] if alone else list(range(len(pieces)))
        for i in alone:
            ids = self.one(pieces[i])
            flats.append(ids)
            owners.append(np.full(len(ids), i))
        for at in range(0, len(rest), JOINED):
            some = rest[at : at + JOINED]
            starts = np.cumsum([0] + [len(pieces[i]) + 1 for i in some])
            got = self.tokenizer.encode("\n".join([pieces[i] for i in some]), add_special_tokens=False)
            begin = np.array([o[0] for o in got.offsets], dtype=np.int64)
            owner = np.searchsorted(starts, begin, "right") - 1
            inside = begin < starts[owner + 1] - 1  # not a line feed
            flats.append(np.array(got.ids, dtype=np.uint32)[inside])
            owners.append(np.array(some, dtype=np.int64)[owner[inside]])
        flat, owner = np.concatenate(flats), np.concatenate(owners)
        order = np.argsort(owner, kind="stable")
        lengths = np.bincount(owner, minlength=len(keys))
        at = np.searchsorted(self.keys, keys)  # both are sorted
        self.keys = np.insert(self.keys, at, keys)
        self.starts = np.insert(self.starts, at, np.cumsum(lengths) - lengths + len(self.ids))
        self.lengths = np.insert(self.lengths, at, lengths)
        self.ids = np.concatenate([self.ids, flat[order]])

    def encode(self, values: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in a row, number of ids of each text); null counts as empty."""
        texts = values.to_pylist()
        apart = {i: self.one(t) for i, t in enumerate(texts) if t and self.whole(t)}
        if apart:
            values = pa.array([None if i in apart else t for i, t in enumerate(texts)], pa.string())
        buf, offsets = text_bytes(values)
        begin, ends = self._cut(buf, offsets)
        keys, first, which = np.unique(
            word_hashes(buf, begin, ends) + (ends - begin).astype(np.uint64), return_index=True, return_inverse=True
        )
        at = np.searchsorted(self.keys, keys)
        known = at < len(self.keys)
        known[known] = self.keys[at[known]] == keys[known]
        if not known.all():
            new = first[~known]
            data = buf.tobytes()
            if len(self.keys) + len(new) > KNOWN_UNITS:
                self._forget()
                new, known = first, np.zeros(len(keys), dtype=bool)
            self._learn(keys[~known], [data[a:b].decode() for a, b in zip(begin[new].tolist(), ends[new].tolist())])
            at = np.searchsorted(self.keys, keys)
        starts, lengths = self.starts[at][which], self.lengths[at][which]
        flat = ragged_take(self.ids, starts, lengths)
        sums = np.concatenate([[0], np.cumsum(lengths)])
        counts = np.diff(sums[np.searchsorted(begin, offsets)]) if len(begin) else np.zeros(len(texts), dtype=np.int64)
        if apart:
            cuts = np.split(flat, np.cumsum(counts)[:-1])
            for i, ids in apart.items():
                cuts[i], counts[i] = ids, len(ids)
            flat = np.concatenate(cuts) if cuts else flat
        return flat, counts
