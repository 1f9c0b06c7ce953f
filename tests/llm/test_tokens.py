"""Operators 6 and 7 beside the libraries they follow, on awkward text."""

import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
import tiktoken
from tokenizers import Tokenizer

from chaintrail.llm import byte_bpe as B
from chaintrail.llm import token_files as T
from chaintrail.llm import token_units
from chaintrail.session import new_scratch

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
WORDS = public_tokenizers.path("word_bpe_49k.json")
SCHEMA = "doc_id long, text string, n_tokens int, ids string"


def texts(n=400):
    rng = random.Random(5)
    parts = ["a", "The", "  ", " ", "\n", "\t", "\r\n", "é", "ß", "1", "23", "'s", "!!", "…", "\xa0", "　", "\x1c", "日本", "😀", "é", "İ", "<|endoftext|>", "thing"]
    made = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 30))) for _ in range(n)]
    return [*made, None, "", " ", "x" * 3000, "ab " * 20_000]


def rows(spark, values):
    return spark.createDataFrame([(i, t, 7, "x") for i, t in enumerate(values)], SCHEMA).repartition(4)


def test_byte_bpe_is_tiktoken(spark):
    reference = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=B.read_ranks(RANKS), special_tokens={})
    values = texts()
    for r in B.digests(rows(spark, values), RANKS).collect():
        ids = np.array(reference.encode_ordinary(values[r.doc_id] or ""), dtype="<u4")
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(ids.tobytes()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256((values[r.doc_id] or "").encode()).hexdigest()
    back = B.decode_texts(B.encode(rows(spark, values), RANKS), RANKS).collect()
    assert {r.doc_id: r.text for r in back} == {i: t or "" for i, t in enumerate(values)}


def test_few_known_units(monkeypatch):
    monkeypatch.setattr(token_units, "KNOWN_UNITS", 5)
    B.encoder.cache_clear()
    enc = B.encoder(RANKS, public_tokenizers.PATTERN)
    for value in texts(50):
        ids, counts = enc.encode(pa.array([value, value], pa.string()))
        assert B.decode_bytes(ids, RANKS).decode() == 2 * (value or "") and counts[0] == counts[1]
    B.encoder.cache_clear()


def test_split_characters():
    ids, _ = B.encoder(RANKS, public_tokenizers.PATTERN).encode(pa.array(["a𝒳é日"]))
    stream = B.StreamDecoder(RANKS)
    assert "".join(stream.feed(ids[i : i + 1]) for i in range(len(ids))) + stream.feed(ids[:0], last=True) == "a𝒳é日"


@pytest.mark.parametrize("bits", [False, True])
def test_token_files(spark, bits, monkeypatch):
    monkeypatch.setattr(T, "BLOCK", 1000)
    values = texts()
    reference = Tokenizer.from_file(WORDS)
    folder = new_scratch(spark, "token-files")
    T.write_files(rows(spark, values), folder, WORDS, end_id=2, bits=bits)
    got = sorted(T.read_documents(spark, folder).collect())
    start = 0
    for r, value in zip(got, values, strict=True):
        ids = [*reference.encode(value or "", add_special_tokens=False).ids, 2]
        assert list(r.ids) == ids and r.start == start and r.n_tokens == len(ids)
        assert r.ids_crc32 == zlib.crc32(np.array(ids, dtype="<u4").tobytes())
        start += len(ids)
    index = T.chunk_index(spark, folder).where("kind = 'I'").collect()
    assert sum(r.entries for r in index) == start
    every = np.concatenate([r.ids for r in got])
    for a, b in ((0, 5), (990, 1010), (start // 2, start // 2 + 4321), (start - 3, start + 9), (start, start + 1), (7, 7)):
        rows_read = sorted(T.read_ids(spark, folder, a, b).collect())
        assert np.concatenate([[], *[r.ids for r in rows_read]]).tolist() == every[a:b].tolist()
        assert all(r.place == a or r.place in {i.start for i in index} for r in rows_read)


def test_places_over_groups_of_files(spark, monkeypatch):
    monkeypatch.setattr(T, "FILES_PER_GROUP", 2)
    folder = new_scratch(spark, "token-files")
    T.write_files(rows(spark, texts(60)), folder, WORDS, end_id=2)
    index = sorted((r.start, r.entries) for r in T.chunk_index(spark, folder).where("kind = 'I'").collect())
    assert len(index) > 5 and [s for s, _ in index] == [sum(n for _, n in index[:i]) for i in range(len(index))]


def test_empty_tables_and_repeats(spark):
    folder = new_scratch(spark, "token-files")
    T.write_files(rows(spark, []), folder, WORDS, end_id=2)
    assert T.read_documents(spark, folder).collect() == []
    assert B.digests(rows(spark, []), RANKS).collect() == []
    twice = spark.createDataFrame([(1, "a b", 1, "x"), (1, "a b", 1, "x"), (None, None, None, None)], SCHEMA)
    folder = new_scratch(spark, "token-files")
    T.write_files(twice, folder, WORDS, end_id=2)
    got = sorted((r.start, r.doc_id, r.n_tokens) for r in T.read_documents(spark, folder).collect())
    assert got == [(0, None, 1), (1, 1, 3), (4, 1, 3)]
