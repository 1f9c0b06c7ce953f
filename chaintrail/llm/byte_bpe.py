"""Operator 7: byte-level BPE over Arrow batches, with the tokenizers library.

The ranks of a tiktoken file become a vocabulary of characters that stand for bytes, and all
pairs of tokens that make a token become merges, in the order of the token they make. A piece
that is a token itself is taken as it is. Units are pieces cut at ASCII spaces
(`token_units`); texts with other kinds of white space are encoded whole.

Decoding puts each id's bytes in a row. Ids may end inside a character: `decode_texts` shows
such a remainder as U+FFFD, and `StreamDecoder` keeps it until the rest arrives.

Null counts as empty, and an empty text has no ids. Repeated rows give repeated results, an
empty table none; other columns are not read.
"""

from __future__ import annotations

import base64
import codecs
import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType
from tokenizers import Regex, Tokenizer, models, pre_tokenizers

from chaintrail.llm.arrow_text import ragged_take, slices
from chaintrail.llm.registry import query, table
from chaintrail.llm.token_units import UnitEncoder

#: White space that is not ASCII; next to it a cut at ASCII spaces may be wrong.
OTHER_SPACE = re.compile(r"[\x85\xa0  -     　]")


def byte_characters() -> list[str]:
    """The character of each byte: itself if printable, else the next one from U+0100 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    out, spare = [], 0x100
    for b in range(256):
        out.append(chr(b if b in plain else spare))
        spare += b not in plain
    return out


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


@lru_cache(maxsize=2)
def encoder(path: str, pattern: str) -> UnitEncoder:
    """The tokenizer of a rank file, made once in each worker."""
    ranks, chars = read_ranks(path), byte_characters()
    name = {token: "".join(chars[b] for b in token) for token in ranks}
    merges = []
    for token, _ in sorted(ranks.items(), key=lambda x: x[1]):
        for cut in range(1, len(token)):
            if token[:cut] in ranks and token[cut:] in ranks:
                merges.append((name[token[:cut]], name[token[cut:]]))
    model = models.BPE({name[t]: r for t, r in ranks.items()}, merges, ignore_merges=True)
    tokenizer = Tokenizer(model)
    tokenizer.pre_tokenizer = pre_tokenizers.Sequence(
        [
            pre_tokenizers.Split(Regex(pattern), "isolated"),
            pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False),
        ]
    )
    return UnitEncoder(tokenizer, spaced=True, whole=lambda t: bool(OTHER_SPACE.search(t)))


@lru_cache(maxsize=2)
def token_bytes(path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes of all tokens in a row, start, length) by id."""
    ranks = sorted(read_ranks(path).items(), key=lambda x: x[1])
    size = ranks[-1][1] + 1
    lengths = np.zeros(size, dtype=np.int64)
    lengths[[r for _, r in ranks]] = [len(t) for t, _ in ranks]
    starts = np.cumsum(lengths) - lengths
    return np.frombuffer(b"".join(t for t, _ in ranks), dtype=np.uint8), starts, lengths


def decode_bytes(ids: np.ndarray, path: str) -> bytes:
    flat, starts, lengths = token_bytes(path)
    return ragged_take(flat, starts[ids], lengths[ids]).tobytes()


class StreamDecoder:
    """Text of ids that arrive in pieces; bytes of a split character wait for the rest."""

    def __init__(self, path: str):
        self.path, self.utf8 = path, codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, ids: np.ndarray, last: bool = False) -> str:
        return self.utf8.decode(decode_bytes(ids, self.path), last)


def _mapped(docs: DataFrame, columns: list[str], schema: str, path: str, pattern: str, make) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path, pattern)
        for batch in batches:
            for part in slices(batch):
                ids, counts = enc.encode(part.column("text"))
                keep = [part.column(c) for c in columns]
                yield make(keep, np.split(ids, np.cumsum(counts)[:-1]) if len(counts) else [], counts)

    return docs.mapInArrow(run, schema)


def encode(docs: DataFrame, path: str, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """The columns of `docs` except `text`, then ids (array<int>)."""
    columns = [c for c in docs.columns if c not in ("text", "ids")]
    schema = docs.select(*columns).schema.add("ids", ArrayType(IntegerType()))

    def make(keep, ids, counts):
        return pa.RecordBatch.from_arrays([*keep, pa.array([x.view(np.int32) for x in ids], pa.list_(pa.int32()))], [*columns, "ids"])

    return _mapped(docs.select(*columns, F.col("text").cast("string").alias("text")), columns, schema, path, pattern, make)


def decode_texts(encoded: DataFrame, path: str) -> DataFrame:
    """Column ids becomes text again; a character whose bytes are cut off becomes U+FFFD."""
    columns = [c for c in encoded.columns if c not in ("text", "ids")]
    schema = encoded.select(*columns).schema.add("text", "string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [
                None if x.as_py() is None else decode_bytes(np.asarray(x.values), path).decode("utf-8", "replace")
                for x in batch.column("ids")
            ]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), pa.array(texts, pa.string())], [*columns, "text"])

    return encoded.select(*columns, "ids").mapInArrow(run, schema)


def digests(docs: DataFrame, path: str, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (ids as little-endian 32 bits), decoded_sha256 (bytes decoded from the ids)."""

    def make(keep, ids, counts):
        return pa.RecordBatch.from_arrays(
            [
                *keep,
                pa.array(counts, pa.int64()),
                pa.array([hashlib.sha256(x.astype("<u4").tobytes()).hexdigest() for x in ids], pa.string()),
                pa.array([hashlib.sha256(decode_bytes(x, path)).hexdigest() for x in ids], pa.string()),
            ],
            ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
        )

    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    kind = docs.select("doc_id").schema["doc_id"].dataType.simpleString()
    return _mapped(rows, ["doc_id"], f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string", path, pattern, make)


@query("op7_byte_bpe")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
