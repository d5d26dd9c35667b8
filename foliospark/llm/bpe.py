"""Byte-level BPE encoding and decoding.

Texts are cut into pre-tokens by a pattern; each is merged on its own. Merging keeps the pre-token's symbols in
a linked list and the possible merges in buckets, one for each rank, of list positions. A hierarchical bitmap
over the ranks tells the lowest rank that has a position (find-first-set, once a level); entries that a
neighbouring merge has made stale are skipped when they come up. A pre-token of n bytes takes O(n) queue
operations, however long it is.

Encoding is row-wise, so it runs in an Arrow UDF without any shuffle; merged pre-tokens are remembered in a
bounded cache.
"""

from __future__ import annotations

import base64
import hashlib
from array import array
from collections.abc import Iterator
from functools import lru_cache
from heapq import heappop, heappush

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import read

_BIT = [1 << k for k in range(256)]
_CACHE = 300_000  # pre-tokens remembered in a task, and as many that were lately
_LONG = 400  # longer pre-tokens (in characters) aren't remembered


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Token ids of one pre-token.

    ``buckets`` has the list positions of each rank (one, or a heap); ``low`` has a word of 256 ranks where any
    rank has positions, ``top`` a bit for each such word. The queue is written out in the loops: calls would
    take as long as its steps.
    """
    whole = ranks.get(piece)
    if whole is not None:
        return [whole]
    n, find, bit_of = len(piece), ranks.get, _BIT
    end = list(range(1, n + 1))  # of the symbol that begins here
    before = list(range(-1, n))
    current = [-1] * n  # rank of the symbol's merge with the next; -1: none, or no symbol
    buckets: dict[int, int | list[int]] = {}
    low: dict[int, int] = {}
    top = 0
    added = []
    for i in range(n - 1):
        rank = find(piece[i : i + 2])
        if rank is not None:
            current[i] = rank
            added.append((rank, i))
    while True:
        for rank, i in added:  # push
            if rank in buckets:
                held = buckets[rank]
                if type(held) is list:
                    heappush(held, i)
                else:
                    buckets[rank] = [held, i] if held < i else [i, held]
                continue
            buckets[rank] = i
            word = rank >> 8
            if word in low:
                low[word] |= bit_of[rank & 255]
            else:
                low[word] = bit_of[rank & 255]
                top |= 1 << word
        if not top:
            break
        word = (top & -top).bit_length() - 1  # pop: first set bit of the top, then of its word
        bits = low[word]
        least = bits & -bits
        rank = word << 8 | least.bit_length() - 1
        i = buckets[rank]
        if type(i) is list:
            held, i = i, heappop(i)
            gone = not held
        else:
            gone = True
        if gone:
            del buckets[rank]
            if bits == least:
                del low[word]
                top ^= 1 << word
            else:
                low[word] = bits ^ least
        added = []
        if current[i] != rank:  # stale: a neighbour's merge took a part of it
            continue
        j = end[i]
        stop = end[i] = end[j]
        current[j] = -1
        current[i] = -1
        if stop < n:
            before[stop] = i
            new = find(piece[i : end[stop]])
            if new is not None:
                current[i] = new
                added.append((new, i))
        if i:
            h = before[i]
            new = find(piece[h:stop])
            if new is None:
                current[h] = -1
            else:
                current[h] = new
                added.append((new, h))
    out, i = [], 0
    while i < n:
        j = end[i]
        out.append(ranks[piece[i:j]])
        i = j
    return out


class Codec:
    """Encodes texts to ids and back by the ranks of a tiktoken file."""

    def __init__(self, ranks_path: str, pattern: str) -> None:
        with open(ranks_path, "rb") as lines:
            self.ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        self.tokens = {rank: token for token, rank in self.ranks.items()}
        self.find = regex.compile(pattern).findall
        self._packed = _Packed(self.ranks)

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        return b"".join(map(self._packed.__getitem__, self.find(text)))

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, array("I", ids)))


class _Packed(dict):
    """Pre-token to packed ids. When full, what it holds becomes the older half, out of which used ones come back."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.ranks = ranks
        self.older: dict[str, bytes] = {}

    def __missing__(self, piece: str) -> bytes:
        ids = self.older.get(piece)
        if ids is None:
            ids = array("I", merge(piece.encode("utf-8", "replace"), self.ranks)).tobytes()
            if len(piece) > _LONG:
                return ids
        if len(self) >= _CACHE:
            self.older = dict(self)
            self.clear()
        self[piece] = ids
        return ids


@lru_cache(maxsize=4)
def codec(ranks_path: str, pattern: str) -> Codec:
    return Codec(ranks_path, pattern)


def encode(text: Column, ranks_path: str, pattern: str) -> Column:
    """ids of each text, packed as little-endian unsigned 32-bit integers (binary); a null text is an empty one."""

    @F.pandas_udf(T.BinaryType())
    def _encode(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        one = codec(ranks_path, pattern)
        for batch in texts:
            yield pd.Series([one.encode(x) if x else b"" for x in batch], dtype=object)

    return _encode(text)


def decode(ids: Column, ranks_path: str, pattern: str) -> Column:
    """Bytes of packed ids; null ids give no bytes. An id that the vocabulary lacks is an error."""

    @F.pandas_udf(T.BinaryType())
    def _decode(packed: Iterator[pd.Series]) -> Iterator[pd.Series]:
        one = codec(ranks_path, pattern)
        for batch in packed:
            yield pd.Series([one.decode(bytes(x)) if x else b"" for x in batch], dtype=object)

    return _decode(ids)


_DIGEST = "n_tokens long, ids_sha256 string, decoded_sha256 string"


def round_trip(text: Column, ranks_path: str, pattern: str) -> Column:
    """Encode, then decode the ids: a struct of n_tokens, ids_sha256 and decoded_sha256 (lowercase hex), in one pass."""

    @F.pandas_udf(_DIGEST)
    def _round_trip(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        one, hexed = codec(ranks_path, pattern), lambda x: hashlib.sha256(x).hexdigest()
        for batch in texts:
            rows = []
            for x in batch:
                ids = one.encode(x) if x else b""
                rows.append((len(ids) // 4, hexed(ids), hexed(one.decode(ids))))
            yield pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256"])

    return _round_trip(text)


def vocabulary() -> tuple[str, str]:
    """Path of the public byte-level vocabulary and its pre-token pattern."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def encode_documents(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids (packed) of each row. Null texts are empty, repeated rows stay, other columns go."""
    out = docs.select(F.col(f"`{id_col}`").alias("doc_id"), encode(F.col(f"`{text_col}`"), ranks_path, pattern).alias("ids"))
    return out.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), "ids")


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return docs.select("doc_id", round_trip(F.col("text"), *vocabulary()).alias("r")).select("doc_id", "r.*")
