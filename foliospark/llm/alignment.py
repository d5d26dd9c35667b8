"""Alignment of two tokenizers' tokens over the same bytes.

Each tokenizer's token ends are marked in a packed bitset over the bytes of many texts at once. The AND of both has the
shared cuts, which cut a text into groups; the OR has the ends of the pieces that lie in one token of each, and every
piece is one link. Ranks by popcounts tell the token that a byte lies in, so cuts become token ranges and pieces
become links without walking over tokens.

Counts of linked id pairs are over the whole corpus: a chunk of texts counts its own pairs first, chunks' counts are
summed by pair, and each chunk gets the sums of its own pairs back, once for all its texts. No vocabulary-sized
table is broadcast, and a pair that is everywhere has one row a chunk.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read, stage
from .words import chunks

CHUNK = 2_000_000  # characters that are aligned and counted together; a longer text is a chunk of its own
SPACE = "▁"


def _byte_of() -> dict[str, int]:
    """The byte that each letter of a byte-level vocabulary stands for: printable Latin-1 stands for itself, the others follow from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class ByteLevel:
    """A byte-level BPE vocabulary file of the tokenizers library, encoded by its merge ranks.

    A merged token's id gives its rank, which is checked against the file's list of merges.
    """

    def __init__(self, path: str) -> None:
        import tiktoken
        from public_tokenizers import PATTERN

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, added = spec["model"], {x["content"] for x in spec["added_tokens"]}
        of = _byte_of()
        ranks = {bytes(of[c] for c in token): i for token, i in model["vocab"].items() if token not in added}
        merged = [model["vocab"]["".join(m if isinstance(m, list) else m.split(" "))] for m in model["merges"]]
        if any(x >= y for x, y in zip(merged, merged[1:], strict=False)):
            raise ValueError(f"{path}: ids don't follow the merges' order")
        self.size = 1 + max(model["vocab"].values())
        self.bytes = [b""] * self.size
        for token, i in ranks.items():
            self.bytes[i] = token
        self.length = np.array([len(x) for x in self.bytes])
        self._codec = tiktoken.Encoding("byte-level", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(self, texts: Sequence[str]) -> list[list[int]]:
        return [self._codec.encode_ordinary(" " + t) for t in texts]


class Pieces:
    """A piece vocabulary of the sentencepiece library; it puts a space before a text itself."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        self._codec = sentencepiece.SentencePieceProcessor(model_file=path)
        self.size = self._codec.get_piece_size()
        self.bytes = [bytes([int(p[3:5], 16)]) if self._codec.is_byte(i) else p.replace(SPACE, " ").encode() for i in range(self.size) for p in [self._codec.id_to_piece(i)]]
        self.length = np.array([len(x) for x in self.bytes])

    def encode(self, texts: Sequence[str]) -> list[list[int]]:
        return self._codec.encode(list(texts), num_threads=1)


@lru_cache(maxsize=4)
def codec(path: str) -> ByteLevel | Pieces:
    return ByteLevel(path) if path.endswith(".json") else Pieces(path)


class Marks:
    """A packed bitset with ranks."""

    def __init__(self, words: np.ndarray) -> None:
        self.words = words
        self._before = np.concatenate([[0], np.cumsum(np.bitwise_count(words), dtype=np.int64)])

    @classmethod
    def at(cls, places: np.ndarray, size: int) -> Marks:
        flags = np.zeros(-(-size // 64) * 64 + 64, np.uint8)
        flags[places] = 1
        return cls(np.packbits(flags, bitorder="little").view(np.uint64))

    def rank(self, places: np.ndarray) -> np.ndarray:
        """Marks before each place."""
        word, bit = places >> 6, (places & 63).astype(np.uint64)
        return self._before[word] + np.bitwise_count(self.words[word] & ((np.uint64(1) << bit) - np.uint64(1)))

    def select(self) -> np.ndarray:
        """Places of all marks, ascending."""
        return np.flatnonzero(np.unpackbits(self.words.view(np.uint8), bitorder="little"))


@dataclass
class Aligned:
    """Tokens, groups and links of some texts; the ``*_first`` arrays have each text's first, and the end."""

    a: np.ndarray  # token ids
    b: np.ndarray
    a_first: np.ndarray
    b_first: np.ndarray
    group_a: np.ndarray  # token at which a group ends
    group_b: np.ndarray
    group_first: np.ndarray
    link_a: np.ndarray  # a link's tokens
    link_b: np.ndarray
    link_first: np.ndarray


def align_texts(texts: Sequence[str | None], one: ByteLevel | Pieces, two: ByteLevel | Pieces) -> Aligned:
    """Texts null or empty, or that a tokenizer doesn't give back byte for byte, have no tokens."""
    texts = [t or "" for t in texts]
    ids = [c.encode(texts) for c in (one, two)]
    size = np.zeros(len(texts), np.int64)
    for k, t in enumerate(texts):
        want = b" " + t.encode("utf-8", "replace")
        if t and all(b"".join(map(c.bytes.__getitem__, own[k])) == want for c, own in zip((one, two), ids, strict=True)):
            size[k] = len(want)
        else:
            ids[0][k] = ids[1][k] = []
    base = np.concatenate([[0], np.cumsum(size)])
    marks, flat, first = [], [], []
    for c, own in zip((one, two), ids, strict=True):
        tokens = np.fromiter(chain.from_iterable(own), np.int64, sum(map(len, own)))
        marks.append(Marks.at(np.cumsum(c.length[tokens]) - 1, int(base[-1])))
        flat.append(tokens)
        first.append(np.concatenate([[0], np.cumsum([len(x) for x in own])]).astype(np.int64))
    one_ends, two_ends = marks
    shared, pieces = Marks(one_ends.words & two_ends.words), Marks(one_ends.words | two_ends.words)
    cuts, ends = shared.select(), pieces.select()
    return Aligned(*flat, *first, one_ends.rank(cuts + 1), two_ends.rank(cuts + 1), shared.rank(base), one_ends.rank(ends), two_ends.rank(ends), pieces.rank(base))


@lru_cache(maxsize=4)
def _written(size_a: int, size_b: int) -> np.ndarray:
    """Ids as they are written: a's followed by a comma, then by a bar, b's by a comma, by a semicolon, and by a line's end."""
    return np.array([b"%d%s" % (i, mark) for size, mark in ((size_a, b","), (size_a, b"|"), (size_b, b","), (size_b, b";"), (size_b, b"\n")) for i in range(size)], dtype=object)


def _group_texts(x: Aligned, size_a: int, size_b: int) -> Iterator[bytes]:
    """a1,a2|b1;a3|b2,b3 of each text; empty without tokens."""
    form = np.empty(len(x.a) + len(x.b), np.int64)
    of_a, of_b = x.a.copy(), x.b + 2 * size_a
    of_a[x.group_a - 1] += size_a
    of_b[x.group_b - 1] += size_b
    full = np.diff(x.b_first) > 0
    of_b[x.b_first[1:][full] - 1] += size_b
    # a group's tokens of a come after all earlier groups' tokens of b, its tokens of b after its own of a
    form[np.arange(len(x.a)) + np.repeat(np.concatenate([[0], x.group_b])[:-1], np.diff(x.group_a, prepend=0))] = of_a
    form[np.arange(len(x.b)) + np.repeat(x.group_a, np.diff(x.group_b, prepend=0))] = of_b
    written = iter(b"".join(_written(size_a, size_b)[form].tolist()).split(b"\n"))
    return (next(written) if has else b"" for has in full.tolist())


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[int | None], list[str | None]]]:
    for batch in batches:
        ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        for lo, hi in chunks(texts, CHUNK):
            yield ids[lo:hi], texts[lo:hi]


def align_tokens(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, a_ids, b_ids, groups (array of the token places at which a group ends: a, b), links (array of token places: a, b) of each row.

    Null and empty texts, and those that a tokenizer doesn't give back byte for byte, have empty arrays. Rows with
    null or repeated ids are rows of their own, texts of any length are taken whole, other columns are ignored, and an
    empty table gives an empty one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one, two = codec(a_path), codec(b_path)
        cut = lambda v, first: [v[lo:hi] for lo, hi in zip(first[:-1], first[1:], strict=True)]
        for ids, texts in _batches(batches):
            x = align_texts(texts, one, two)
            places = lambda v, own, first: cut(v - np.repeat(own[:-1], np.diff(first)), first)
            two_of = lambda p, q, first: [[{"a": int(i), "b": int(j)} for i, j in zip(u, v, strict=True)] for u, v in zip(places(p, x.a_first, first), places(q, x.b_first, first), strict=True)]
            columns = [ids, cut(x.a, x.a_first), cut(x.b, x.b_first), two_of(x.group_a, x.group_b, x.group_first), two_of(x.link_a, x.link_b, x.link_first)]
            kinds = [pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int32()), *[pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))] * 2]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["doc_id", "a_ids", "b_ids", "groups", "links"])

    pair = "array<struct<a:int,b:int>>"
    return docs.select(F.col(f"`{id_col}`").cast("long"), F.col(f"`{text_col}`")).mapInArrow(run, f"doc_id long, a_ids array<int>, b_ids array<int>, groups {pair}, links {pair}")


_CHUNK_ROW = "chunk long, doc_id array<long>, n_a array<long>, n_b array<long>, n_groups array<long>, n_links array<long>, groups_sha256 array<string>, pairs array<long>, totals array<long>, held array<int>, place array<int>, times array<int>"


def _chunk_rows(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """A row for each chunk of texts: its texts' figures, its distinct id pairs (a * size of b + b) with their links, and the pairs of each text by place in that list."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one, two = codec(a_path), codec(b_path)
        number = TaskContext.get().partitionId() << 32
        for ids, texts in _batches(batches):
            x = align_texts(texts, one, two)
            pairs, place, totals = np.unique(x.a[x.link_a] * two.size + x.b[x.link_b], return_inverse=True, return_counts=True)
            row = np.repeat(np.arange(len(ids)), np.diff(x.link_first))
            own, times = np.unique(row * max(len(pairs), 1) + place, return_counts=True)
            sha = [hashlib.sha256(s).hexdigest() if s else "" for s in _group_texts(x, one.size, two.size)]
            held = np.bincount(own // max(len(pairs), 1), minlength=len(ids))
            values = [[number], [ids], *[[np.diff(v)] for v in (x.a_first, x.b_first, x.group_first, x.link_first)], [sha], [pairs], [totals], [held], [own % max(len(pairs), 1)], [times]]
            kinds = [pa.int64(), *[pa.list_(pa.int64())] * 5, pa.list_(pa.string()), *[pa.list_(pa.int64())] * 2, *[pa.list_(pa.int32())] * 3]
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(values, kinds, strict=True)], names=[c.split()[0] for c in _CHUNK_ROW.split(", ")])
            number += 1

    return docs.mapInArrow(run, _CHUNK_ROW)


def alignment_report(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of each row.

    A link's count is how many links of all rows hold its id pair; n_best is the number of links whose count is the
    highest of their b id, ties included, count_sum the sum of counts. Rows as in ``align_tokens``; without tokens
    all figures are 0 and groups_sha256 is empty.
    """
    chunked = stage(_chunk_rows(docs.select(F.col(f"`{id_col}`").cast("long"), F.col(f"`{text_col}`")), a_path, b_path), "aligned", compression="zstd")
    size = codec(b_path).size
    each = chunked.select("chunk", F.posexplode(F.arrays_zip("pairs", "totals")).alias("k", "p")).select("chunk", "k", F.col("p.pairs").alias("pair"), F.col("p.totals").alias("links"))
    counts = stage(each.groupBy("pair").agg(F.sum("links").alias("count")).withColumn("b", F.col("pair") % size), "pair-counts")
    best = counts.groupBy("b").agg(F.max("count").alias("best"))
    counts = counts.join(best, "b").select("pair", "count", (F.col("count") == F.col("best")).alias("top"))
    back = each.join(counts, "pair").groupBy("chunk").agg(F.sort_array(F.collect_list(F.struct("k", "count", "top"))).alias("c"))
    back = back.select("chunk", F.transform("c", lambda v: v["count"]).alias("counts"), F.transform("c", lambda v: v["top"].cast("int")).alias("tops"))
    whole = chunked.drop("pairs", "totals").join(back, "chunk", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                get = lambda c, k=k, batch=batch: batch.column(c)[k].values
                flat = lambda c, get=get: get(c).to_numpy(zero_copy_only=False)
                held = flat("held")
                best, total = np.zeros(len(held), np.int64), np.zeros(len(held), np.int64)
                if held.any():
                    counts, tops, place, times = flat("counts"), flat("tops"), flat("place"), flat("times").astype(np.int64)
                    at = np.concatenate([[0], np.cumsum(held)])
                    ends = lambda v, at=at: np.diff(np.concatenate([[0], np.cumsum(v)])[at])
                    best, total = ends(times * tops[place]), ends(times * counts[place])
                names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
                yield pa.RecordBatch.from_arrays([pa.array(best) if c == "n_best" else pa.array(total) if c == "count_sum" else get(c) for c in names], names=names)

    return whole.mapInArrow(run, "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string")


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return alignment_report(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
