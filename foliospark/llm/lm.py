"""Language-model scoring with an Elias-Fano n-gram trie, sharded over the cluster.

1. Documents are tokenised once, in pieces: each piece lists its distinct words (64-bit hashes), its training
   counts, and its tokens as places in that list.
2. Each piece sends its distinct bigrams with their training counts to shards (by the context; very frequent
   contexts, of which there can be few, are spread over all shards by their followers).
3. A shard adds the counts, builds its trie in a file of the shared folder, maps that and answers every piece:
   training counts of its contexts, quantised smoothed probabilities of its bigrams, found by context-relative
   successor search.
4. Each piece meets its answers again and scores its documents.

A bigram's probability interpolates with the unigram model (Dirichlet prior): p(w|v) = a(w|v) + b(v) * p1(w), with
a(w|v) = c(v,w) / (c(v) + mu), b(v) = mu / (c(v) + mu) and p1(w) = (c(w) + 1) / (N + V + 1); quantised probabilities
are rounded down, so all probabilities sum to one at most. What moves over the network are distinct words and bigrams of pieces, so it grows with the corpus.
"""

from __future__ import annotations

import mmap
import os
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read, shared_dir, stage, unstage
from .elias_fano import CODEBOOK, Trie, build_trie
from .words import chunks, words

MU = 300.0
PIECE = 4_000_000  # characters
_SHARD = 2_000_000  # bytes of text for each shard
_BEGIN, _END = np.uint64(0x1B873593CC9E2D51), np.uint64(0x85EBCA6B27D4EB2F)
_NARROW = np.uint64(0xFFFFFFFF)

_PIECES = "piece string, doc_ids array<long>, train binary, first binary, n_words int, shards binary, words binary, counts binary, trained binary, tokens binary"


def _pack(idx: np.ndarray) -> bytes:
    return zlib.compress(np.ascontiguousarray(idx.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes(), 1)


def _unpack(blob: bytes) -> np.ndarray:
    planes = np.frombuffer(zlib.decompress(blob), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").ravel().astype(np.int64)


def _of(blob: bytes, kind: str) -> np.ndarray:
    return np.frombuffer(blob, kind)


def pieces(docs: DataFrame, shards: int) -> DataFrame:
    """docs (doc_id, text, train) -> pieces. Words of a piece are in order of shard, then hash."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = batch["text"].tolist()
            for lo, hi in chunks(texts, PIECE):
                found = [words(texts[lo + a : lo + b]) for a, b in chunks(texts[lo:hi])]
                h = np.concatenate([w.hashes for w in found])
                sizes = np.concatenate([np.diff(w.first) for w in found])
                first = np.append(0, np.cumsum(sizes))
                train = batch["train"].to_numpy(bool)[lo:hi]
                distinct, tokens = np.unique(h, return_inverse=True)
                shard = (distinct % np.uint64(shards)).astype(np.int64)
                order = np.argsort(shard, kind="stable")
                place = np.empty(len(order), np.int64)
                place[order] = np.arange(len(order))
                tokens = place[tokens]
                counts = np.bincount(tokens, minlength=len(distinct))
                trained = np.bincount(tokens[np.repeat(train, sizes)], minlength=len(distinct))
                present = np.stack(np.unique(shard, return_counts=True))  # only the shards that the piece has: bytes go with its words
                ids = [None if pd.isna(x) else int(x) for x in batch["doc_id"].iloc[lo:hi]]
                yield pd.DataFrame([(uuid.uuid4().hex, ids, train.astype(np.uint8).tobytes(), first.astype("<i8").tobytes(), len(distinct), present.astype("<i4").tobytes(), distinct[order].tobytes(), counts.astype("<u4").tobytes(), trained.astype("<u4").tobytes(), _pack(tokens))], columns=_PIECES.replace(" array<long>", "").replace(" string", "").replace(" binary", "").replace(" int", "").split(", "))

    return docs.mapInPandas(cut, _PIECES)


def _heavy(table: DataFrame, shards: int) -> dict[int, int]:
    """Training count of each word so frequent that its bigrams are spread over all shards; at most 8 * shards words."""

    def local(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for w, c in zip(batch["words"], batch["counts"], strict=True):
                w, c = _of(w, "<u8"), _of(c, "<u4").astype(np.int64)
                at = c >= max(1, c.sum() // (4 * shards)) if len(c) else []
                yield pd.DataFrame({"h": w[at].view(np.int64), "n": c[at], "total": 0})
                yield pd.DataFrame({"h": [0], "n": [0], "total": [int(c.sum())]})

    seen = table.select("words", "counts").mapInPandas(local, "h long, n long, total long").groupBy("h").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))
    seen = stage(seen, "lm-frequent")
    total = seen.agg(F.sum("total")).first()[0] or 0
    chosen = np.array([r["h"] for r in seen.where(F.col("n") > max(1000, total / (8 * shards))).collect()], np.int64).view(np.uint64)
    unstage(seen)
    chosen.sort()

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for w, c in zip(batch["words"], batch["trained"], strict=True):
                w, c = _of(w, "<u8"), _of(c, "<u4").astype(np.int64)
                at = np.isin(w, chosen)
                yield pd.DataFrame({"h": w[at].view(np.int64), "n": c[at]})

    rows = table.select("words", "trained").mapInPandas(count, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).collect()
    return {int(np.int64(r["h"]).view(np.uint64)): r["n"] for r in rows}


def _bigrams(first: np.ndarray, tokens: np.ndarray, n_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Previous and own place of each token (n_words: end, n_words + 1: begin), and each document's first token."""
    n_docs = len(first) - 1
    start = first[:-1] + np.arange(n_docs)
    own = np.full(len(tokens) + n_docs, n_words, np.int64)
    keep = np.ones(len(own), bool)
    keep[first[1:] + np.arange(n_docs)] = False
    own[keep] = tokens
    before = np.append(0, own[:-1])
    before[start] = n_words + 1
    return before, own, start


def _word_shards(present: bytes) -> np.ndarray:
    """Shard of each word of a piece."""
    return np.repeat(*np.frombuffer(present, "<i4").astype(np.int64).reshape(2, -1))


def _shard_of(context: np.ndarray, follower: np.ndarray, word_shards: np.ndarray, spread: np.ndarray) -> np.ndarray:
    """Shard of each bigram: the context's, or the follower's if the context is spread."""
    shard = np.append(word_shards, [0, 0])
    return np.where(spread[context], shard[follower], shard[context])


_SENT = "shard int, piece string, contexts binary, fan binary, followers binary, counts binary, spread binary"
_ANSWER = "piece string, shard int, contexts binary, codes binary, spread binary, spread_counts binary, types long, tokens long, trie binary"


def _send(table: DataFrame, heavy: np.ndarray) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples():
                w = _of(r.words, "<u8")
                d, train = r.n_words, _of(r.train, np.uint8).astype(bool)
                first = _of(r.first, "<i8")
                before, own, start = _bigrams(first, _unpack(r.tokens), d)
                key, inverse = np.unique(before * (d + 2) + own, return_inverse=True)
                counts = np.bincount(inverse[np.repeat(train, np.diff(np.append(start, len(own))))], minlength=len(key))
                context, follower = key // (d + 2), key % (d + 2)
                spread = np.append(np.isin(w, heavy), [False, True])
                shard = _shard_of(context, follower, _word_shards(r.shards), spread)
                order = np.argsort(shard, kind="stable")
                hashes = np.append(w, [_END, _BEGIN])
                own_shards, cut = np.unique(shard[order], return_index=True)
                out = []
                for s, mine in zip(own_shards.tolist(), np.split(order, cut[1:]), strict=True):
                    c = context[mine]
                    at = np.flatnonzero(np.append(True, c[1:] != c[:-1]))
                    heads = c[at]
                    out.append((s, r.piece, hashes[heads].tobytes(), np.diff(np.append(at, len(c))).astype("<u4").tobytes(), (hashes[follower[mine]] & _NARROW).astype("<u4").tobytes(), counts[mine].astype("<u4").tobytes(), heads[spread[heads]].astype("<i4").tobytes()))
                yield pd.DataFrame(out, columns=["shard", "piece", "contexts", "fan", "followers", "counts", "spread"])

    return table.select("piece", "train", "first", "n_words", "shards", "words", "tokens").mapInPandas(run, _SENT)


def shard_count(docs: DataFrame, text_col: str) -> int:
    size = docs.agg(F.sum(F.octet_length(F.col(f"`{text_col}`")))).first()[0] or 0
    return max(16, -(-size // _SHARD))


def _folder(spark: SparkSession) -> str | None:
    """The shared folder as a path for tasks to write files in; None where it isn't one (tries are read from memory there)."""
    path = shared_dir(spark)
    path = path.removeprefix("file://").removeprefix("file:")
    return None if ":/" in path else os.path.join(path, "foliospark-staged")


def open_trie(block: bytes, folder: str | None) -> Trie:
    """The trie, mapped from a file that lives as long as the map."""
    if folder is None:
        return Trie(memoryview(block))
    os.makedirs(folder, exist_ok=True)
    path = os.path.join(folder, f"lm-trie-{uuid.uuid4().hex}")
    try:
        with open(path, "xb") as file:
            file.write(block)
        with open(path, "rb") as file:
            return Trie(memoryview(mmap.mmap(file.fileno(), 0, access=mmap.ACCESS_READ)))
    finally:
        os.unlink(path)


def _answers(sent: DataFrame, heavy: dict[int, int], n_docs: int, mu: float, keep_trie: bool) -> DataFrame:
    spread_hashes = np.array(sorted(heavy), np.uint64)
    spread_counts = np.array([heavy[int(h)] for h in spread_hashes], np.int64)
    folder = _folder(sent.sparkSession)

    def run(group: pd.DataFrame) -> pd.DataFrame:
        shard = int(group["shard"].iloc[0])
        heads = [_of(x, "<u8") for x in group["contexts"]]
        fans = [_of(x, "<u4").astype(np.int64) for x in group["fan"]]
        v = np.concatenate([np.repeat(h, f) for h, f in zip(heads, fans, strict=True)])
        w = np.concatenate([_of(x, "<u4") for x in group["followers"]]).astype(np.uint64)
        n = np.concatenate([_of(x, "<u4") for x in group["counts"]]).astype(np.int64)
        seen = np.flatnonzero(n)
        order = seen[np.lexsort((w[seen], v[seen]))]
        sv, sw = v[order], w[order]
        new = np.flatnonzero(np.append(True, (sv[1:] != sv[:-1]) | (sw[1:] != sw[:-1]))) if len(order) else np.zeros(0, np.int64)
        total = np.add.reduceat(n[order], new) if len(new) else np.zeros(0, np.int64)
        sv, sw = sv[new], sw[new]
        del n, order, seen
        own = np.flatnonzero(np.append(True, sv[1:] != sv[:-1])) if len(new) else np.zeros(0, np.int64)
        known, in_all = sv[own], np.add.reduceat(total, own) if len(own) else np.zeros(0, np.int64)
        # counts of contexts over all shards
        whole = np.where(known == _BEGIN, n_docs, in_all)
        if len(spread_hashes):
            k = np.minimum(np.searchsorted(spread_hashes, known), len(spread_hashes) - 1)
            whole = np.where(spread_hashes[k] == known, spread_counts[k], whole)
        block = build_trie(sv, sw, total / (np.repeat(whole, np.diff(np.append(own, len(sv)))) + mu), mu / (whole + mu))
        del sv, sw, total
        trie = open_trie(block, folder)
        block = block if keep_trie else None
        codes = trie.lookup(v, w)
        out, at = [], 0
        for piece, h, f, s in zip(group["piece"], heads, fans, group["spread"], strict=True):
            place = np.minimum(np.searchsorted(known, h), max(0, len(known) - 1))
            count = np.where(known[place] == h, in_all[place], 0) if len(known) else np.zeros(len(h), np.int64)
            wide = np.isin(h, spread_hashes)
            wide_counts = spread_counts[np.searchsorted(spread_hashes, h[wide])]
            # the begin of documents is spread too; its count comes with the totals
            wide_counts = np.append(wide_counts, np.zeros(int((h == _BEGIN).sum()), np.int64))
            out.append((piece, shard, count.astype("<i8").tobytes(), codes[at : at + int(f.sum())].tobytes(), s, wide_counts.astype("<i8").tobytes(), None, None, None))
            at += int(f.sum())
        plain = ~np.isin(known, spread_hashes) & (known != _BEGIN)
        out.append((None, shard, None, None, None, None, int(plain.sum()), int(in_all[plain].sum()), block))
        return pd.DataFrame(out, columns=["piece", "shard", "contexts", "codes", "spread", "spread_counts", "types", "tokens", "trie"])

    return sent.groupBy("shard").applyInPandas(run, _ANSWER)


def score(docs: DataFrame, train: Column, mu: float = MU, id_col: str = "doc_id", text_col: str = "text", shards: int | None = None) -> DataFrame:
    """doc_id, train, n_tokens, n_known, train_tokens, base_score, score of each row, by a model of the rows with ``train``.

    base_score: sum of log10((c + 1) / (N + V + 1)) over the tokens; score: sum of log10 p. A text's tokens are
    its words (A-Z lower-cased) and one end. Null and empty texts have the end only; repeated rows and rows
    with a null id are documents like others; without training rows every token is unknown and both scores are
    0. Very long texts are taken whole. Ids must be integers or cast to them. Other columns are ignored.
    """
    shards = shards or shard_count(docs, text_col)
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"), F.coalesce(train, F.lit(False)).alias("train"))
    n_docs = rows.where("train").count()
    table = stage(pieces(rows, shards), "lm-pieces")
    heavy = _heavy(table, shards)
    sent = _send(table, np.array(sorted(heavy), np.uint64))
    answers = stage(_answers(sent, heavy, n_docs, mu, False), "lm-answers")
    sums = answers.where(F.col("piece").isNull()).agg(F.sum("types"), F.sum("tokens")).first()
    seen = [c for c in heavy.values() if c]
    n_total = (sums[1] or 0) + sum(seen) + n_docs
    n_types = (sums[0] or 0) + len(seen) + (n_docs > 0)

    def finish(piece: pd.DataFrame, replies: pd.DataFrame) -> pd.DataFrame:
        out = []
        for r in piece.itertuples():
            d, word_shards = r.n_words, _word_shards(r.shards)
            first, train = _of(r.first, "<i8"), _of(r.train, np.uint8).astype(bool)
            before, own, start = _bigrams(first, _unpack(r.tokens), d)
            key, inverse = np.unique(before * (d + 2) + own, return_inverse=True)
            context, follower = key // (d + 2), key % (d + 2)
            spread, count = np.zeros(d + 2, bool), np.zeros(d + 2, np.int64)
            spread[d + 1] = True
            replies = replies.sort_values("shard")
            for s, c in zip(replies["spread"], replies["spread_counts"], strict=True):
                s = _of(s, "<i4")
                spread[s] = True
                count[s] = _of(c, "<i8")
            order = np.argsort(_shard_of(context, follower, word_shards, spread), kind="stable")
            codes = np.empty(len(key), np.uint8)
            codes[order] = np.concatenate([_of(c, np.uint8) for c in replies["codes"]])
            sorted_shard = _shard_of(context, follower, word_shards, spread)[order]
            c = context[order]
            heads = c[np.append(True, (c[1:] != c[:-1]) | (sorted_shard[1:] != sorted_shard[:-1]))]
            answered = np.concatenate([_of(x, "<i8") for x in replies["contexts"]])
            plain = ~spread[heads]
            count[heads[plain]] = answered[plain]
            count[d] = count[d + 1] = n_docs
            p1 = (count + 1) / (n_total + n_types + 1)
            p = CODEBOOK[codes] + mu / (count[context] + mu) * p1[follower]
            known = count[own] > 0
            base, own_score = np.log10(p1[own]), np.log10(p)[inverse]
            out.append(pd.DataFrame({"doc_id": pd.array(r.doc_ids, dtype="Int64"), "train": train, "n_tokens": np.diff(np.append(start, len(own))), "n_known": np.add.reduceat(known.astype(np.int64), start), "train_tokens": n_total, "base_score": np.add.reduceat(base, start), "score": np.add.reduceat(own_score, start)}))
        return pd.concat(out) if out else pd.DataFrame({c: [] for c in ("doc_id", "train", "n_tokens", "n_known", "train_tokens", "base_score", "score")})

    left = table.select("piece", "doc_ids", "train", "first", "n_words", "shards", "tokens")
    right = answers.where(F.col("piece").isNotNull()).select("piece", "shard", "contexts", "codes", "spread", "spread_counts")
    return left.groupBy("piece").cogroup(right.groupBy("piece")).applyInPandas(finish, "doc_id long, train boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def tries(docs: DataFrame, mu: float = MU, id_col: str = "doc_id", text_col: str = "text", shards: int | None = None) -> DataFrame:
    """The model itself: shard, trie (a block for ``Trie``), for writing as a table."""
    shards = shards or shard_count(docs, text_col)
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"), F.lit(True).alias("train"))
    table = stage(pieces(rows, shards), "lm-pieces")
    heavy = _heavy(table, shards)
    return _answers(_send(table, np.array(sorted(heavy), np.uint64)), heavy, rows.count(), mu, True).where(F.col("trie").isNotNull()).select("shard", "trie")


def held_out(doc_id: Column, fold: int = 2, folds: int = 7) -> Column:
    return F.coalesce(F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % folds == fold, F.lit(False))


def op8_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    out = score(docs, ~held_out(F.col("doc_id")))
    return out.select("doc_id", (~F.col("train")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
