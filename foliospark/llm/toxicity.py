"""Toxicity: a linear classifier over character n-grams scaled by naive Bayes log-count ratios.

Training takes labelled rows up to a documented bound, which bounds all else. Each n-gram's presence is counted over
toxic and clean training texts on the executors; the ratio r = log((p/|p|) / (q/|q|)) of its smoothed counts, with
sums over all n-grams, scales the feature. The n-grams whose counts differ most between the classes (by likelihood
ratio) make the feature table; how many is chosen by cross-validation over folds of the training rows, with counts,
ratios and fits of the other folds only, and goes on growing while the held-out loss falls. A logistic regression over
the scaled presences is fitted on the training rows' active features. Scoring looks the table's n-grams up in whole texts, in
pieces of bounded length, without any shuffle.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read, stage, unstage
from .words import chunks

ORDERS = (3, 4, 5, 6)
#: Bound on labelled rows for fitting; which rows: a hash of the id.
MAX_ROWS = 20_000
#: Folds of the cross-validation, and the numbers of features that it begins with; it goes on in the same steps while the largest brings the loss below this share of the others' least.
FOLDS, SIZES, GAIN = 3, (32, 128, 512, 2048, 8192), 0.98
#: Bound on training rows that the cross-validation fits and scores; its counts and ratios are of all training rows.
FOLD_ROWS = 3000
THRESHOLD = 0.7
_PIECE = 400_000  # characters handled at once
_PRIME = np.uint64(0x9E3779B97F4A7C15)
_FILTER_BITS = 20


@dataclass
class Model:
    grams: np.ndarray  # hashes, ascending
    weights: np.ndarray  # of the scaled presences, times the ratios
    bias: float

    def __post_init__(self) -> None:
        self.filter = np.zeros(1 << _FILTER_BITS, dtype=bool)
        self.filter[_slot(self.grams)] = True

    def active(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Rows and indices of the features that occur in each text, once each."""
        m, pairs = len(self.grams) + 1, [np.zeros(0, np.int64)]
        for codes, owner in _pieces(texts):
            mine = [np.zeros(0, np.int64)]
            for h in _grams(codes):
                at = np.flatnonzero(self.filter[_slot(h)])
                k = np.searchsorted(self.grams, h[at])
                k[k == len(self.grams)] = 0
                hit = self.grams[k] == h[at] if len(self.grams) else np.zeros(len(at), bool)
                mine.append(owner[at[hit]] * m + k[hit])
            pairs.append(np.unique(np.concatenate(mine)))  # a gram that a piece repeats is kept once
        pair = np.unique(np.concatenate(pairs))
        return pair // m, pair % m

    def score(self, texts: list[str | None]) -> np.ndarray:
        out = [np.zeros(0)]
        for lo, hi in chunks(texts, 4 * _PIECE):
            rows, found = self.active(texts[lo:hi])
            z = self.bias + (np.bincount(rows, self.weights[found], minlength=hi - lo) if len(found) else np.zeros(hi - lo))
            out.append(1 / (1 + np.exp(-np.clip(z, -35, 35))))
        return np.concatenate(out)


def _slot(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)


def _pieces(texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Code points of lower-cased texts, a blank at both ends and 0 between, with each one's row; long texts in overlapping pieces."""
    held, owners, size, overlap = [], [], 0, max(ORDERS) - 1
    for row, text in enumerate(texts):
        padded = f" {(text or '').lower()} "
        for at in range(0, max(1, len(padded) - overlap), _PIECE):
            piece = padded[at : at + _PIECE + overlap]
            held.append(piece + "\0")
            owners.append((row, len(piece) + 1))
            size += len(piece)
            if size >= _PIECE:
                yield _codes(held, owners)
                held, owners, size = [], [], 0
    if held:
        yield _codes(held, owners)


def _codes(held: list[str], owners: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
    codes = np.frombuffer("".join(held).encode("utf-32-le", "replace"), dtype=np.uint32)
    rows, lengths = zip(*owners, strict=True)
    return codes, np.repeat(np.array(rows), lengths)


def _grams(codes: np.ndarray) -> Iterator[np.ndarray]:
    """Hashes of the n-grams that begin at each place, an array for each order. Those that hold the separator are 0."""
    c = codes.astype(np.uint64)
    h, bad = c + np.uint64(1), codes == 0
    for n in range(2, max(ORDERS) + 1):
        if len(h) < 2:
            return
        h = h[:-1] * _PRIME + c[n - 1 :] + np.uint64(n)
        bad = bad[:-1] | (codes[n - 1 :] == 0)
        if n in ORDERS:
            mixed = (h ^ (h >> np.uint64(29))) * _PRIME
            mixed[bad] = 0
            yield mixed


_COUNTS = [f"{c}{k}" for k in range(FOLDS) for c in "pq"]


def _count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Of each n-gram: in how many toxic (p) and clean (q) texts of each fold it is present."""
    for batch in batches:
        texts, kind = batch["text"].tolist(), (2 * batch["fold"] + 1 - batch["toxic"]).to_numpy(np.int64)
        at = 0
        while at < len(texts):  # about a piece of text at a time
            stop, size = at, 0
            while stop < len(texts) and (stop == at or size < _PIECE):
                size += len(texts[stop] or "")
                stop += 1
            keys, seen = [], []
            for codes, owner in _pieces(texts[at:stop]):
                for h in _grams(codes):
                    keys.append(h)
                    seen.append(owner[: len(h)])
            if keys:
                h, row = np.concatenate(keys), np.concatenate(seen)
                order = np.lexsort((row, h))
                h, row = h[order], row[order]
                first = np.ones(len(h), bool)
                first[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
                first &= h != 0
                h, own = h[first], kind[at + row[first]]
                new = np.flatnonzero(np.r_[True, h[1:] != h[:-1]]) if len(h) else np.zeros(0, np.int64)
                if len(new):
                    yield pd.DataFrame({"gram": h[new].view(np.int64)} | {c: np.add.reduceat(own == k, new, dtype=np.int64) for k, c in enumerate(_COUNTS)})
            at = stop


def ratios(p: np.ndarray, q: np.ndarray, total_p: float, total_q: float) -> np.ndarray:
    """Naive Bayes log-count ratios of presence counts, smoothed by one."""
    return np.log((p + 1) / total_p) - np.log((q + 1) / total_q)


def _fit_logistic(lengths: np.ndarray, features: np.ndarray, scale: np.ndarray, y: np.ndarray, l2: float = 0.1, steps: int = 25) -> tuple[np.ndarray, float]:
    """L2-regularised logistic regression on sparse scaled presences, by Newton steps solved with preconditioned conjugate gradients.

    ``features``: the rows' active features one after another, ``lengths`` of each. Products are taken some rows at a time.
    """
    n, m = len(y), len(scale)
    ends = np.append(0, np.cumsum(lengths))
    cuts = [(lo, min(n, lo + 1000)) for lo in range(0, n, 1000)]
    theta = np.zeros(m + 1)  # the bias is last and not penalised
    theta[m] = np.log((y.sum() + 1) / (n - y.sum() + 1))
    penalty = np.append(np.full(m, l2), 1e-6)

    def forward(t: np.ndarray) -> np.ndarray:
        w = scale * t[:m]
        return t[m] + np.concatenate([np.bincount(np.repeat(np.arange(hi - lo), lengths[lo:hi]), w[features[ends[lo] : ends[hi]]], minlength=hi - lo) for lo, hi in cuts])

    def backward(g: np.ndarray, by: np.ndarray) -> np.ndarray:
        out = np.zeros(m)
        for lo, hi in cuts:
            out += np.bincount(features[ends[lo] : ends[hi]], np.repeat(g[lo:hi], lengths[lo:hi]), minlength=m)
        return np.append(out * by, g.sum())

    def loss(t: np.ndarray, z: np.ndarray) -> float:
        return float(np.sum(np.logaddexp(0, z) - y * z) + 0.5 * np.sum(penalty * t * t))

    z = forward(theta)
    now = loss(theta, z)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z, -35, 35)))
        gradient, curve = backward(p - y, scale) + penalty * theta, np.maximum(p * (1 - p), 1e-6)
        diagonal = backward(curve, scale * scale) + penalty
        step, rest = np.zeros(m + 1), -gradient
        way = rest / diagonal
        size = first = rest @ way
        for _ in range(60):
            if size <= 1e-6 * first or size == 0:
                break
            bent = backward(curve * forward(way), scale) + penalty * way
            a = size / (way @ bent)
            step += a * way
            rest = rest - a * bent
            eased = rest / diagonal
            way, size = eased + rest @ eased / size * way, rest @ eased
        length, z = 1.0, forward(theta + step)
        while length > 1e-4 and (new := loss(theta + length * step, z)) > now:
            length /= 2
            z = forward(theta + length * step)
        if length <= 1e-4 or now - new < 1e-6 * n:
            break
        theta, now = theta + length * step, new
    return theta[:m], float(theta[m])


def _statistic(p: Column, q: Column, toxic: int, clean: int) -> Column:
    """Likelihood ratio (chi-square of one degree) of an n-gram's presence counts in the two classes."""
    n, here = toxic + clean, p + q
    cells = [(p, here, toxic), (q, here, clean), (toxic - p, n - here, toxic), (clean - q, n - here, clean)]
    return sum(F.when(o > 0, 2 * o * F.log(o * float(n) / (row * float(column)))).otherwise(0.0) for o, row, column in cells)


@dataclass
class _Part:
    """What the rows outside one fold (-1: all rows) say of the n-grams: the best ones, their ratios."""

    grams: np.ndarray  # best first
    ratios: np.ndarray


def _best(counts: DataFrame, fold: int, n_rows: np.ndarray, size: int) -> _Part | None:
    """The ``size`` n-grams with the highest statistic outside a fold, ties by their hashes; None without both classes."""
    kept = [k for k in range(FOLDS) if k != fold]
    toxic, clean = (int(n_rows[kept, c].sum()) for c in (0, 1))
    if not toxic or not clean:
        return None
    p, q = (sum((F.col(f"{c}{k}") for k in kept), F.lit(0)) for c in "pq")
    own = counts.select("gram", p.alias("p"), q.alias("q")).where("p + q > 0")
    sums = own.agg(F.coalesce(F.sum(F.col("p") + 1), F.lit(1)), F.coalesce(F.sum(F.col("q") + 1), F.lit(1))).first()
    table = own.orderBy(_statistic(F.col("p"), F.col("q"), toxic, clean).desc(), "gram").limit(size).toPandas()
    return _Part(table["gram"].to_numpy(np.int64).view(np.uint64), ratios(table["p"].to_numpy(float), table["q"].to_numpy(float), float(sums[0]), float(sums[1])))


@dataclass
class _Rows:
    """Training rows with their active n-grams of a list: compressed differences of ascending places, unpacked some rows at a time."""

    y: np.ndarray
    fold: np.ndarray
    packed: list[bytes]

    def blocks(self, step: int = 1000) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
        """Rows, how many n-grams each has, and these."""
        for lo in range(0, len(self.y), step):
            found = [np.cumsum(np.frombuffer(zlib.decompress(x), "<i4")) for x in self.packed[lo : lo + step]]
            yield slice(lo, lo + len(found)), np.array([len(x) for x in found]), np.concatenate(found)

    def fit(self, listed: np.ndarray, part: _Part, size: int, chosen: np.ndarray, **kind: int) -> tuple[np.ndarray, float]:
        """Weight of each listed n-gram (0: not among the first ``size`` of the part) and bias, from the chosen rows."""
        place = np.full(len(listed), -1, np.int32)
        own = np.searchsorted(listed, part.grams[:size])
        place[own] = np.arange(len(own))
        lengths, features = [], []
        for rows, n, found in self.blocks():
            at = place[found]
            keep = np.repeat(chosen[rows], n) & (at >= 0)
            lengths.append(np.bincount(np.repeat(np.arange(len(n)), n)[keep], minlength=len(n))[chosen[rows]])
            features.append(at[keep])
        w, bias = _fit_logistic(np.concatenate(lengths), np.concatenate(features), part.ratios[:size], self.y[chosen], **kind)
        out = np.zeros(len(listed))
        out[own] = w * part.ratios[:size]
        return out, bias

    def loss(self, weights: np.ndarray, bias: float, chosen: np.ndarray) -> float:
        z = bias + np.concatenate([np.bincount(np.repeat(np.arange(len(n)), n), weights[found], minlength=len(n)) for _, n, found in self.blocks()])
        return float(np.sum((np.logaddexp(0, z) - self.y * z)[chosen]))


def _presences(rows: DataFrame, grams: np.ndarray) -> _Rows:
    """Training rows, of a bounded number, with the n-grams of the list that they have."""
    shared = rows.sparkSession.sparkContext.broadcast(Model(grams, np.zeros(len(grams)), 0.0))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = batch["text"].tolist()
            for lo, hi in chunks(texts, 4 * _PIECE):
                row, found = shared.value.active(texts[lo:hi])
                each = np.split(found, np.searchsorted(row, np.arange(1, hi - lo)))
                yield pd.DataFrame({c: batch[c].to_numpy()[lo:hi] for c in ("toxic", "fold")} | {"found": [zlib.compress(np.diff(x, prepend=0).astype("<i4").tobytes(), 1) for x in each]})

    table = rows.mapInPandas(run, "toxic int, fold int, found binary").toPandas()
    return _Rows(table["toxic"].to_numpy(np.float64), table["fold"].to_numpy(np.int64), table["found"].tolist())


def train(labelled: DataFrame, max_rows: int = MAX_ROWS, features: int | None = None, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """Fit on up to about ``max_rows`` labelled rows (label 1: toxic, 0: not; rows with other labels are left out).

    ``features`` fixes their number; else it is chosen by cross-validation. Without rows of both classes the model is its
    prior, by which empty training sets score 0.5. Null texts are empty, very long ones are taken whole; repeated rows
    count as often as they occur (and are in one fold); ids only choose rows and folds.
    """
    rows = labelled.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"), F.col(f"`{label_col}`").cast("int").alias("toxic")).where(F.col("toxic").isin(0, 1))
    n = rows.count()
    if n > max_rows:
        rows = rows.where(F.pmod(F.xxhash64("id"), F.lit(1_000_000)) < int(1_000_000 * max_rows / n))
    rows = stage(rows.withColumn("fold", F.pmod(F.xxhash64("text"), F.lit(FOLDS)).cast("int")), "toxic-train")
    n_rows = np.zeros((FOLDS, 2), np.int64)
    for r in rows.groupBy("fold", "toxic").count().collect():
        n_rows[r["fold"], 1 - r["toxic"]] = r["count"]
    toxic, clean = (int(x) for x in n_rows.sum(axis=0))
    if not toxic or not clean:
        return Model(np.zeros(0, np.uint64), np.zeros(0), float(np.log((toxic + 1) / (clean + 1))))
    counts = rows.select("text", "toxic", "fold").mapInPandas(_count, ", ".join(f"{c} long" for c in ("gram", *_COUNTS))).groupBy("gram").agg(*[F.sum(c).cast("int").alias(c) for c in _COUNTS])
    counts = stage(counts, "toxic-grams")
    if features:
        size, whole = features, _best(counts, -1, n_rows, features)
    else:
        sizes, losses, few = list(SIZES), [], rows
        if toxic + clean > FOLD_ROWS:
            few = rows.where(F.pmod(F.xxhash64("text", F.lit("fold")), F.lit(1_000_000)) < int(1_000_000 * FOLD_ROWS / (toxic + clean)))
        while len(losses) < len(sizes):
            parts = {k: p for k in range(-1, FOLDS) if (p := _best(counts, k, n_rows, sizes[-1]))}
            listed = np.unique(np.concatenate([p.grams for p in parts.values()]))
            held = _presences(few, listed)
            for size in sizes[len(losses) :]:
                fits = [(k, *held.fit(listed, p, size, held.fold != k, steps=10)) for k, p in parts.items() if k >= 0]
                losses.append(sum(held.loss(w, b, held.fold == k) for k, w, b in fits))
            if losses[-1] < GAIN * min(losses[:-1]) and len(parts[-1].grams) == sizes[-1]:
                sizes.append(4 * sizes[-1])
        size, whole = sizes[int(np.argmin(losses))], parts[-1]
    listed = np.sort(whole.grams[:size])
    held = _presences(rows, listed)
    weights, bias = held.fit(listed, whole, size, np.ones(len(held.y), bool))
    unstage(counts, rows)
    return Model(listed, weights, bias)


def score(spark: SparkSession, text: Column, model: Model) -> Column:
    """Probability that a text is toxic (0 to 1); a null text scores as an empty one, equal texts alike, whatever their length."""
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def _score(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            yield pd.Series(shared.value.score(batch.tolist()))

    return _score(text)


def training_rows(docs: DataFrame, labels: DataFrame, fold: int = 1, folds: int = 3) -> DataFrame:
    """Labelled documents outside the held-out fold (crc32 of the id as text, modulo ``folds``).

    Documents without labels, or with a null id, and labels without documents, give no rows; repeated ones are joined
    as they are. Empty tables give no rows.
    """
    kept = labels.where(~held_out(F.col("doc_id"), fold, folds)).select("doc_id", "toxic")
    return docs.select("doc_id", "text").join(kept, "doc_id")


def held_out(doc_id: Column, fold: int = 1, folds: int = 3) -> Column:
    return F.coalesce(F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % folds == fold, F.lit(False))


def reject_toxic(docs: DataFrame, model: Model, threshold: float = THRESHOLD, text_col: str = "text") -> DataFrame:
    """``docs`` without the rows that score at or above ``threshold``; repeated rows are treated alike, all columns stay."""
    return docs.where(score(docs.sparkSession, F.col(f"`{text_col}`"), model) < threshold)


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = train(training_rows(docs, read(spark, sf_dir, "labels")))
    out = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), score(spark, F.col("text"), model).alias("score"))
    return out.withColumn("predicted", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0))
