"""Approximate nearest neighbours: a hierarchical k-means tree searched best bin first.

The tree is fitted on a bounded sample; every distinct vector is then assigned to its leaf. A query walks the
tree through a priority queue of nodes by distance to their centres, so leaves come up nearest first; how many
it visits is calibrated: a bounded set of sample queries is searched exactly over all rows, and visits widen
until their neighbours' leaves are reached for the wanted share. Visits join their leaves' vectors by leaf,
leaves and queries cut into blocks of bounded size. Copies of a vector are indexed once, with as many of their
smallest ids as can matter.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import read, stage

K = 10
TARGET_RECALL = 0.97
#: Bound on the numbers in the sample that the tree is fitted on (vectors times dimensions), and on its vectors.
SAMPLE_VALUES, SAMPLE_ROWS = 4_000_000, 50_000
CALIBRATION_QUERIES = 256
BRANCHING = 16
LEAF_ROWS, LEAF_SAMPLE = 128, 24
BLOCK_ROWS, BLOCK_QUERIES = 4096, 512


@dataclass
class Tree:
    centres: np.ndarray  # of nodes; the root is 0
    children: list[list[int]]  # empty: a leaf
    counts: dict[int, int] = field(default_factory=dict)  # indexed vectors by leaf

    def assign(self, x: np.ndarray) -> np.ndarray:
        """Leaf of each vector: the nearest child, level by level."""
        at = np.zeros(len(x), np.int64)
        open_nodes = {0: np.arange(len(x))}
        while open_nodes:
            node, rows = open_nodes.popitem()
            below = self.children[node]
            if not below or not len(rows):
                at[rows] = node
                continue
            best = _nearest(x[rows], self.centres[below])
            for j, child in enumerate(below):
                open_nodes[child] = rows[best == j]
        return at

    def leaves(self, q: np.ndarray) -> Iterator[int]:
        """Leaves, best bin first."""
        queue = [(0.0, 0)]
        while queue:
            _, node = heapq.heappop(queue)
            below = self.children[node]
            if not below:
                yield node
                continue
            d = ((self.centres[below] - q) ** 2).sum(axis=1)
            for child, far in zip(below, d, strict=True):
                heapq.heappush(queue, (float(far), child))

    def visits(self, q: np.ndarray, n_leaves: int, n_vectors: int) -> list[int]:
        """The first ``n_leaves`` leaves, and more until they hold ``n_vectors`` vectors."""
        out, held = [], 0
        for leaf in self.leaves(q):
            if not self.counts.get(leaf):
                continue
            if len(out) >= n_leaves and held >= n_vectors:
                break
            out.append(leaf)
            held += self.counts[leaf]
        return out


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    out = np.empty(len(x), np.int64)
    norm = (centres**2).sum(axis=1)
    for i in range(0, len(x), 8192):
        out[i : i + 8192] = np.argmin(norm - 2 * x[i : i + 8192] @ centres.T, axis=1)
    return out


def _kmeans(x: np.ndarray, k: int, rng: np.random.Generator, steps: int = 8) -> tuple[np.ndarray, np.ndarray]:
    centres = x[rng.choice(len(x), k, replace=False)]
    for _ in range(steps):
        own = _nearest(x, centres)
        for j in range(k):
            mine = x[own == j]
            if len(mine):
                centres[j] = mine.mean(axis=0)
    return centres, _nearest(x, centres)


def fit_tree(sample: np.ndarray, n_indexed: int, branching: int = BRANCHING, seed: int = 0) -> Tree:
    """Split until leaves stand for ``LEAF_ROWS`` indexed vectors or have fewer than ``LEAF_SAMPLE`` sample vectors to split."""
    rng = np.random.default_rng(seed)
    centres, children = [sample.mean(axis=0) if len(sample) else np.zeros(1)], [[]]
    least = max(LEAF_SAMPLE, LEAF_ROWS * len(sample) / max(1, n_indexed))
    todo = [(0, np.arange(len(sample)))]
    while todo:
        node, rows = todo.pop()
        k = min(branching, int(len(rows) // least))
        if k < 2:
            continue
        mid, own = _kmeans(sample[rows].copy(), k, rng)
        parts = [(mid[j], rows[own == j]) for j in range(k) if (own == j).any()]
        if len(parts) < 2:
            continue
        for centre, mine in parts:
            centres.append(centre)
            children.append([])
            children[node].append(len(centres) - 1)
            todo.append((len(centres) - 1, mine))
    return Tree(np.array(centres), children)


def usable(vec: Column) -> Column:
    """Neither null nor zero, and all components finite numbers."""
    finite = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(vec.isNotNull() & finite & F.exists(vec, lambda x: x != 0), F.lit(False))


def _matrix(vecs: pd.Series) -> np.ndarray:
    return np.array(vecs.tolist(), dtype=np.float64) if len(vecs) else np.zeros((0, 1))


def _exact(index: DataFrame, queries: np.ndarray, k: int) -> pd.DataFrame:
    """q (place in ``queries``), key, leaf of the exact k nearest distinct vectors, over all rows in blocks."""
    shared = index.sparkSession.sparkContext.broadcast(queries)

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        q = shared.value
        best = [pd.DataFrame({"q": [], "d": [], "key": [], "leaf": []})]
        for batch in batches:
            x = _matrix(batch["vec"])
            d = (q**2).sum(axis=1)[:, None] - 2 * q @ x.T + (x**2).sum(axis=1)
            top = np.argsort(d, axis=1)[:, :k]
            n = top.shape[1]
            best = [pd.concat([*best, pd.DataFrame({"q": np.repeat(np.arange(len(q)), n), "d": np.take_along_axis(d, top, 1).ravel(), "key": batch["key"].to_numpy()[top.ravel()], "leaf": batch["leaf"].to_numpy()[top.ravel()]})]).sort_values("d").groupby("q").head(k)]
        yield best[0].astype({"q": "int64", "key": "int64", "leaf": "int64"})

    near = index.select("key", "vec", "leaf").mapInPandas(search, "q long, d double, key long, leaf long")
    rank = F.row_number().over(W.partitionBy("q").orderBy("d", "key"))
    return near.withColumn("r", rank).where(F.col("r") <= k).toPandas()


def calibrate(tree: Tree, index: DataFrame, queries: np.ndarray, keys: np.ndarray, k: int, target: float) -> int:
    """Leaves to visit so that ``target`` of the queries' true neighbours are in them."""
    if not len(queries):
        return 1
    true = _exact(index, queries, k + 1)
    ranks = []
    for q, mine in true.groupby("q"):
        place = {leaf: i + 1 for i, leaf in enumerate(x for x in tree.leaves(queries[q]) if tree.counts.get(x))}
        ranks += [place[leaf] for leaf, key in zip(mine["leaf"], mine["key"], strict=True) if key != keys[q]]
    return int(np.quantile(ranks, target, method="higher")) if ranks else 1


def nearest(vectors: DataFrame, queries: DataFrame, k: int = K, target_recall: float = TARGET_RECALL, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: of each row of ``queries`` its k nearest rows of ``vectors`` with another id.

    score is the Euclidean distance in double precision; ties go to the smaller id. Vectors that are null, zero
    or hold null or non-finite components take no part, nor do those of another length than most (of equally
    common lengths the smallest counts) or with a null id. Rows of ``vectors`` that repeat count once. An empty
    table gives no rows; other columns are ignored.
    """
    spark = vectors.sparkSession

    def clean(df: DataFrame) -> DataFrame:
        df = df.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{vec_col}`").cast("array<double>").alias("vec"))
        return df.where(F.col("id").isNotNull() & usable(F.col("vec")))

    rows = clean(vectors)
    common = rows.groupBy(F.size("vec").alias("n")).count().orderBy(F.desc("count"), "n").first()
    dim = common[0] if common else 0
    rows, asked = rows.where(F.size("vec") == dim), clean(queries).where(F.size("vec") == dim)
    first = F.row_number().over(W.partitionBy("vec").orderBy("id"))
    distinct = rows.distinct().withColumn("r", first).where(F.col("r") <= k + 1).groupBy("vec").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    distinct = stage(distinct.select(F.xxhash64("vec").alias("key"), "vec", "ids"), "ann-distinct")
    n = distinct.count()
    share = min(1.0, min(SAMPLE_ROWS, SAMPLE_VALUES / max(1, dim)) / max(1, n))
    drawn = distinct.where(F.pmod(F.col("key"), F.lit(1_000_003)) < share * 1_000_003).select("key", "vec").orderBy("key").toPandas()
    sample, keys = _matrix(drawn["vec"]), drawn["key"].to_numpy()
    tree = fit_tree(sample, n)
    shared = spark.sparkContext.broadcast(tree)

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                yield batch.assign(leaf=shared.value.assign(_matrix(batch["vec"])))

    index = stage(distinct.mapInPandas(place, "key long, vec array<double>, ids array<long>, leaf long"), "ann-index")
    counts = index.groupBy("leaf").count()  # at most SAMPLE_ROWS / LEAF_SAMPLE rows
    tree.counts = {r["leaf"]: r["count"] for r in counts.collect()}
    some = np.linspace(0, len(sample) - 1, min(CALIBRATION_QUERIES, len(sample))).astype(int)
    width = calibrate(tree, index, sample[some], keys[some], k, target_recall)
    shared_counts = spark.sparkContext.broadcast(tree)

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), 64):
                part = batch.iloc[at : at + 64]
                found = [shared_counts.value.visits(q, width, k + 1) for q in _matrix(part["vec"])]
                out = part.assign(leaf=found).explode("leaf").dropna(subset=["leaf"])
                yield out.astype({"leaf": "int64"})

    asked = asked.withColumn("key", F.xxhash64("vec"))
    walked = stage(asked.groupBy("key").agg(F.first("vec").alias("vec")).mapInPandas(walk, "key long, vec array<double>, leaf long"), "ann-visits")
    blocks = counts.withColumnRenamed("count", "n").join(walked.groupBy("leaf").agg(F.count("*").alias("nq")), "leaf")
    blocks = blocks.select("leaf", F.ceil(F.col("n") / BLOCK_ROWS).cast("int").alias("cuts"), F.ceil(F.col("nq") / BLOCK_QUERIES).cast("int").alias("q_cuts"))
    blocks = F.broadcast(blocks)  # one row a leaf
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    cands = index.join(blocks, "leaf").withColumn("cut", F.pmod("key", "cuts").cast("int")).withColumn("q_cut", spread("q_cuts")).select("leaf", "cut", "q_cut", "vec", "ids")
    asks = walked.join(blocks, "leaf").withColumn("q_cut", F.pmod("key", "q_cuts").cast("int")).withColumn("cut", spread("cuts")).select("leaf", "cut", "q_cut", "key", "vec")

    def compare(cand: pd.DataFrame, ask: pd.DataFrame) -> pd.DataFrame:
        x, q = _matrix(cand["vec"]), _matrix(ask["vec"])
        lowest = np.array([i[0] for i in cand["ids"]], np.int64)
        out: list[tuple[int, float, int]] = []
        for key, v in zip(ask["key"], q, strict=True) if len(cand) else ():
            d = np.sqrt(((x - v) ** 2).sum(axis=1))
            edge = np.partition(d, k)[k] if len(d) > k + 1 else np.inf
            near = np.flatnonzero(d <= edge)
            near = near[np.lexsort((lowest[near], d[near]))][: k + 1]
            best = sorted((float(d[i]), int(x_id)) for i in near for x_id in cand["ids"].iat[i])[: k + 1]
            out += [(key, far, x_id) for far, x_id in best]
        return pd.DataFrame(out, columns=["key", "score", "vec_id"])

    by = ["leaf", "cut", "q_cut"]
    found = cands.groupBy(*by).cogroup(asks.groupBy(*by)).applyInPandas(compare, "key long, score double, vec_id long")
    order = [F.col("score"), F.col("vec_id")]
    found = found.withColumn("r", F.row_number().over(W.partitionBy("key").orderBy(*order))).where(F.col("r") <= k + 1).drop("r")
    each = asked.select(F.col("id").alias("query_id"), "key").distinct().join(found, "key").where(F.col("vec_id") != F.col("query_id"))
    each = each.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(*order))).where(F.col("rank") <= k)
    return each.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op7_nearest_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read(spark, sf_dir, "embeddings")
    return nearest(vectors, vectors.where(F.col("vec_id") % 100 == 0))
