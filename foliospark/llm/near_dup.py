"""Near-duplicate documents by bottom-k sketches of one hash function.

1. Each document's shingle set gives its size, a key of the whole set and the k smallest hashes. Documents with
   equal sets are one class, stood for by the smallest id.
2. Inverted lists of the lowest retained values give candidates. Two sketches of sets as similar as asked share
   most values, so it suffices to index each class's rarest ones (prefix filter); values that very many classes
   hold hardly ever are.
3. Within a list every class is paired with its smallest and its largest member, not with all others. Pairs pass
   an estimate from the union's sketch, then an exact comparison of the full sets. Links give components.
4. Classes of lists that still hold several components, and so might hide a link, are indexed once more by the
   rarest values of their full sets (an exact prefix filter), and pairs of a list in different components are
   compared. Large groups of copies are one component by now and give no pairs; texts that only have a passage
   in common are told apart by the rest of them.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read, stage, unstage
from .components import components
from .words import chunks, shingle_sets

K = 128
#: How many of a sketch's values are indexed.
INDEXED = 32
#: Chance with which two sets of just the asked similarity may share fewer sketch values than counted on.
MISS = 1e-9
#: Broadcast ids of documents that take part up to this number; join by shuffle beyond.
BROADCAST_IDS = 1_000_000
#: Lists of more pairs than this are compared in blocks of this many shingles.
SMALL_LIST, BLOCK = 4096, 200_000


def sketches(docs: DataFrame, shingle: int, k: int) -> DataFrame:
    """doc_id, n (set size), key_a and key_b (of the whole set), sketch (ascending unsigned, as signed longs)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = batch["text"].tolist()
            for lo, hi in chunks(texts):
                sets = shingle_sets(texts[lo:hi], shingle)
                total = lambda s: int(s.sum(dtype=np.uint64).view(np.int64))
                yield pd.DataFrame({"doc_id": batch["doc_id"].iloc[lo:hi], "n": [len(s) for s in sets], "key_a": [total(s) for s in sets], "key_b": [total(s * (s | np.uint64(1))) for s in sets], "sketch": [s[:k].view(np.int64) for s in sets]})

    return docs.mapInPandas(run, "doc_id long, n long, key_a long, key_b long, sketch array<long>")


def _surely(similarity: float, k: int) -> float:
    """Share of k values that two sets of the similarity share but for a chance of ``MISS``: the binomial tail, which bounds that of draws without replacement."""
    tail = 0.0
    for t in range(k + 1):
        tail += comb(k, t) * similarity**t * (1 - similarity) ** (k - t)
        if tail > MISS:
            return t / k
    return 1.0


def candidates(classes: DataFrame, values: str, sure: float) -> DataFrame:
    """v, id, m, i: lists of the classes (id, array of m values) by their rarest values; i: the value's place in that order, from 1.

    Two classes that share at least ``sure`` of either's values are together in a list at least: of m values in
    one order for all, the first m - ceil(sure * m) + 1 suffice (prefix filter); the order is rarest first.
    """
    rows = classes.select("id", F.size(values).alias("m"), F.explode(values).alias("v"))
    # written before the join, here and below, so that the join's sides are plain shuffles whose hot partitions can be split
    common = stage(rows.groupBy("v").agg(F.count("*").alias("df")).where(F.col("df") > 1), "common-values")
    held = rows.join(common, "v").groupBy("id", "m").agg(F.sort_array(F.collect_list(F.struct("df", "v"))).alias("held"))
    # the m - size(held) values that no other class has are the rarest
    prefix = F.col("m") - F.ceil(F.col("m") * sure - 1e-9).cast("int") + 1 - (F.col("m") - F.size("held"))
    listed = held.where(prefix > 0).select("id", "m", F.size("held").alias("h"), F.posexplode(F.slice("held", F.lit(1), prefix)).alias("p", "x"))
    return listed.select(F.col("x.v").alias("v"), "id", "m", (F.col("m") - F.col("h") + F.col("p") + 1).alias("i"))


def _estimated(pairs: DataFrame, reps: DataFrame, similarity: float, k: int) -> DataFrame:
    """Pairs whose sizes and union sketches allow the similarity."""
    a = reps.select(F.col("id").alias("a"), F.col("n").alias("na"), F.col("sketch").alias("sa"))
    b = reps.select(F.col("id").alias("b"), F.col("n").alias("nb"), F.col("sketch").alias("sb"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        least = _surely(similarity, k)
        for batch in batches:
            keep = []
            for x, y, nx, ny in zip(batch["sa"], batch["sb"], batch["na"], batch["nb"], strict=True):
                x, y = np.asarray(x, np.int64).view(np.uint64), np.asarray(y, np.int64).view(np.uint64)
                union = np.union1d(x, y)[:k]
                shared = len(np.intersect1d(np.intersect1d(x, y, assume_unique=True), union, assume_unique=True))
                exact = nx < k and ny < k
                keep.append(shared >= (similarity if exact else least) * len(union) - 1e-9)
            yield batch.loc[keep, ["a", "b"]]

    sized = pairs.join(a, "a").join(b, "b").where((F.col("na") >= similarity * F.col("nb") - 1e-9) & (F.col("nb") >= similarity * F.col("na") - 1e-9))
    return sized.select("a", "b", "na", "nb", "sa", "sb").mapInPandas(run, "a long, b long").distinct()


def _full_sets(docs: DataFrame, ids: DataFrame, shingle: int) -> DataFrame:
    """id, s: the shingle sets of some documents."""
    ids = stage(ids.distinct(), "ids")
    if ids.count() <= BROADCAST_IDS:
        ids = F.broadcast(ids)

    def whole(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = batch["text"].tolist()
            for lo, hi in chunks(texts):
                yield pd.DataFrame({"id": batch["doc_id"].iloc[lo:hi], "s": [s.view(np.int64) for s in shingle_sets(texts[lo:hi], shingle)]})

    return stage(docs.join(ids, "doc_id", "left_semi").mapInPandas(whole, "id long, s array<long>"), "shingle-sets")


def _compare(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) whose sets (id, s) reach the similarity: 100 * intersection >= percent * union."""

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            keep = []
            for x, y in zip(batch["sa"], batch["sb"], strict=True):
                inter = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * inter >= percent * (len(x) + len(y) - inter))
            yield batch.loc[keep, ["a", "b"]]

    both = pairs.join(sets.select(F.col("id").alias("a"), F.col("s").alias("sa")), "a").join(sets.select(F.col("id").alias("b"), F.col("s").alias("sb")), "b")
    return both.mapInPandas(compare, "a long, b long").distinct()


def _verified(pairs: DataFrame, docs: DataFrame, shingle: int, percent: int) -> DataFrame:
    """Pairs whose documents' full sets reach the similarity."""
    sets = _full_sets(docs, pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")), shingle)
    out = stage(_compare(pairs, sets, percent), "near-links")
    unstage(sets)
    return out


def _hidden_links(full: DataFrame, labels: DataFrame, known: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) between different components of the classes with these full sets; ``known`` pairs have been compared already.

    Of two sets the one of fewer values (of equals, of the smaller id) is found by its first m - ceil(2s / (1 + s) m)
    + 1 rarest values among the other's first m - ceil(s m) + 1. Lists of few pairs are joined; those of many are
    compared in blocks of bounded bytes, of which only links that join two components come out.
    """
    s = percent / 100
    lists = candidates(full, "s", s).join(labels, "id", "left").select("v", "id", "m", "i", F.coalesce("component", "id").alias("c"))
    lists = stage(lists.withColumn("short", F.col("i") <= F.col("m") - F.ceil(F.col("m") * (2 * s / (1 + s)) - 1e-9) + 1), "exact-lists")
    sizes = lists.groupBy("v").agg(F.count_if("short").alias("n1"), F.count("*").alias("n2"), F.sum(F.when(F.col("short"), F.col("m")).otherwise(0)).alias("m1"), F.sum("m").alias("m2"), F.min("c").alias("low"), F.max("c").alias("high"))
    sizes = sizes.where((F.col("n1") > 0) & (F.col("low") != F.col("high"))).withColumn("large", F.col("n1") * F.col("n2") > SMALL_LIST)
    sizes = stage(sizes, "list-sizes")
    lists = lists.join(sizes.select("v", *[F.ceil(F.col(c) / BLOCK).cast("int").alias(b) for c, b in (("m1", "b1"), ("m2", "b2"))], "large"), "v")
    one, two = (lists.select("v", "large", "short", *[F.col(c).alias(c + k) for c in ("id", "m", "i", "c")]) for k in ("1", "2"))
    smaller = (F.col("m1") < F.col("m2")) | ((F.col("m1") == F.col("m2")) & (F.col("id1") < F.col("id2")))
    enough = 1 + F.least(F.col("m1") - F.col("i1"), F.col("m2") - F.col("i2")) >= s / (1 + s) * (F.col("m1") + F.col("m2")) - 1e-9
    pairs = one.where(~F.col("large") & F.col("short")).drop("large", "short").join(two.where(~F.col("large")).drop("large", "short"), "v").where(smaller & (F.col("c1") != F.col("c2")) & (F.col("m1") >= s * F.col("m2") - 1e-9) & enough)
    pairs = pairs.select(F.least("id1", "id2").alias("a"), F.greatest("id1", "id2").alias("b")).distinct().join(known, ["a", "b"], "left_anti")
    sets = full.select("id", "s")
    found = _compare(pairs, sets, percent)
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    large = lists.where("large").join(sets, "id")
    left = large.where("short").withColumn("k1", F.pmod(F.xxhash64("id"), F.col("b1")).cast("int")).withColumn("k2", spread("b2"))
    right = large.withColumn("k2", F.pmod(F.xxhash64("id"), F.col("b2")).cast("int")).withColumn("k1", spread("b1"))

    def block(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple[int, int]] = []
        if len(a) and len(b):
            values, place = np.unique(np.concatenate([*a["s"], *b["s"]]), return_inverse=True)
            ends = np.cumsum([len(x) for x in (*a["s"], *b["s"])])
            starts = np.append(0, ends[:-1])
            theirs, first = place[starts[len(a)] :], starts[len(a) :] - starts[len(a)]
            m2, id2 = b["m"].to_numpy(), b["id"].to_numpy()
            label = b["c"].to_numpy().copy()  # components so far; only links that join two come out
            held = np.zeros(len(values), np.int64)
            for k, (own, m, c) in enumerate(zip(a["id"], a["m"], a["c"], strict=True)):
                mine = place[starts[k] : ends[k]]
                held[mine] = 1
                inter = np.add.reduceat(held[theirs], first)
                held[mine] = 0
                hit = np.flatnonzero(100 * inter >= percent * (m + m2 - inter))
                joined = {c: c}
                for x in hit:
                    if label[x] not in joined:
                        joined[label[x]] = c
                        out.append((min(own, id2[x]), max(own, id2[x])))
                if len(joined) > 1:
                    label[np.isin(label, list(joined))] = c
        return pd.DataFrame(out, columns=["a", "b"])

    by, columns = ["v", "k1", "k2"], ["v", "k1", "k2", "id", "m", "c", "s"]
    left, right = (x.select(*[F.col(c).alias(c) for c in columns]) for x in (left, right))
    dense = left.groupBy(*by).cogroup(right.groupBy(*by)).applyInPandas(block, "a long, b long")
    return stage(found.unionByName(dense).distinct(), "near-links")


def near_duplicates(docs: DataFrame, percent: int = 80, shingle: int = 5, k: int = K, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, kept of each row.

    Documents whose shingle sets have a Jaccard similarity of ``percent`` or more are linked; component_id is the
    smallest id reachable over links, itself included, and kept tells that it is the row's own. Two texts of just the
    asked similarity may fail to meet in a list of sketch values with a chance of 1e-9. Ids must be integers or cast to
    them. Texts without words (or null) are linked with nothing. Rows of equal id count as one document that has all their links;
    rows with a null id are linked with nothing, have a null component_id and are kept. Texts of any length are
    taken whole. An empty table gives an empty table; other columns are ignored.
    """
    docs = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    sigs = stage(sketches(docs, shingle, k), "sketches")
    real = sigs.where((F.col("n") > 0) & F.col("doc_id").isNotNull())
    keys = ["key_a", "key_b", "n"]
    classes = real.groupBy(*keys).agg(F.min("doc_id").alias("rep"))
    members = real.select("doc_id", *keys).distinct().join(classes, keys).select("doc_id", "rep")
    nodes = members.groupBy("doc_id").agg(F.min("rep").alias("rep"), F.max("rep").alias("other"))
    same_id = nodes.where(F.col("rep") != F.col("other")).select("doc_id", F.col("rep").alias("a")).join(members, "doc_id").select("a", F.col("rep").alias("b")).where(F.col("a") != F.col("b"))
    reps = stage(real.join(classes, keys).where(F.col("doc_id") == F.col("rep")).select(F.col("rep").alias("id"), "sketch", *keys).dropDuplicates(["id", "n", "key_a", "key_b"]).select("id", "n", "sketch"), "classes")
    lists = stage(candidates(reps.withColumn("sketch", F.slice("sketch", 1, INDEXED)), "sketch", _surely(percent / 100, INDEXED)), "lists")
    ends = stage(lists.groupBy("v").agg(F.min("id").alias("low"), F.max("id").alias("high")).where(F.col("low") != F.col("high")), "list-ends")
    star = lists.join(ends, "v").select("id", F.explode(F.array("low", "high")).alias("hub"))
    star = star.where(F.col("id") != F.col("hub")).select(F.least("id", "hub").alias("a"), F.greatest("id", "hub").alias("b")).distinct()
    star = stage(star, "star-pairs")
    similarity = percent / 100
    pairs = stage(_estimated(star, reps, similarity, k), "pairs")
    links = _verified(pairs, docs, shingle, percent)
    unstage(ends)
    labels = components(links)
    labelled = lists.join(labels, "id", "left").select("v", "id", F.coalesce("component", "id").alias("c"))
    mixed = labelled.groupBy("v").agg(F.min("c").alias("least"), F.max("c").alias("most")).where(F.col("least") != F.col("most")).select("v")
    mixed = stage(mixed, "mixed-lists")
    # classes of lists that still hold several components: now by the rarest values of their full sets
    full = _full_sets(docs, labelled.join(mixed, "v", "left_semi").select(F.col("id").alias("doc_id")), shingle)
    more = _hidden_links(full, labels, pairs, percent)
    labels = components(links.unionByName(more).unionByName(same_id))
    placed = nodes.join(labels, F.col("rep") == F.col("id"), "left").select("doc_id", F.coalesce("component", "rep").alias("component_id"))
    out = sigs.select("doc_id", F.col("n").alias("n_shingles")).join(placed, "doc_id", "left")
    own = F.coalesce("component_id", "doc_id")
    out = stage(out.select("doc_id", "n_shingles", own.alias("component_id"), (F.coalesce(own == F.col("doc_id"), F.lit(True))).alias("kept")), "near-duplicates")
    unstage(sigs, reps, lists, star, pairs, links, mixed, full, more)
    return out


def drop_near_duplicates(docs: DataFrame, percent: int = 80, shingle: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one document of each group: that of the smallest id. Rows with a null id stay."""
    gone = near_duplicates(docs, percent, shingle, id_col=id_col, text_col=text_col).where(~F.col("kept")).select("doc_id").distinct()
    return docs.join(gone, docs[f"`{id_col}`"].cast("long") == gone["doc_id"], "left_anti")


def op9_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents"), percent=85, shingle=3)


_W = r"[^\x20\x09-\x0D]+"
ORACLE_SQL = {
    "op9_near_duplicates": rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_W}') AS ws FROM documents),
 i AS (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 1, CASE WHEN len(ws) > 0 THEN 2 ELSE 1 END))) AS k FROM w),
 s AS (SELECT DISTINCT doc_id, array_to_string(list_slice(ws, k, k + 2), ' ') AS sh FROM i),
 n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
 p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id),
 l AS (SELECT p.a, p.b FROM p JOIN n x ON x.doc_id = p.a JOIN n y ON y.doc_id = p.b WHERE 100 * shared >= 85 * (x.n + y.n - shared)),
 r AS (SELECT doc_id, doc_id AS to_id FROM documents UNION SELECT r.doc_id, l.b FROM r JOIN l ON l.a = r.to_id),
 c AS (SELECT doc_id, min(to_id) AS component_id FROM r GROUP BY doc_id)
SELECT c.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, c.component_id, c.doc_id = c.component_id AS kept FROM c LEFT JOIN n ON n.doc_id = c.doc_id"""
}
