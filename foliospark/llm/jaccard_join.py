"""N-gram Jaccard join of documents by vertical partitioning.

1. Documents with equal n-gram sets are one class. Of every class the first n-grams in hash order are counted over all
   classes; a class that could be linked shares enough of them, so most texts without a partner go here.
2. The n-grams of the rest are counted, and those of more than one class get a global order: by bands of their
   frequency, rarest first, and within a band by ranges of the hash. These cut the order into fragments of about
   equal numbers of occurrences, and every class's set into one segment a fragment.
3. Two linked sets share an n-gram among the first few of either (prefix filter). In the list of each such n-gram every
   class is paired with the first and the last, not with all others. Pairs whose segments' lengths allow the
   similarity are joined with the segments: partial overlaps are counted fragment by fragment and summed by pair.
4. Lists that still hold several components may hide links. Their pairs between components are counted in the
   same way: short lists by a join, long ones in blocks of bounded bytes, fragment by fragment, until the rest of
   the segments can't make up for what is missing; only links that join components come out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read, stage, unstage
from .components import components
from .words import chunks, shingle_sets

#: About how many fragments the global order is cut into.
FRAGMENTS = 16
#: Ids are broadcast up to this number; beyond, joined by shuffle.
BROADCAST_IDS = 1_000_000
#: Lists of more pairs than this are compared in blocks of this many n-grams.
SMALL_LIST, BLOCK = 4096, 200_000
KEYS = ["key_a", "key_b", "n"]


def _least(n, percent: int):  # noqa: ANN001, ANN202 - of numbers and arrays
    """Fewest n-grams that a set of ``n`` shares with one as similar as asked."""
    return (percent * n + 99) // 100


def _least_column(n: Column, percent: int) -> Column:
    return F.floor((n * percent + 99) / 100).cast("long")


def _enough(overlap: Column, percent: int) -> Column:
    return 100 * overlap >= percent * (F.col("na") + F.col("nb") - overlap)


def _sets(docs: DataFrame, shingle: int, percent: int, whole: bool) -> DataFrame:
    """doc_id, n, key_a, key_b and the set's hashes: all, or the first in hash order that any linked set shares enough of."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1).to_pylist()
            for lo, hi in chunks(texts):
                sets = shingle_sets(texts[lo:hi], shingle)
                n = np.array([len(s) for s in sets], np.int64)
                total = lambda s: s.sum(dtype=np.uint64).view(np.int64)
                keys = [np.array([total(s) for s in sets], np.int64), np.array([total(s * (s | np.uint64(1))) for s in sets], np.int64)]
                stop = n if whole else n - _least(n, percent) + 1 + n // 10
                held = [s[:k].view(np.int64) for s, k in zip(sets, stop, strict=True)]
                ends = np.concatenate([[0], np.cumsum([len(s) for s in held])]).astype(np.int32)
                flat = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(held) if held else np.zeros(0, np.int64)))
                yield pa.RecordBatch.from_arrays([ids.slice(lo, hi - lo), pa.array(n), *map(pa.array, keys), flat], names=["doc_id", "n", "key_a", "key_b", "s"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n long, key_a long, key_b long, s array<long>")


def _bounded(df: DataFrame) -> DataFrame:
    """``df`` as a side of a join: broadcast up to a checked number of rows."""
    return F.broadcast(df) if df.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS else df


def _possible(heads: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Classes (row, doc_id and keys) that share enough of their first n-grams with others."""
    own = heads.join(_bounded(classes.select("row")), "row", "left_semi")
    each = own.select("row", "n", F.explode("s").alias("v"))
    common = stage(each.groupBy("v").agg(F.count("*").alias("df")).where("df > 1").select("v"), "common-heads")
    # t = 1 + n // 10 n-grams beyond those that may be missing were taken of each; a partner has at least ceil(s * n) n-grams
    need = 1 + F.floor(_least_column(F.col("n"), percent) / 10)
    shared = each.join(common, "v").groupBy("row", "n").agg(F.count("*").alias("held")).where(F.col("held") >= need)
    out = stage(classes.join(shared.select("row"), "row"), "possible")
    unstage(common)
    return out


def _full_sets(docs: DataFrame, possible: DataFrame, shingle: int, percent: int) -> DataFrame:
    """id, n, s: the whole sets of the possible classes."""
    ids = _bounded(stage(possible.select("doc_id").distinct(), "ids"))
    sets = _sets(docs.join(ids, docs["doc_id"].eqNullSafe(ids["doc_id"]), "left_semi"), shingle, percent, whole=True)
    # rows that repeat an id with another text are other classes; rows that repeat the text, too, are one
    wanted = _bounded(possible.select(F.col("row").alias("id"), F.col("doc_id").alias("own"), *KEYS))
    out = stage(sets.join(wanted, KEYS).where(F.col("doc_id").eqNullSafe(F.col("own"))).select("id", "n", "s"), "full-sets")
    if out.count() > possible.count():
        return stage(out.dropDuplicates(["id"]), "full-sets")
    return out


def _fragment_of(common: DataFrame, fragments: int) -> tuple[Column, int]:
    """The fragment of an n-gram (v, df) and the number of fragments: bands of frequencies that double, cut by hash ranges.

    A row a band, at most 63, comes to the driver.
    """
    band = F.floor(F.log2("df")).cast("int")
    rows = sorted(common.groupBy(band.alias("band")).agg(F.sum("df").alias("n")).collect())
    total, at = sum(r["n"] for r in rows) or 1, 0
    out = F.lit(None).cast("int")
    for r in rows:
        pieces = max(1, round(fragments * r["n"] / total))
        place = F.shiftright(F.shiftright("v", 40).bitwiseAND(0xFFFFFF) * pieces, 24).cast("int")
        out = F.when(band == r["band"], at + place).otherwise(out)
        at += pieces
    return out, max(at, 1)


def _segments(sets: DataFrame, percent: int, fragments: int) -> tuple[DataFrame, DataFrame]:
    """Segments (id, f, s in global order) of the sets, and totals (id, n, size of each segment) of those with enough shared n-grams."""
    each = sets.select("id", "n", F.explode("s").alias("v"))
    common = stage(each.groupBy("v").agg(F.count("*").alias("df")).where("df > 1"), "common-grams")
    fragment, n_fragments = _fragment_of(common, fragments)
    placed = common.select("v", "df", fragment.alias("f"))
    order = F.sort_array(F.collect_list(F.struct("df", "v")))
    cut = stage(each.join(placed, "v").groupBy("id", "n", "f").agg(order.alias("o")).select("id", "n", "f", F.transform("o", lambda x: x["v"]).alias("s")), "segments")
    one = F.transform(F.sequence(F.lit(0), F.lit(n_fragments - 1)), lambda k: F.coalesce(F.element_at("m", k), F.lit(0)))
    totals = cut.groupBy("id", "n").agg(F.map_from_entries(F.collect_list(F.struct("f", F.size("s")))).alias("m")).select("id", "n", one.alias("sizes"))
    held = F.aggregate("sizes", F.lit(0), lambda x, y: x + y)
    totals = stage(totals.where(held >= _least_column(F.col("n"), percent)), "totals")
    unstage(common)
    return cut, totals


def _prefix_lists(segments: DataFrame, totals: DataFrame, percent: int) -> DataFrame:
    """v, id, n, i: the lists of the n-grams among the first of any set; i: the n-gram's place in its set, from 1.

    n-grams that no other class has come first in the order; the first n - ceil(s * n) + 1 suffice.
    """
    before = F.aggregate(F.slice("sizes", F.lit(1), F.col("f")), F.lit(0), lambda x, y: x + y)
    alone = F.col("n") - F.aggregate("sizes", F.lit(0), lambda x, y: x + y)
    placed = segments.drop("n").join(totals, "id").select("id", "n", "s", (alone + before).cast("int").alias("at"))
    take = F.greatest((F.col("n") - _least_column(F.col("n"), percent) + 1).cast("int") - F.col("at"), F.lit(0))
    listed = placed.select("id", "n", "at", F.posexplode(F.slice("s", F.lit(1), take)).alias("p", "v"))
    return listed.select("v", "id", "n", (F.col("at") + F.col("p") + 1).alias("i"))


def _linked(pairs: DataFrame, segments: DataFrame, totals: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) whose overlaps, counted by fragment and summed, reach the similarity."""
    side = lambda k: totals.select(F.col("id").alias(k), F.col("n").alias(f"n{k}"), F.col("sizes").alias(f"z{k}"))
    most = F.aggregate(F.zip_with("za", "zb", lambda x, y: F.least(x, y)), F.lit(0), lambda x, y: x + y)
    able = stage(pairs.join(side("a"), "a").join(side("b"), "b").where(_enough(most, percent)).select("a", "b", "na", "nb"), "able-pairs")
    own = segments.select("id", "f", "s")
    both = able.join(own.select(F.col("id").alias("a"), "f", F.col("s").alias("sa")), "a").join(own.select(F.col("id").alias("b"), "f", F.col("s").alias("sb")), ["b", "f"])
    partial = both.select("a", "b", "na", "nb", F.size(F.array_intersect("sa", "sb")).alias("part"))
    return partial.groupBy("a", "b", "na", "nb").agg(F.sum("part").alias("overlap")).where(_enough(F.col("overlap"), percent)).select("a", "b")


def _block(percent: int, a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
    """Links (a, b) of two blocks of classes (id, n, c: component, sizes, s) that join two components."""
    out: list[tuple[int, int]] = []
    if len(a) and len(b):
        values, place = np.unique(np.concatenate([*a["s"], *b["s"]]), return_inverse=True)
        sizes = np.array([*a["sizes"], *b["sizes"]], np.int64)
        ends = np.cumsum(sizes).reshape(sizes.shape)  # of the segments, a row a set
        rest = np.cumsum(sizes[:, ::-1], axis=1)[:, ::-1] - sizes  # n-grams after each segment
        theirs = []  # each fragment's n-grams of all sets of b, and where each set's begin and end
        for f in range(sizes.shape[1]):
            stop = ends[len(a) :, f]
            parts = [place[e - k : e] for e, k in zip(stop, sizes[len(a) :, f], strict=True)]
            theirs.append((np.concatenate(parts), np.concatenate([[0], np.cumsum(sizes[len(a) :, f])])))
        n2, id2, label = b["n"].to_numpy(), b["id"].to_numpy(), b["c"].to_numpy().copy()
        held = np.zeros(len(values), np.int64)
        for k, (own, n, c) in enumerate(zip(a["id"], a["n"], a["c"], strict=True)):
            overlap = np.zeros(len(b), np.int64)
            able = label != c
            for f, (grams, at) in enumerate(theirs):
                if not able.any():
                    break
                mine = place[ends[k, f] - sizes[k, f] : ends[k, f]]
                held[mine] = 1
                overlap += np.diff(np.concatenate([[0], np.cumsum(held[grams])])[at])
                held[mine] = 0
                most = overlap + np.minimum(rest[k, f], rest[len(a) :, f])
                able &= 100 * most >= percent * (n + n2 - most)
            joined = {c}
            for x in np.flatnonzero(able):
                if label[x] not in joined:
                    joined.add(label[x])
                    out.append((min(own, id2[x]), max(own, id2[x])))
            if len(joined) > 1:
                label[np.isin(label, list(joined))] = c
    return pd.DataFrame(out, columns=["a", "b"], dtype="int64")


def _hidden_links(lists: DataFrame, labels: DataFrame, known: DataFrame, segments: DataFrame, totals: DataFrame, percent: int) -> DataFrame:
    """Links between different components of the lists' classes; ``known`` pairs have been counted already.

    Of two sets the smaller (of equals, of the smaller id) is found by its first n - ceil(2s / (1 + s) * n) + 1 n-grams.
    """
    s = percent / 100
    lists = lists.join(labels, "id", "left").select("v", "id", "n", "i", F.coalesce("component", "id").alias("c"))
    ends = lists.groupBy("v").agg(F.min("c").alias("low"), F.max("c").alias("high")).where("low <> high").select("v")
    short = F.col("i") <= F.col("n") - F.ceil(F.col("n") * (2 * s / (1 + s)) - 1e-9) + 1
    lists = stage(lists.join(ends, "v").withColumn("short", short), "mixed-lists")
    of = lambda c: F.sum(F.when(F.col("short"), F.col(c)).otherwise(0))
    sizes = stage(lists.groupBy("v").agg(of("n").alias("m1"), F.sum("n").alias("m2"), F.count_if("short").alias("n1"), F.count("*").alias("n2")).where("n1 > 0"), "list-sizes")
    large = F.col("n1") * F.col("n2") > SMALL_LIST
    lists = lists.join(sizes.select("v", large.alias("large"), *[F.ceil(F.col(m) / BLOCK).cast("int").alias(k) for m, k in (("m1", "b1"), ("m2", "b2"))]), "v")
    one, two = (lists.where(~F.col("large")).select("v", "short", *[F.col(c).alias(c + k) for c in ("id", "n", "i", "c")]) for k in ("1", "2"))
    smaller = (F.col("n1") < F.col("n2")) | ((F.col("n1") == F.col("n2")) & (F.col("id1") < F.col("id2")))
    enough = 1 + F.least(F.col("n1") - F.col("i1"), F.col("n2") - F.col("i2")) >= s / (1 + s) * (F.col("n1") + F.col("n2")) - 1e-9
    pairs = one.where("short").drop("short").join(two.drop("short"), "v").where(smaller & (F.col("c1") != F.col("c2")) & (F.col("n1") >= s * F.col("n2") - 1e-9) & enough)
    pairs = pairs.select(F.least("id1", "id2").alias("a"), F.greatest("id1", "id2").alias("b")).distinct().join(known, ["a", "b"], "left_anti")
    found = stage(_linked(pairs, segments, totals, percent), "hidden-links")
    long = lists.where("large")
    rows = segments.join(long.select("id").distinct(), "id", "left_semi").groupBy("id").agg(F.sort_array(F.collect_list(F.struct("f", "s"))).alias("o"))
    rows = rows.select("id", F.flatten(F.transform("o", lambda x: x["s"])).alias("s")).join(totals.select("id", "sizes"), "id")
    long = long.join(rows, "id")
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    own = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    columns = ["v", "k1", "k2", "id", "n", "c", "sizes", "s"]
    left = long.where("short").withColumn("k1", own("b1")).withColumn("k2", spread("b2")).select(*[F.col(c).alias(c) for c in columns])
    right = long.withColumn("k2", own("b2")).withColumn("k1", spread("b1")).select(*[F.col(c).alias(c) for c in columns])
    by = columns[:3]
    dense = left.groupBy(*by).cogroup(right.groupBy(*by)).applyInPandas(lambda a, b: _block(percent, a, b), "a long, b long")
    out = stage(found.unionByName(dense).distinct(), "hidden-links")
    unstage(lists, sizes, found)
    return out


def jaccard_join(docs: DataFrame, percent: int = 80, shingle: int = 5, fragments: int = FRAGMENTS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id of each row.

    Rows are linked if 100 * intersection >= percent * union of their sets of word n-grams; component_id is the smallest
    doc_id reachable over links, the row's own included. Sets are compared as 64-bit hashes. Fewer words than an n-gram
    make one n-gram; rows without words (or with a null text) are linked with nothing. Every row is a document of its
    own: rows that repeat an id are linked only by their texts, and a row with a null id takes part, but gives no
    component_id (which is null where nothing reachable has an id). Texts of any length are taken whole, other columns
    are ignored, and an empty table gives an empty one.
    """
    docs = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    heads = stage(_sets(docs, shingle, percent, whole=False).withColumn("row", F.monotonically_increasing_id()), "heads")
    real = heads.where("n > 0")
    grouped = real.groupBy(*KEYS).agg(F.min(F.struct("row", "doc_id")).alias("r"), F.min("doc_id").alias("rep"))
    classes = stage(grouped.select(*KEYS, "r.row", "r.doc_id", "rep"), "classes")
    possible = _possible(heads, classes, percent)
    sets = _full_sets(docs, possible, shingle, percent)
    segments, totals = _segments(sets, percent, fragments)
    unstage(sets)
    lists = stage(_prefix_lists(segments, totals, percent), "prefix-lists")
    ends = stage(lists.groupBy("v").agg(F.min("id").alias("low"), F.max("id").alias("high")).where("low <> high"), "list-ends")
    star = lists.join(ends, "v").select("id", F.explode(F.array("low", "high")).alias("hub")).where("id <> hub")
    pairs = stage(star.select(F.least("id", "hub").alias("a"), F.greatest("id", "hub").alias("b")).distinct(), "star-pairs")
    links = stage(_linked(pairs, segments, totals, percent), "links")
    more = _hidden_links(lists, components(links), pairs, segments, totals, percent)
    labels = components(links.unionByName(more))
    named = labels.join(classes.select(F.col("row").alias("id"), "rep"), "id")
    least = named.groupBy("component").agg(F.min("rep").alias("least"))
    joined = named.join(least, "component").select(F.col("id").alias("row"), "least")
    placed = classes.join(joined, "row", "left").select(*KEYS, F.coalesce("least", "rep").alias("component_id"))
    # classes of one text need no join back
    out = heads.select("doc_id", *KEYS).join(placed.withColumnsRenamed({k: f"_{k}" for k in KEYS}), [F.col(k) == F.col(f"_{k}") for k in KEYS], "left")
    alone = F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component_id"))
    out = stage(out.select("doc_id", F.col("n").alias("n_shingles"), alone.alias("component_id")), "jaccard-join")
    unstage(heads, classes, possible, segments, totals, lists, ends, pairs, links, more)
    return out


def op13_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join(read(spark, sf_dir, "documents"), percent=85, shingle=4)


_W = r"[^\x20\x09-\x0D]+"
ORACLE_SQL = {
    "op13_jaccard_join": rf"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS k, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_W}') AS ws FROM documents),
 g AS (SELECT k, list_distinct(CASE WHEN len(ws) >= 4 THEN list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i:i + 3], ' ')) WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS grams FROM d),
 s AS (SELECT k, unnest(grams) AS gram FROM g),
 p AS (SELECT a.k AS a, b.k AS b, count(*) AS shared FROM s a JOIN s b ON a.gram = b.gram AND a.k <> b.k GROUP BY ALL),
 l AS (SELECT p.a, p.b FROM p JOIN g x ON x.k = p.a JOIN g y ON y.k = p.b WHERE 100 * shared >= 85 * (len(x.grams) + len(y.grams) - shared)),
 r AS (SELECT k, k AS reached FROM d UNION SELECT r.k, l.b FROM r JOIN l ON l.a = r.reached),
 c AS (SELECT r.k, min(d.doc_id) AS component_id FROM r JOIN d ON d.k = r.reached GROUP BY r.k)
SELECT d.doc_id, len(g.grams)::BIGINT AS n_shingles, c.component_id FROM d JOIN g ON g.k = d.k JOIN c ON c.k = d.k"""
}
