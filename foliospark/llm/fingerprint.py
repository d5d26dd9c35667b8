"""Document fingerprints: bottom-k sketches of word-shingle hashes.

A text's sketch is the k smallest distinct 64-bit hashes of its shingles (n words in a row, A-Z lower-cased; with
fewer words the whole sequence is one shingle), ascending. Sketches of parts merge into the sketch of the
whole, and give estimates of resemblance, containment and the number of distinct shingles; with fewer than k
shingles these are exact. A row's sketch is made inside the row, so it takes no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import ascii_lower, let, read

K = 128
SHINGLE = 5
_SPACES = "[\\x20\\x09-\\x0D]+"
_LOWEST = -(1 << 63)
_CELLS = 256


def sketch(text: Column, k: int = K, n: int = SHINGLE) -> Column:
    """array<bigint>; a text that is null or has no words has an empty sketch."""

    def shingles(h: Column) -> Column:
        run = F.transform(F.sequence(F.lit(0), F.size(h) - n), lambda i: F.xxhash64(*[F.get(h, i + j) for j in range(n)]))
        return F.when(F.size(h) >= n, run).when(F.size(h) > 0, F.array(F.xxhash64(h))).otherwise(F.array().cast("array<bigint>"))

    words = F.filter(F.split(ascii_lower(F.coalesce(text, F.lit(""))), _SPACES), lambda w: w != "")
    hashes = F.transform(words, lambda w: F.xxhash64(w))
    return F.slice(F.sort_array(F.array_distinct(let(hashes, shingles))), 1, k)


def merge(a: Column, b: Column, k: int = K) -> Column:
    """Sketch of the union of what two sketches stand for."""
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def merge_parts(parts: DataFrame, keys: list[str], sketch_col: str = "sketch", k: int = K) -> DataFrame:
    """Sketch of all rows of each key. Each task keeps k hashes of a key at most before the shuffle."""
    rows = parts.select(*keys, F.explode(sketch_col).alias("_h")).distinct()
    rank = F.row_number().over(W.partitionBy(*keys).orderBy("_h"))
    kept = rows.withColumn("_r", rank).where(F.col("_r") <= k).groupBy(*keys).agg(F.sort_array(F.collect_list("_h")).alias(sketch_col))
    lone = parts.select(*keys).distinct()
    same = [lone[c].eqNullSafe(kept[c]) for c in keys]
    return lone.join(kept, same, "left").select(*[lone[c] for c in keys], F.coalesce(kept[sketch_col], F.array().cast("array<bigint>")).alias(sketch_col))


def distinct_count(s: Column, k: int = K) -> Column:
    """Number of distinct shingles."""
    largest = (F.element_at(s, -1).cast("double") - F.lit(float(_LOWEST)) + 1) / F.lit(2.0**64)
    return F.when(F.size(s) < k, F.size(s).cast("double")).otherwise((k - 1) / largest)


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Jaccard similarity, 0 to 1; of two empty sketches 1."""
    shared = let(merge(a, b, k), lambda u: F.size(F.array_intersect(F.array_intersect(u, a), b)) / F.size(u))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).otherwise(shared)


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Share of a's shingles that b has, 0 to 1; 1 if a is empty."""
    inter = resemblance(a, b, k) * distinct_count(merge(a, b, k), k)
    return F.when(F.size(a) == 0, 1.0).otherwise(F.least(F.lit(1.0), inter / distinct_count(a, k)))


def packed(s: Column) -> Column:
    """The sketch as a string: base64 of its hashes, 8 big-endian bytes each."""
    return F.translate(F.base64(F.unhex(F.array_join(F.transform(s, lambda h: F.lpad(F.hex(h), 16, "0")), ""))), "\r\n", "")


def with_next(docs: DataFrame, id_col: str, columns: list[str]) -> DataFrame:
    """``docs`` (of these columns) and next_<column>: values of the next row by ascending id, after the last those of the first.

    Null ids come first; rows of equal ids are in the order of the columns. The rows are dealt into blocks of
    neighbouring ids (quantile cells, each cut evenly), and each block's first row is sent to the block before
    as well, so a window within blocks suffices and no task holds more than a block.
    """
    spark = docs.sparkSession
    key = F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(_LOWEST))
    rows = docs.select(F.col(f"`{id_col}`"), *columns, key.alias("_key"))
    cuts = rows.agg(F.percentile_approx("_key", [i / _CELLS for i in range(_CELLS + 1)], 10_000)).first()[0] or []
    cuts = sorted(set(cuts))
    per_cell = -(-8 * int(spark.conf.get("spark.sql.shuffle.partitions")) // _CELLS)
    bounds = F.array(*map(F.lit, cuts)) if cuts else F.array(F.lit(0))
    cell = F.size(F.filter(bounds, lambda b: b <= F.col("_key")))
    low, high = (F.coalesce(F.get(bounds, F.col("_cell") - j), F.col("_key")).cast("double") for j in (1, 0))
    part = F.when(high > low, F.floor((F.col("_key").cast("double") - low) / (high - low) * per_cell)).otherwise(0)
    rows = rows.withColumn("_cell", cell).withColumn("_block", F.col("_cell").cast("long") * per_cell + F.least(F.lit(per_cell - 1), part).cast("long"))
    firsts = rows.groupBy("_block").agg(F.min("_key").alias("_first"))  # at most 8 rows a shuffle partition, or 257
    before = F.lag("_block").over(W.orderBy("_block"))
    firsts = firsts.select("_first", F.coalesce(before, F.max("_block").over(W.orderBy("_block").rowsBetween(W.unboundedPreceding, W.unboundedFollowing))).alias("_before"))
    both = rows.join(F.broadcast(firsts), F.col("_key") == F.col("_first"), "left")
    both = both.withColumn("_at", F.explode(F.when(F.col("_before").isNull(), F.array(F.struct(F.col("_block").alias("block"), F.lit(0).alias("guest")))).otherwise(F.array(F.struct(F.col("_block").alias("block"), F.lit(0).alias("guest")), F.struct(F.col("_before").alias("block"), F.lit(1).alias("guest"))))))
    both = both.select(id_col, *columns, "_key", F.col("_at.block").alias("_block"), F.col("_at.guest").alias("_guest"))
    order = W.partitionBy("_block").orderBy("_guest", "_key", *columns)
    for c in columns:
        both = both.withColumn(f"next_{c}", F.lead(c).over(order))
    return both.where(F.col("_guest") == 0).select(id_col, *columns, *[f"next_{c}" for c in columns])


def fingerprints(docs: DataFrame, k: int = K, n: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_chars, sketch of each row. Null texts are empty; repeated rows stay; other columns go."""
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    return docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.char_length(text).cast("long").alias("n_chars"), sketch(text, k, n).alias("sketch"))


def op4_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    pairs = with_next(docs.withColumn("sketch", sketch(F.col("text"))), "doc_id", ["text", "sketch"])
    n = F.char_length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - half), F.substring(F.col("next_text"), F.lit(1), half))
    pairs = pairs.select("doc_id", n.cast("long").alias("n_chars"), "sketch", "next_sketch", edited.alias("edited"))
    digest = let(F.struct(F.col("edited").alias("t"), sketch(F.col("edited")).alias("s")), lambda e: F.struct(F.sha2(e["t"], 256).alias("sha"), packed(e["s"]).alias("fp"), resemblance(e["s"], F.col("sketch")).alias("near")))
    pairs = pairs.select("doc_id", "n_chars", packed(F.col("sketch")).alias("fingerprint"), resemblance(F.col("sketch"), F.col("next_sketch")).alias("near_next"), distinct_count(F.col("sketch")).alias("n_shingles"), digest.alias("e"))
    return pairs.select("doc_id", "n_chars", F.col("e.sha").alias("edited_sha256"), "fingerprint", F.col("e.fp").alias("edited_fingerprint"), F.col("e.near").alias("near_edited"), "near_next", "n_shingles")
