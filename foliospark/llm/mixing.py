"""Mixing sources to target weights along a time-varying curriculum.

Each source gets a token target (its weight's share of all tokens, at most ``cap`` times its own size, the
excess reshared by weight) and a weight schedule over training time. The schedule's integral, scaled to the
target, is the source's cumulative demand; inverting that at the place where a document begins in its
source's token stream gives the document's training position. Documents come out range-sorted by position.

Sources may be hot: running sums are taken within (source, hash bucket) and shifted by the buckets' offsets,
so no window ever holds more than a bucket.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import WORD, read, stage

#: Relative weight over training time (0 to 1), piecewise linear through these knots, for each slot of ``WEIGHTS``.
WEIGHTS = (5, 2, 1)
SCHEDULES = (((0.0, 1.5), (1.0, 0.5)), ((0.0, 1.0), (1.0, 1.0)), ((0.0, 0.5), (0.5, 1.0), (1.0, 1.5)))
CAP = 3


def source_targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """source (null is a source of its own, last in order), source_size -> + slot, target.

    Weights repeat over the sources in code-point order. A source is held at its cap if filling every source
    in proportion to weight up to the level at which it is full needs no more than there is.
    """
    name, n = [F.col("source").asc_nulls_last()], len(weights)
    ranked = running(sizes.withColumn("one", F.lit(1)), name, ["one"])
    ranked = ranked.withColumn("slot", (F.col("one_before") % n).cast("int")).withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), F.col("slot") + 1).cast("long"))
    ranked = ranked.select("source", "source_size", "slot", "weight", (cap * F.col("source_size")).alias("most"), (cap * F.col("source_size") / F.col("weight")).alias("level"))
    filled = stage(running(ranked, [F.col("level").asc(), *name], ["most", "weight"]), "mix-levels")
    totals = filled.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("weight"), F.lit(0))).first()
    full = F.col("most_before") * F.col("weight") + F.col("most") * (totals[1] - F.col("weight_before")) <= totals[0] * F.col("weight")
    filled = filled.withColumn("full", full)
    rest = filled.agg(totals[0] - F.coalesce(F.sum(F.when(F.col("full"), F.col("most"))), F.lit(0)), F.sum(F.when(~F.col("full"), F.col("weight")))).first()
    target = F.when(F.col("full"), F.col("most").cast("double")).otherwise((F.lit(rest[0]) * F.col("weight")).cast("double") / F.lit(rest[1]))
    return filled.select("source", "source_size", "slot", target.alias("target"))


def running(rows: DataFrame, order: list[Column], sums: list[str]) -> DataFrame:
    """``rows`` and <name>_before: the sum of a column over all rows before one in ``order``.

    Rows are range-partitioned; sums within a partition are shifted by what those before it hold, so no task has all.
    """
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = stage(rows.repartitionByRange(n, *order).withColumn("_part", F.spark_partition_id()), "mix-ranges")
    totals = parts.groupBy("_part").agg(*[F.sum(c).alias(f"_{c}") for c in sums])  # a row for each partition
    earlier = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    totals = totals.select("_part", *[F.coalesce(F.sum(f"_{c}").over(earlier), F.lit(0)).alias(f"_{c}") for c in sums])
    within = W.partitionBy("_part").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    out = parts.join(F.broadcast(totals), "_part")
    return out.select(*rows.columns, *[(F.col(f"_{c}") + F.sum(c).over(within) - F.col(c)).alias(f"{c}_before") for c in sums])


def _segments(knots: Sequence[tuple[float, float]]) -> list[tuple[float, ...]]:
    """(start, slope, weight at start, area before) for each piece of a schedule, area scaled to 1."""
    area, out = 0.0, []
    total = sum((b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in zip(knots, knots[1:], strict=False))
    for (t0, w0), (t1, w1) in zip(knots, knots[1:], strict=False):
        out.append((t0, (w1 - w0) / (t1 - t0) / total, w0 / total, area))
        area += (t1 - t0) * (w0 + w1) / 2 / total
    return out


def training_position(share: Column, slot: Column, schedules: Sequence[Sequence[tuple[float, float]]] = SCHEDULES) -> Column:
    """When cumulative demand reaches ``share`` (0 to 1) of the target: the inverse of the schedule's integral."""
    out = F.lit(None).cast("double")
    for k, knots in enumerate(schedules):
        piece = F.lit(None).cast("double")
        for start, slope, weight, area in _segments(knots):
            y = share - F.lit(area)
            at = F.lit(start) + 2 * y / (F.lit(weight) + F.sqrt(F.greatest(F.lit(0.0), F.lit(weight * weight) + 2 * F.lit(slope) * y)))
            piece = F.when(y >= 0, F.when(y > 0, at).otherwise(F.lit(start))).otherwise(piece)
        out = F.when(slot == k, piece).otherwise(out)
    return out


def _key(id_col: str, text_col: str, source_col: str) -> Column:
    """128 bits of a row's id, text and source, nulls told from empty values."""
    columns = [F.col(f"`{c}`") for c in (id_col, text_col, source_col)]
    parts = [*columns, *[c.isNull() for c in columns]]
    return F.struct(F.xxhash64(*parts).alias("a"), F.xxhash64(F.lit("b"), *reversed(parts)).alias("b"))


def mix(docs: DataFrame, *args, **options) -> DataFrame:
    """``placed`` without its key."""
    return placed(docs, *args, **options).drop("key").orderBy(F.col("position").asc_nulls_last(), "doc_id")


def placed(docs: DataFrame, weights: Sequence[int] = WEIGHTS, schedules: Sequence[Sequence[tuple[float, float]]] = SCHEDULES, cap: int = CAP, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """A row for each row of ``docs``: doc_id, key, source, size, source_size, target, taken, positions, position.

    key: a hash (128 bits) of the row's id, text and source.

    size: words of the text (null: 0). taken: words that the mix takes; a source's sum to its target, rounded.
    Whole passes over the source come first, then a last one, in hash order of the ids, that ends within one
    document. positions: training positions (0 to 1) at which the document's copies begin, ascending, empty
    if nothing is taken; position: the first, null if there is none. ``mix`` range-sorts the rows by position.

    Null sources are a source of their own; rows with null ids are in order of a hash of their texts; repeated rows
    are documents of their own; texts of any length are taken whole; without rows or words nothing is taken; other
    columns are ignored.
    """
    text = F.col(f"`{text_col}`")
    unnamed = F.concat(F.lit("null "), F.md5(F.coalesce(text, F.lit(""))))  # rows without ids are spread by their texts
    place = F.md5(F.coalesce(F.col(f"`{id_col}`").cast("string"), unnamed))
    rows = stage(docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{source_col}`").cast("string").alias("source"), F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long").alias("size"), place.alias("place"), F.substring(place, 1, 3).alias("bucket"), _key(id_col, text_col, source_col).alias("key")), "mix-sizes")
    buckets = rows.groupBy("source", "bucket").agg(F.sum("size").alias("bucket_size"))
    sources = source_targets(buckets.groupBy("source").agg(F.sum("bucket_size").alias("source_size")), weights, cap)
    before = F.sum("bucket_size").over(W.partitionBy("source").orderBy("bucket").rowsBetween(W.unboundedPreceding, 0)) - F.col("bucket_size")
    by_bucket = buckets.withColumn("before", before).alias("b").join(sources.alias("s"), F.col("b.source").eqNullSafe(F.col("s.source"))).select("b.source", "bucket", "before", "source_size", "slot", "target")
    inner = W.partitionBy("source", "bucket").orderBy("place", F.col("doc_id").asc_nulls_first(), "size").rowsBetween(W.unboundedPreceding, 0)
    out = rows.withColumn("within", F.sum("size").over(inner) - F.col("size")).alias("d").join(by_bucket.alias("o"), F.col("d.source").eqNullSafe(F.col("o.source")) & (F.col("d.bucket") == F.col("o.bucket")))
    starts, goal = (F.col("before") + F.col("within")).alias("start"), F.round("target").cast("long").alias("goal")
    out = out.select("doc_id", "key", "d.source", "size", "source_size", "target", "slot", starts, goal)
    passes = F.when(F.col("source_size") > 0, F.floor(F.col("goal") / F.col("source_size"))).otherwise(0).cast("long")
    out = out.withColumn("passes", passes)
    rest = F.col("goal") - F.col("passes") * F.col("source_size")
    taken = F.col("passes") * F.col("size") + F.greatest(F.lit(0), F.least(rest - F.col("start"), F.col("size")))
    begins = F.filter(F.transform(F.sequence(F.lit(0), F.col("passes")), lambda k: k * F.col("source_size") + F.col("start")), lambda x: (x < F.col("goal")) & (F.col("size") > 0))
    at = F.transform(begins, lambda x: F.round(training_position(x.cast("double") / F.col("goal"), F.col("slot"), schedules), 9))
    out = out.select("doc_id", "key", "source", "size", "source_size", "target", taken.alias("taken"), at.alias("positions"))
    return out.withColumn("position", F.get("positions", F.lit(0)))


def apply_mix(docs: DataFrame, **options) -> DataFrame:
    """``docs`` as the mix takes them, with their own columns: a row for each copy, ordered by training position.

    Copies are whole documents; the one that the last pass cuts is kept if at least half of it is taken. Rows that
    agree in id, text and source are taken as one of them (by a hash of all else) as often as all of them together.
    """
    names = [options.get(f"{c}_col", d) for c, d in (("id", "doc_id"), ("text", "text"), ("source", "source"))]
    copies = placed(docs, **options).where(F.col("size") > 0)
    whole = F.slice("positions", F.lit(1), F.round(F.col("taken") / F.col("size")).cast("int"))
    copies = copies.select("key", F.explode(whole).alias("at"))
    columns = {c: docs[f"`{c}`"] for c in docs.columns}
    rest = F.xxhash64(F.to_json(F.struct(*[v for c, v in columns.items() if c not in names])) if set(columns) - set(names) else F.lit(0))
    rows = docs.select(_key(*names).alias("key"), rest.alias("rest"), F.struct(*columns.values()).alias("row"))
    rows = rows.withColumn("n", F.row_number().over(W.partitionBy("key").orderBy("rest"))).where("n = 1").select("key", "row")
    return rows.join(copies, "key").orderBy("at", "key").select("row.*")


def op5_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mix(read(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "source_size", "target", "taken", F.size("positions").alias("copies"), "position")


def _sql_position(share: str, slot: str) -> str:
    cases = ""
    for k, knots in enumerate(SCHEDULES):
        whens = "".join(f" WHEN {share} - {a!r} > 0 THEN {s!r} + 2.0 * ({share} - {a!r}) / ({w!r} + sqrt(greatest(0.0, {w * w!r} + 2.0 * {m!r} * ({share} - {a!r})))) WHEN {share} - {a!r} >= 0 THEN {s!r}" for s, m, w, a in reversed(_segments(knots)))
        cases += f" WHEN {slot} = {k} THEN CASE{whens} END"
    return f"CASE{cases} END"


def _double(sql: str) -> str:
    import re

    return re.sub(r"(?<![\w.])(\d+\.\d+(?:e-?\d+)?)(?![\w.])", r"\1::DOUBLE", sql)


ORACLE_SQL = {
    "op5_mix_sources": f"""
WITH d AS (SELECT doc_id, source, md5(coalesce(CAST(doc_id AS VARCHAR), 'null ' || md5(coalesce(text, '')))) AS place,
             coalesce(len(regexp_extract_all(text, '{WORD}')), 0)::BIGINT AS size FROM documents),
 s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
 r AS (SELECT *, ((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3)::INT AS slot FROM s),
 m AS (SELECT *, {CAP} * source_size AS most, CASE slot WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END::BIGINT AS weight FROM r),
 f AS (SELECT *, (sum(source_size) OVER ())::BIGINT AS total,
        (sum(most) OVER (ORDER BY most::DOUBLE / weight, source ASC NULLS LAST ROWS UNBOUNDED PRECEDING) - most)::BIGINT AS below,
        (sum(weight) OVER (ORDER BY most::DOUBLE / weight, source ASC NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::BIGINT AS open FROM m),
 c AS (SELECT *, below * weight + most * open <= total * weight AS is_full FROM f),
 t AS (SELECT source, source_size, slot, CASE WHEN is_full THEN most::DOUBLE ELSE
        ((total - sum(CASE WHEN is_full THEN most ELSE 0 END) OVER ()) * weight)::DOUBLE / (sum(CASE WHEN is_full THEN 0 ELSE weight END) OVER ())::DOUBLE END AS target FROM c),
 p AS (SELECT d.doc_id, d.size, t.source_size, t.target, t.slot, round(t.target)::BIGINT AS goal,
        (sum(d.size) OVER (PARTITION BY d.source ORDER BY place, d.doc_id ASC NULLS FIRST, d.size ROWS UNBOUNDED PRECEDING) - d.size)::BIGINT AS start
        FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
 q AS (SELECT *, CASE WHEN source_size > 0 THEN goal // source_size ELSE 0 END AS passes FROM p),
 z AS (SELECT *, greatest(0, least(goal - passes * source_size - start, size)) AS part, start::DOUBLE / nullif(goal, 0)::DOUBLE AS share FROM q)
SELECT doc_id, size, source_size, target, (passes * size + part)::BIGINT AS taken,
  (CASE WHEN size = 0 THEN 0 ELSE passes + CASE WHEN passes * source_size + start < goal THEN 1 ELSE 0 END END)::INT AS copies,
  CASE WHEN size > 0 AND start < goal THEN round({_double(_sql_position("share", "slot"))}, 9) END AS position FROM z"""
}
