"""Pairing of images with labels and truth, splits, rankings and batches."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..checkpoints import ensure
from ..functions.text import stem


def pair_labels(images: DataFrame, labels: DataFrame, path: str = "path") -> DataFrame:
    """image, label: the label file of the same name, that of the image's own extension first; null if there is none."""
    i = images.select(F.col(path).alias("image"), stem(F.col(path)).alias("_s"), F.substring_index(path, ".", -1).alias("_e"))
    k = labels.select(F.col(path).alias("label"), stem(F.col(path)).alias("_s"), F.substring_index(path, ".", -1).alias("_k"))
    both = i.join(k, "_s", "left")
    best = F.min(F.when(F.col("label").isNotNull(), F.struct((F.col("_k") != F.col("_e")).alias("other"), "label")))
    return both.groupBy("image").agg(best.alias("b")).select("image", F.col("b.label").alias("label"))


def latest(paths: DataFrame, by: list[str], path: str = "path") -> DataFrame:
    """The last path of each group in code-point order, such as the newest of exports named by time."""
    return paths.groupBy(*by).agg(F.max(path).alias(path))


def require(wanted: DataFrame, there: DataFrame, path: str = "path") -> None:
    """Raise FileNotFoundError for the first of the wanted paths that don't exist."""
    gone = wanted.select(path).join(there.select(path), path, "left_anti").orderBy(path).limit(1).collect()
    if gone:
        raise FileNotFoundError(gone[0][0])


def first_existing(candidates: DataFrame, there: DataFrame, key: str) -> DataFrame:
    """key, path: of each key's candidates (key, priority, path) the one of least priority that exists."""
    return candidates.join(there.select("path").distinct(), "path", "left_semi").groupBy(key).agg(F.min_by("path", "priority").alias("path"))


def split_sample(rows: DataFrame, key: str, share: float = 0.15, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """A sample of round(share * rows) rows, the same each time, and the rest. Ranks come from a hash's order, by bucket, so no task ranks all rows."""
    h = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(key).cast("string")))
    hashed = rows.withColumn("_h", h).withColumn("_b", F.substring("_h", 1, 3))
    counts = hashed.groupBy("_b").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(W.orderBy("_b").rowsBetween(W.unboundedPreceding, 0)) - F.col("_n")
    all_rows = F.sum("_n").over(W.partitionBy())
    counts = counts.select("_b", before.alias("_before"), all_rows.alias("_all"))
    rank = F.row_number().over(W.partitionBy("_b").orderBy("_h", key))
    placed = hashed.withColumn("_r", rank).join(counts, "_b")
    chosen = F.col("_before") + F.col("_r") <= F.bround(F.col("_all") * share)
    keep = rows.columns
    return placed.where(chosen).select(*keep), placed.where(~chosen).select(*keep)


def numbered(rows: DataFrame, by: list[str], order: list[str], out: str = "place") -> DataFrame:
    """Adds ``out``: the row's number from 0 within ``by`` in ``order``, without a task that sees a whole group.

    Rows are range-partitioned by both and written as a checkpoint; a row's number is the rows of its group in
    earlier partitions, of which there are a few a partition to add up, and its number within its own. Rows that agree
    in ``by`` and ``order`` are numbered as they come.
    """
    ensure(rows.sparkSession)
    parts = rows.repartitionByRange(*by, *order).withColumn("_part", F.spark_partition_id()).checkpoint()
    counts = parts.groupBy("_part", *by).agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(W.partitionBy(*by).orderBy("_part").rowsBetween(W.unboundedPreceding, 0)) - F.col("_n")
    offsets = counts.select(F.col("_part").alias("_of"), *[F.col(c).alias(f"_by{i}") for i, c in enumerate(by)], before.alias("_before"))
    own = F.row_number().over(W.partitionBy("_part", *by).orderBy(*order)) - 1
    same = [F.col("_part") == F.col("_of"), *[F.col(c).eqNullSafe(F.col(f"_by{i}")) for i, c in enumerate(by)]]
    placed = parts.withColumn("_own", own).join(offsets, reduce(and_, same))
    return placed.select(*rows.columns, (F.col("_before") + F.col("_own")).cast("long").alias(out))


def batches(rows: DataFrame, size: int, by: str, order: list[str]) -> DataFrame:
    """Adds batch: rows numbered within ``by`` in ``order``, ``size`` to a batch."""
    placed = numbered(rows, [by], order, "_place")
    return placed.select(*rows.columns, F.floor(F.col("_place") / size).alias("batch"))


def buffered_shuffle(rows: DataFrame, by: list[str], order: list[str], key: str, buffer: int = 128, seed: int = 0, out: str = "place") -> DataFrame:
    """Adds ``out``: the row's number within ``by`` after each ``buffer`` rows running in ``order`` are shuffled among themselves (by a seeded hash of ``key``)."""
    placed = numbered(rows, by, order, "_place").withColumn("_block", F.floor(F.col("_place") / buffer))
    h = F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(c).cast("string") for c in by], F.col(key).cast("string")))
    mixed = F.row_number().over(W.partitionBy(*by, "_block").orderBy(h, key)) - 1
    return placed.select(*rows.columns, (F.col("_block") * buffer + mixed).alias(out))


def pad_batches(pixels: DataFrame, batch: str, values: list[str], image: str = "image_id", fill: float = 0) -> DataFrame:
    """The batches' images (batch, image, y, x, values) with ``fill`` to the right and below, up to the largest height and width of their batch."""
    sizes = pixels.groupBy(batch, image).agg((F.max("y") + 1).alias("_h"), (F.max("x") + 1).alias("_w"))
    most = sizes.groupBy(F.col(batch).alias("_b")).agg(F.max("_h").alias("_mh"), F.max("_w").alias("_mw"))
    short = sizes.join(most, F.col(batch) == F.col("_b")).where((F.col("_h") < F.col("_mh")) | (F.col("_w") < F.col("_mw")))
    added = short.withColumn("y", F.explode(F.sequence(F.lit(0), F.col("_mh") - 1)))
    first = F.when(F.col("y") < F.col("_h"), F.col("_w")).otherwise(F.lit(0))
    added = added.withColumn("x", F.explode(F.when(first < F.col("_mw"), F.sequence(first, F.col("_mw") - 1))))
    return pixels.select(batch, image, "y", "x", *values).unionByName(added.select(batch, image, "y", "x", *[F.lit(fill).cast(pixels.schema[v].dataType).alias(v) for v in values]))


def epochs(rows: DataFrame, n: int, key: str, seed: int = 0) -> DataFrame:
    """Rows n times, with epoch and a place in that epoch's order (a hash)."""
    out = rows.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    return out.withColumn("shuffle_key", F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("epoch").cast("string"), F.col(key).cast("string"))))
