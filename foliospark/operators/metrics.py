"""Evaluation metrics as two-phase aggregations of counts that add up over parts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.polygons import polygon_iou


def confusion(pairs: DataFrame, truth: str, prediction: str, by: list[str] | None = None) -> DataFrame:
    """total, true and false positives and negatives of boolean columns."""
    t, p = F.col(truth).cast("boolean"), F.col(prediction).cast("boolean")
    return pairs.groupBy(*(by or [])).agg(F.count("*").alias("total"), F.count_if(t & p).alias("tp"), F.count_if(~t & ~p).alias("tn"), F.count_if(~t & p).alias("fp"), F.count_if(t & ~p).alias("fn"))


def merge_counts(counts: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Counts of parts added up."""
    return counts.groupBy(*(by or [])).agg(*[F.sum(c).alias(c) for c in ("total", "tp", "tn", "fp", "fn")])


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def precision_recall(counts: DataFrame, beta: float = 1.0) -> DataFrame:
    """Adds precision, recall, f (weighted by beta), iu, accuracy; 0 where there is nothing to divide by."""
    tp, fp, fn, tn, n = (F.col(c) for c in ("tp", "fp", "fn", "tn", "total"))
    out = counts.withColumns({"precision": _ratio(tp, tp + fp), "recall": _ratio(tp, tp + fn), "iu": _ratio(tp, tp + fp + fn), "accuracy": _ratio(tp + tn, n)})
    p, r, b2 = F.col("precision"), F.col("recall"), beta * beta
    return out.withColumn("f", _ratio((1 + b2) * p * r, b2 * p + r))


def class_iou(pairs: DataFrame, truth: str = "label", prediction: str = "pred") -> DataFrame:
    """class_id, iou from the confusion matrix: of each class that occurs on either side."""
    cells = pairs.groupBy(F.col(truth).alias("t"), F.col(prediction).alias("p")).agg(F.count("*").alias("n"))
    sides = cells.select(F.explode(F.array_distinct(F.array("t", "p"))).alias("class_id"), "t", "p", "n")
    return sides.groupBy("class_id").agg((F.sum(F.when(F.col("t") == F.col("p"), F.col("n")).otherwise(0)) / F.sum("n")).alias("iou"))


def mean_iou(pairs: DataFrame, truth: str = "label", prediction: str = "pred") -> DataFrame:
    return class_iou(pairs, truth, prediction).agg(F.avg("iou").alias("miou"), F.count("*").alias("classes"))


def pixel_accuracy(pairs: DataFrame, truth: str = "label", prediction: str = "pred", by: list[str] | None = None) -> DataFrame:
    return pairs.groupBy(*(by or [])).agg(F.avg((F.col(truth) == F.col(prediction)).cast("double")).alias("accuracy"))


def mse_psnr(pairs: DataFrame, truth: str, prediction: str, by: list[str] | None = None) -> DataFrame:
    """mse and psnr (of signals up to 1; null if mse is 0)."""
    e = F.col(truth) - F.col(prediction)
    out = pairs.groupBy(*(by or [])).agg((F.sum(e * e) / F.count("*")).alias("mse"))
    return out.withColumn("psnr", F.when(F.col("mse") != 0, 10 * F.log10(1 / F.col("mse"))))


def rectangle_iou(pairs: DataFrame) -> DataFrame:
    """Adds iou of pixel rectangles (x, y, w, h with suffixes 1 and 2); 0 if they are apart."""
    overlap = lambda a, s: F.greatest(F.lit(0), F.least(F.col(f"{a}1") + F.col(f"{s}1"), F.col(f"{a}2") + F.col(f"{s}2")) - F.greatest(f"{a}1", f"{a}2"))
    inter = overlap("x", "w") * overlap("y", "h")
    union = F.col("w1") * F.col("h1") + F.col("w2") * F.col("h2") - inter
    return pairs.withColumn("iou", F.when(union > 0, inter / union).otherwise(F.lit(None).cast("double")))


def mean_page_iou(truth: DataFrame, found: DataFrame, key: str = "image_id") -> DataFrame:
    """miou over ``truth``'s rectangles, those without a found one counting as 0, and the number of those."""
    a = truth.select(key, *[F.col(c).alias(f"{c}1") for c in "xywh"])
    b = found.select(key, *[F.col(c).alias(f"{c}2") for c in "xywh"])
    both = rectangle_iou(a.join(b, key, "left"))
    return both.agg(F.avg(F.coalesce("iou", F.lit(0.0))).alias("miou"), F.count_if(F.col("x2").isNull()).alias("missing"))


def summary(rows: DataFrame, value: str, by: list[str] | None = None) -> DataFrame:
    """mean, std (of the population), min and max over runs."""
    return rows.groupBy(*(by or [])).agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"), F.min(value).alias("min"), F.max(value).alias("max"))


def drop_outliers(rows: DataFrame, value: str, by: list[str], most: float = 3.5, least_rows: int = 3) -> DataFrame:
    """Without rows whose modified z-score (0.6745 |x - median| / MAD) exceeds ``most``; groups of ``least_rows`` or fewer stay whole."""
    group = rows.groupBy(*by).agg(F.median(value).alias("_median"), F.count("*").alias("_n"))
    off = rows.join(group, by).withColumn("_off", F.abs(F.col(value) - F.col("_median")))
    mad = off.groupBy(*by).agg(F.median("_off").alias("_mad"))
    score = 0.6745 * F.col("_off") / F.greatest("_mad", F.lit(1e-10))
    return off.join(mad, by).where((F.col("_n") <= least_rows) | (score <= most)).select(*rows.columns)


def line_height_stats(lines: DataFrame, by: list[str], height: str = "height") -> DataFrame:
    """mean, std and median of line heights by page, outliers aside."""
    kept = drop_outliers(lines, height, by)
    return kept.groupBy(*by).agg(F.avg(height).alias("mean"), F.stddev_pop(height).alias("std"), F.median(height).alias("median"))


def quad_ious(truth: DataFrame, found: DataFrame, key: list[str]) -> DataFrame:
    """key, iou of each page's quadrilateral (corners in points) and the found one, exact; 0 where there is none. Both are convex."""
    b = found.select(*key, F.col("points").alias("_found"))
    both = truth.select(*key, F.col("points").alias("_true")).join(b, key, "left")
    iou = F.when(F.size("_found") >= 3, polygon_iou(F.col("_true"), F.col("_found"), convex=True)).otherwise(F.lit(0.0))
    return both.select(*key, F.coalesce(iou, F.lit(0.0)).alias("iou"), F.col("_found").isNull().alias("missing"))


def mean_quad_iou(truth: DataFrame, found: DataFrame, key: list[str], by: list[str] | None = None) -> DataFrame:
    """miou of pages' quadrilaterals and the number without a found one, over all or ``by`` some of the keys."""
    return quad_ious(truth, found, key).groupBy(*(by or [])).agg(F.avg("iou").alias("miou"), F.count_if("missing").alias("missing"))
