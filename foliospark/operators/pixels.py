"""Row-wise and per-image operators on pixel relations (image_id, y, x, values)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Colour means that a VGG network subtracts (fixed values: red, green, blue).
VGG_MEANS = (123.68, 116.78, 103.94)


def channel(pixels: DataFrame, k: int, values: str = "z", out: str = "v") -> DataFrame:
    """One channel of an array column."""
    return pixels.withColumn(out, F.get(values, F.lit(k)))


def max_normalise(pixels: DataFrame, value: str = "v") -> DataFrame:
    """Divide by the image's maximum; null where that is 0."""
    return pixels.withColumn(value, F.col(value) / F.nullif(F.max(value).over(W.partitionBy("image_id")), F.lit(0.0)))


def stretch(pixels: DataFrame, value: str = "v") -> DataFrame:
    """To 0 to 1 between the image's least and largest value."""
    low, high = F.min(value).over(W.partitionBy("image_id")), F.max(value).over(W.partitionBy("image_id"))
    return pixels.withColumn(value, (F.col(value) - low) / F.nullif(high - low, F.lit(0.0)))


def quantise(p: Column) -> Column:
    """Probability to a byte, truncated."""
    return F.floor(p * 255).cast("int")


def dequantise(q: Column) -> Column:
    return q / F.lit(255.0)


def subtract_means(pixels: DataFrame, means: Sequence[float] = VGG_MEANS, channels: Sequence[str] = ("r", "g", "b")) -> DataFrame:
    return pixels.withColumns({c: F.col(c) - F.lit(m) for c, m in zip(channels, means, strict=True)})


def scale_unit(pixels: DataFrame, channels: Sequence[str] = ("r", "g", "b")) -> DataFrame:
    return pixels.withColumns({c: F.col(c) / F.lit(255.0) for c in channels})


def threshold(pixels: DataFrame, t: float, value: str = "v") -> DataFrame:
    """Foreground pixels only: value strictly above ``t``."""
    return pixels.where(F.col(value) > t)


def otsu_thresholds(pixels: DataFrame, value: str = "bin") -> DataFrame:
    """image_id, t: the level that best parts a histogram of whole numbers (most variance between classes; of equals the lowest)."""
    counts = pixels.groupBy("image_id", F.col(value).cast("long").alias("t")).agg(F.count("*").alias("n"))
    run = W.partitionBy("image_id").orderBy("t").rowsBetween(W.unboundedPreceding, 0)
    sums = counts.select("image_id", "t", F.sum("n").over(run).alias("n0"), F.sum(F.col("n") * F.col("t")).over(run).alias("s0"), F.sum("n").over(W.partitionBy("image_id")).alias("n"), F.sum(F.col("n") * F.col("t")).over(W.partitionBy("image_id")).alias("s"))
    apart = (F.col("s") * F.col("n0") - F.col("s0") * F.col("n")).cast("double")
    between = F.when(F.col("n0") < F.col("n"), apart * apart / (F.col("n0") * (F.col("n") - F.col("n0"))).cast("double")).otherwise(0.0)
    best = F.min(F.struct((-between).alias("b"), "t"))
    return sums.groupBy("image_id").agg(best.alias("m")).select("image_id", F.col("m.t").alias("t"))


def otsu(pixels: DataFrame, value: str = "bin") -> DataFrame:
    """Foreground by each image's own level: value above it."""
    return pixels.join(otsu_thresholds(pixels, value), "image_id").where(F.col(value) > F.col("t")).drop("t")


def apply_mask(pixels: DataFrame, mask: DataFrame, value: str = "v") -> DataFrame:
    """0 where ``mask`` (image_id, y, x of what is inside) has no pixel."""
    inside = mask.select("image_id", "y", "x").distinct().withColumn("_in", F.lit(True))
    return pixels.join(inside, ["image_id", "y", "x"], "left").withColumn(value, F.when(F.col("_in"), F.col(value)).otherwise(0.0)).drop("_in")


def contrast(pixels: DataFrame, factor: float, value: str = "v") -> DataFrame:
    """Away from (factor over 1) or towards the image's mean."""
    mean = F.avg(value).over(W.partitionBy("image_id"))
    return pixels.withColumn(value, (F.col(value) - mean) * factor + mean)


def flip(pixels: DataFrame, left_right: bool = False, up_down: bool = False) -> DataFrame:
    y, x = F.max("y").over(W.partitionBy("image_id")) - F.col("y"), F.max("x").over(W.partitionBy("image_id")) - F.col("x")
    return pixels.withColumns({"y": y if up_down else F.col("y"), "x": x if left_right else F.col("x")})
