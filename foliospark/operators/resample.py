"""Resampling of pixel relations and the size arithmetic around it."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def _sized(pixels: DataFrame, height: int | DataFrame, width: int | None) -> DataFrame:
    """Pixels with their image's height and width (sh, sw) and the target's (th, tw); an image is brought together once."""
    image = W.partitionBy("image_id")
    rows = pixels.where(F.col("image_id").isNotNull()).withColumns({"sh": (F.max("y").over(image) + 1).cast("long"), "sw": (F.max("x").over(image) + 1).cast("long")})
    if not isinstance(height, DataFrame):
        return rows.withColumns({"th": F.lit(height).cast("long"), "tw": F.lit(width).cast("long")})
    wanted = height.select("image_id", F.col("height").alias("_h"), F.col("width").alias("_w"))
    return rows.join(wanted, "image_id", "left").withColumns({"th": F.coalesce("_h", "sh").cast("long"), "tw": F.coalesce("_w", "sw").cast("long")}).drop("_h", "_w")


def _first(at: Column, size: Column, target: Column) -> Column:
    """The first target place whose source place, floor(target * size / out), is ``at`` or later."""
    return F.floor((at.cast("long") * target + size - 1) / size)


def _between(low: Column, high: Column) -> Column:
    """low to high, none if that is less."""
    return F.when(low <= high, F.sequence(low, high)).otherwise(F.array().cast("array<bigint>"))


def _list(value: str | list[str]) -> list[str]:
    return [value] if isinstance(value, str) else value


def nearest(pixels: DataFrame, height: int | DataFrame, width: int | None = None, value: str | list[str] = "v") -> DataFrame:
    """Source place: floor(target * in / out). One value or several.

    Instead of one height and width: a frame of sizes (image_id, height, width), such as the originals'; an image
    without a size, or with a null one, stays as it is.
    """
    names = _list(value)
    rows = _sized(pixels.select("image_id", F.col("y").alias("_y"), F.col("x").alias("_x"), "y", "x", *names), height, width)
    for at, n, m in (("y", "sh", "th"), ("x", "sw", "tw")):  # the target's places that look at a pixel
        n, m = F.col(n), F.col(m)
        rows = rows.withColumn(at, F.explode(_between(_first(F.col(f"_{at}"), n, m), _first(F.col(f"_{at}") + 1, n, m) - 1)))
    return rows.select("image_id", F.col("y").cast("int").alias("y"), F.col("x").cast("int").alias("x"), *names)


def _taps(own: Column, size: Column, target: Column) -> Column:
    """t, w: the target places that a source place has a part in, with its weight as the place before and as the one after."""

    def taps(t: Column) -> Column:
        place = t * size / target
        low = F.floor(place)
        tap = lambda here, w: F.when(here, F.struct(t.alias("t"), w.alias("w")))
        return F.array(tap(low == own, 1 - (place - low)), tap(F.least(low + 1, size - 1) == own, place - low))

    near = _between(_first(F.greatest(own - 1, F.lit(0)), size, target), _first(own + 1, size, target) - 1)
    return F.filter(F.flatten(F.transform(near, taps)), lambda t: t.isNotNull())


def bilinear(pixels: DataFrame, height: int | DataFrame, width: int | None = None, value: str = "v") -> DataFrame:
    """Source place target * in / out without a half-pixel shift; beyond the last pixel it is held. Sizes as for ``nearest``."""
    rows = _sized(pixels.select("image_id", F.col("y").alias("_y"), F.col("x").alias("_x"), "y", "x", value), height, width)
    for at, n, m in (("y", "sh", "th"), ("x", "sw", "tw")):
        rows = rows.withColumn(f"t{at}", F.explode(_taps(F.col(f"_{at}"), F.col(n), F.col(m))))
    taken = rows.select("image_id", F.col("ty.t").cast("int").alias("y"), F.col("tx.t").cast("int").alias("x"), (F.col("ty.w") * F.col("tx.w") * F.col(value)).alias(value))
    return taken.groupBy("image_id", "y", "x").agg(F.sum(value).alias(value))


def budget_dims(height: Column, width: Column, budget: int) -> Column:
    """Height and width that hold about ``budget`` pixels in the same shape, truncated."""
    h = F.sqrt(budget / (width / height))
    return F.struct(F.floor(h).cast("int").alias("height"), F.floor(budget / h).cast("int").alias("width"))


def scaled_dims(height: Column, width: Column, budget: int) -> Column:
    """The same by one ratio for both sides."""
    ratio = F.sqrt(budget / (height * width))
    return F.struct(F.floor(height * ratio).cast("int").alias("height"), F.floor(width * ratio).cast("int").alias("width"))


def reduced_dims(height: Column, width: Column, target: int = 2000) -> Column:
    """Height ``target`` and the width that keeps the shape."""
    return F.struct(F.lit(target).alias("height"), F.floor(width * target / height).cast("int").alias("width"))


def inner_crop(height: Column, width: Column, angle: Column) -> Column:
    """Height and width of the largest upright rectangle inside a raster turned by ``angle`` (radians)."""
    long, short = F.greatest(height, width).cast("double"), F.least(height, width).cast("double")
    s, c = F.abs(F.sin(angle)), F.abs(F.cos(angle))
    narrow = (short <= 2 * s * c * long) | (F.abs(s - c) < 1e-10)
    x = 0.5 * short
    cos2 = c * c - s * s
    wide = width >= height
    w = F.when(narrow, F.when(wide, x / s).otherwise(x / c)).otherwise((width * c - height * s) / cos2)
    h = F.when(narrow, F.when(wide, x / c).otherwise(x / s)).otherwise((height * c - width * s) / cos2)
    return F.struct(h.alias("height"), w.alias("width"))


def rotate(pixels: DataFrame, angle: float | Column, value: str | list[str] = "v") -> DataFrame:
    """Turned by ``angle`` (radians, perhaps of image_id) about the middle, nearest pixel; pixels from outside the raster are absent."""
    s, c = (F.sin(angle), F.cos(angle)) if isinstance(angle, Column) else (math.sin(angle), math.cos(angle))
    sized = pixels.groupBy("image_id").agg((F.max("y") / 2).alias("my"), (F.max("x") / 2).alias("mx"))
    at = pixels.select("image_id", "y", "x").join(sized, "image_id")
    dy, dx = F.col("y") - F.col("my"), F.col("x") - F.col("mx")
    at = at.withColumns({"_y": F.floor(F.col("my") + dy * c - dx * s + 0.5).cast("int"), "_x": F.floor(F.col("mx") + dy * s + dx * c + 0.5).cast("int")})
    source = pixels.select("image_id", F.col("y").alias("_y"), F.col("x").alias("_x"), *_list(value))
    return at.join(source, ["image_id", "_y", "_x"]).select("image_id", "y", "x", *_list(value))


def random_scale(key: Column, share: float, seed: int = 0) -> Column:
    """Factor of the pixel budget between max(1 - share, 0) and 1 + share, the same for the same key and seed."""
    low = max(1 - share, 0.0)
    return low + (1 + share - low) * (F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(1_000_003)) / 1_000_003)


def baseline_thickness(height: Column, mean_line: Column, share: float) -> Column:
    """Pixels of a drawn baseline: a share of the mean line height, at least 0.2 % of the page."""
    return F.floor(F.greatest(0.002 * height, share * mean_line)).cast("int")
