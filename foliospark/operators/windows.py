"""Neighbourhood operators on pixel relations: separable filters as window frames or column arrays."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

GAUSS5 = (1 / 16, 4 / 16, 6 / 16, 4 / 16, 1 / 16)


def _frame(axis: str, r: int):
    other = "x" if axis == "y" else "y"
    return W.partitionBy("image_id", other).orderBy(axis).rowsBetween(-r, r)


def _both(pixels: DataFrame, value: str, agg, k: int, axes: tuple[str, str] = ("y", "x")) -> DataFrame:
    for axis in axes:
        pixels = pixels.withColumn(value, agg(value).over(_frame(axis, k // 2)))
    return pixels


def erode(pixels: DataFrame, k: int = 3, value: str = "v") -> DataFrame:
    """Least value of the k x k neighbourhood (k odd); what lies outside the raster doesn't count. Needs all pixels."""
    return _both(pixels, value, F.min, k)


def dilate(pixels: DataFrame, k: int = 3, value: str = "v") -> DataFrame:
    return _both(pixels, value, F.max, k)


def opened(pixels: DataFrame, k: int = 3, value: str = "v") -> DataFrame:
    return dilate(erode(pixels, k, value), k, value)


def closed(pixels: DataFrame, k: int = 3, value: str = "v") -> DataFrame:
    return erode(dilate(pixels, k, value), k, value)


def open_close(pixels: DataFrame, k: int = 3, value: str = "v") -> DataFrame:
    """Opened, then closed: specks go, then holes.

    The two dilations in the middle are one of 2k - 1, and axes alternate so that neighbouring passes share a shuffle.
    """
    grown = _both(erode(pixels, k, value), value, F.max, 2 * k - 1, ("x", "y"))
    return _both(grown, value, F.min, k, ("y", "x"))


def box_sum(pixels: DataFrame, k: int = 3, value: str = "v") -> DataFrame:
    """Sum of the k x k neighbourhood, 0 outside."""
    return _both(pixels, value, F.sum, k)


def line_ends(mask: DataFrame) -> DataFrame:
    """Foreground pixels (v 1, others 0) with one foreground neighbour of eight."""
    return box_sum(mask.withColumn("own", F.col("v"))).where((F.col("own") == 1) & (F.col("v") == 2)).drop("own", "v")


def _reflected(i: Column, n: Column) -> Column:
    """Places outside 0 to n - 1 mirrored at the border pixel, which isn't repeated."""
    period = F.greatest(2 * (n - 1), F.lit(1))
    folded = F.pmod(i, period)
    return F.least(folded, period - folded)


def convolve(pixels: DataFrame, weights: Sequence[float], value: str = "v") -> DataFrame:
    """Separable convolution with mirrored borders. Each column, then each row, is one array for a while."""
    r = len(weights) // 2
    for axis, other in (("y", "x"), ("x", "y")):
        lines = pixels.groupBy("image_id", other).agg(F.sort_array(F.collect_list(F.struct(axis, value))).alias("_l"))

        def blurred(p: Column) -> Column:
            return sum((F.lit(w) * F.get("_l", _reflected(p + d, F.size("_l")).cast("int"))[value] for d, w in zip(range(-r, r + 1), weights, strict=True)), F.lit(0.0))

        out = F.transform(F.sequence(F.lit(0), F.size("_l") - 1), blurred)
        pixels = lines.select("image_id", other, F.posexplode(out).alias(axis, value))
    return pixels.select("image_id", "y", "x", value)


def gaussian_weights(sigma: float) -> list[float]:
    """A kernel of int(3 sigma) * 2 + 1 weights that sum to 1."""
    r = int(3 * sigma)
    raw = [math.exp(-(d * d) / (2 * sigma * sigma)) for d in range(-r, r + 1)]
    return [w / sum(raw) for w in raw]


def gaussian(pixels: DataFrame, sigma: float | None = None, value: str = "v") -> DataFrame:
    """Blur with the kernel for ``sigma``, or the fixed one of five weights."""
    return convolve(pixels, GAUSS5 if sigma is None else gaussian_weights(sigma), value)


def vertical_maxima(pixels: DataFrame, value: str = "v") -> DataFrame:
    """Adds v_max: 1 where the value is at least that above and that below; 0 in the first and last row."""
    column = W.partitionBy("image_id", "x").orderBy("y")
    v = F.col(value)
    return pixels.withColumn("v_max", F.coalesce(((v >= F.lag(value).over(column)) & (v >= F.lead(value).over(column))).cast("int"), F.lit(0)))


def patches(pixels: DataFrame, height: int, width: int, offset: float = 0.0) -> DataFrame:
    """patch_y, patch_x, y, x (within the patch) and values of patches at half their size apart, whole ones only.

    ``offset`` (0 to 1) moves the first patch by that share of half a patch. A pixel goes to each patch that holds it.
    """
    sy, sx = height // 2, width // 2
    oy, ox = int(offset * height / 2), int(offset * width / 2)
    values = [c for c in pixels.columns if c not in ("image_id", "y", "x")]
    image = W.partitionBy("image_id")
    sized = pixels.withColumns({"_h": F.max("y").over(image) + 1, "_w": F.max("x").over(image) + 1})

    def holders(at: Column, size: Column, length: int, step: int, first: int) -> Column:
        last = F.floor((size - first - length) / step)
        low = F.greatest(F.lit(0), F.ceil((at - first - length + 1) / step))
        high = F.least(last, F.floor((at - first) / step))
        return F.when(low <= high, F.sequence(low.cast("int"), high.cast("int"))).otherwise(F.array().cast("array<int>"))

    rows = sized.withColumn("patch_y", F.explode(holders(F.col("y"), F.col("_h"), height, sy, oy)))
    rows = rows.withColumn("patch_x", F.explode(holders(F.col("x"), F.col("_w"), width, sx, ox)))
    return rows.select("image_id", "patch_y", "patch_x", (F.col("y") - oy - F.col("patch_y") * sy).alias("y"), (F.col("x") - ox - F.col("patch_x") * sx).alias("x"), *values)


def mirror_pad(pixels: DataFrame, margin: int) -> DataFrame:
    """``margin`` pixels more on each side, mirrored with the border repeated (margin up to the raster's size)."""
    image = W.partitionBy("image_id")
    for axis in ("y", "x"):
        pixels = pixels.withColumn("_n", F.max(axis).over(image) + 1)
        copies = F.filter(F.array(F.col(axis), -1 - F.col(axis), 2 * F.col("_n") - 1 - F.col(axis)), lambda p: (p >= -margin) & (p < F.col("_n") + margin))
        pixels = pixels.withColumn("_p", copies).withColumn(axis, F.explode("_p")).drop("_p", "_n")
    return pixels.withColumns({"y": F.col("y") + margin, "x": F.col("x") + margin})


def crop(pixels: DataFrame, margin: int) -> DataFrame:
    """Without ``margin`` pixels on each side."""
    image = W.partitionBy("image_id")
    inside = pixels.withColumns({"_h": F.max("y").over(image), "_w": F.max("x").over(image)})
    inside = inside.where((F.col("y") >= margin) & (F.col("x") >= margin) & (F.col("y") <= F.col("_h") - margin) & (F.col("x") <= F.col("_w") - margin))
    return inside.drop("_h", "_w").withColumns({"y": F.col("y") - margin, "x": F.col("x") - margin})
