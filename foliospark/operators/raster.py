"""Shapes to pixels, by runs of the rows that they cross: filled rectangles, circles and polygons, strokes by distance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import runs


def fill_rectangles(shapes: DataFrame, keep: list[str]) -> DataFrame:
    """Pixels y, x from x to x + w and y to y + h, both inclusive."""
    rows = shapes.withColumn("_y", F.explode(F.sequence("y", F.col("y") + F.col("h"))))
    return rows.withColumn("_x", F.explode(F.sequence("x", F.col("x") + F.col("w")))).select(*keep, F.col("_y").alias("y"), F.col("_x").alias("x"))


def fill_circles(shapes: DataFrame, keep: list[str]) -> DataFrame:
    """Pixels within r of (cx, cy)."""
    rows = shapes.withColumn("y", F.explode(F.sequence(F.col("cy") - F.col("r"), F.col("cy") + F.col("r"))))
    rows = rows.withColumn("x", F.explode(F.sequence(F.col("cx") - F.col("r"), F.col("cx") + F.col("r"))))
    dy, dx = F.col("y") - F.col("cy"), F.col("x") - F.col("cx")
    return rows.where(dy * dy + dx * dx <= F.col("r") * F.col("r")).select(*keep, "y", "x")


def rectangle_runs(shapes: DataFrame, keep: list[str]) -> DataFrame:
    """keep, y, left, right: runs of the pixels of a key's rectangles (x, y, w, h) together, each pixel in one."""
    return runs.united_runs(shapes.select(*keep, *[F.col(c).cast("int").alias(c) for c in "xywh"]), keep, list("xywh"), runs.rectangle_rows, runs.rectangle_runs)


def circle_runs(shapes: DataFrame, keep: list[str]) -> DataFrame:
    """The same of circles (cx, cy, r)."""
    columns = ["cx", "cy", "r"]
    return runs.united_runs(shapes.select(*keep, *[F.col(c).cast("int").alias(c) for c in columns]), keep, columns, runs.circle_rows, runs.circle_runs)


def polygon_runs(shapes: DataFrame, keep: list[str], points: str = "points") -> DataFrame:
    """The same of polygons, by the even-odd rule of each.

    An edge crosses row y if it goes from above or on it to below; a run holds the pixels from its left crossing,
    rounded up, to before its right one.
    """
    return runs.united_runs(shapes.select(*keep, F.col(points).alias("points")), keep, ["points"], runs.polygon_rows, runs.polygon_runs)


def stroke_runs(shapes: DataFrame, keep: list[str], thickness: int, points: str = "points", close: bool = False) -> DataFrame:
    """The same of polylines (of the ring, if ``close``): pixels within half the thickness."""
    p = F.col(points)
    r = thickness / 2
    drawn = shapes.select(*keep, (F.concat(p, F.slice(p, 1, 1)) if close else p).alias("points")).withColumns({"half": F.lit(r), "reach": F.lit(int(r) + 1)})
    return runs.united_runs(drawn, keep, ["points", "half", "reach"], runs.stroke_rows, runs.stroke_runs)


def fill_polygons(shapes: DataFrame, keep: list[str], points: str = "points") -> DataFrame:
    """Pixels whose centres are inside polygons by the even-odd rule, each once, however many shapes of one key hold it."""
    return runs.pixels(polygon_runs(shapes, keep, points))


def stroke(shapes: DataFrame, keep: list[str], thickness: int, points: str = "points", close: bool = False) -> DataFrame:
    """Pixels within half the thickness of a polyline (of the ring, if ``close``), each once for a key."""
    return runs.pixels(stroke_runs(shapes, keep, thickness, points, close))


def run_sums(found: DataFrame, by: list[str]) -> DataFrame:
    """by, n (pixels), sum_y, sum_x of runs."""
    n = (F.col("right") - F.col("left") + 1).cast("long")
    return found.groupBy(*by).agg(F.sum(n).alias("n"), F.sum(n * F.col("y")).alias("sum_y"), F.sum((n * (F.col("left").cast("long") + F.col("right")) / 2).cast("long")).alias("sum_x"))


def polygon_set_iou(a: DataFrame, b: DataFrame, key: str, points: str = "points") -> DataFrame:
    """key, iou of the pixels of a key's polygons in ``a`` and those in ``b``, from the sizes of either and of both together."""
    tagged = lambda s, tag: s.select(key, F.col(points).alias("points"), F.explode(F.array(F.lit(tag), F.lit(2))).alias("_side"))
    found = polygon_runs(tagged(a, 0).unionByName(tagged(b, 1)), [key, "_side"])
    size = lambda k: F.sum(F.when(F.col("_side") == k, F.col("right") - F.col("left") + 1).otherwise(0))
    return found.groupBy(key).agg(((size(0) + size(1) - size(2)) / size(2)).alias("iou"))


def pixel_iou(a: DataFrame, b: DataFrame, key: str = "image_id") -> DataFrame:
    """key, iou of two sets of pixels (key, y, x)."""
    at = [key, "y", "x"]
    both = a.select(*at).distinct().withColumn("_a", F.lit(1)).join(b.select(*at).distinct().withColumn("_b", F.lit(1)), at, "full")
    return both.groupBy(key).agg((F.sum(F.coalesce("_a", F.lit(0)) * F.coalesce("_b", F.lit(0))) / F.count("*")).alias("iou"))
