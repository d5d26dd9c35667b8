"""Points, boxes and polygons as columns: arrays of struct<x:int,y:int>."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .polygons import let


def parse_points(text: Column) -> Column:
    """'x,y x,y' to points, decimals truncated; an empty or null string is no points; a part without two numbers is an error."""

    def point(part: Column) -> Column:
        number = lambda xy, k: F.get(xy, F.lit(k)).cast("double").cast("int")
        wrong = F.raise_error(F.concat(F.lit("not a point: "), part)).cast("struct<x:int,y:int>")
        return let(F.split(part, ","), lambda xy: F.when(F.size(xy) == 2, F.struct(number(xy, 0).alias("x"), number(xy, 1).alias("y"))).otherwise(wrong))

    none = F.array().cast("array<struct<x:int,y:int>>")
    return F.when(F.coalesce(text, F.lit("")) == "", none).otherwise(F.transform(F.split(text, " "), point))


def format_points(points: Column) -> Column:
    return F.array_join(F.transform(points, lambda p: F.concat_ws(",", p["x"], p["y"])), " ")


def from_xy(xs: Column, ys: Column) -> Column:
    return F.zip_with(xs, ys, lambda x, y: F.struct(x.cast("int").alias("x"), y.cast("int").alias("y")))


def to_xy(points: Column) -> Column:
    """Points to [[x, y], ...]."""
    return F.transform(points, lambda p: F.array(p["x"], p["y"]))


def scale_points(points: Column, ratio_y: Column, ratio_x: Column) -> Column:
    return F.transform(points, lambda p: F.struct((p["x"] * ratio_x).cast("int").alias("x"), (p["y"] * ratio_y).cast("int").alias("y")))


def rectangle(x: Column, y: Column, w: Column, h: Column) -> Column:
    """Corners, clockwise from the top left."""
    corner = lambda a, b: F.struct(a.cast("int").alias("x"), b.cast("int").alias("y"))
    return F.array(corner(x, y), corner(x + w, y), corner(x + w, y + h), corner(x, y + h))


def area(points: Column) -> Column:
    """Of a simple polygon."""
    cross = F.transform(points, lambda p, i: p["x"] * F.get(points, (i + 1) % F.size(points))["y"] - F.get(points, (i + 1) % F.size(points))["x"] * p["y"])
    return F.abs(F.aggregate(cross, F.lit(0).cast("long"), lambda a, c: a + c)) / 2


def bounds(points: Column, above: int = 0) -> Column:
    """struct x1, y1, x2, y2; y1 moved up by ``above``, not beyond 0."""
    xs, ys = F.transform(points, lambda p: p["x"]), F.transform(points, lambda p: p["y"])
    top = F.array_min(ys) if not above else F.greatest(F.lit(0), F.array_min(ys) - above)
    return F.struct(F.array_min(xs).alias("x1"), top.alias("y1"), F.array_max(xs).alias("x2"), F.array_max(ys).alias("y2"))


def clip(points: Column, width: Column, height: Column) -> Column:
    """Into 0 to width and 0 to height, both inclusive."""
    return F.transform(points, lambda p: F.struct(F.greatest(F.lit(0), F.least(p["x"], width)).cast("int").alias("x"), F.greatest(F.lit(0), F.least(p["y"], height)).cast("int").alias("y")))


def close_ring(points: Column) -> Column:
    return F.concat(points, F.slice(points, 1, 1))


def centroid_x(points: Column) -> Column:
    return F.aggregate(points, F.lit(0).cast("long"), lambda a, p: a + p["x"]) / F.size(points)


def centroid_y(points: Column) -> Column:
    return F.aggregate(points, F.lit(0).cast("long"), lambda a, p: a + p["y"]) / F.size(points)


def every(points: Column, step: int) -> Column:
    """Every ``step``-th point, from the first."""
    return F.filter(points, lambda p, i: i % step == 0)


def pad(values: Column, length: Column) -> Column:
    """Zeros after an array up to ``length``."""
    return F.concat(values, F.array_repeat(F.lit(0).cast("double"), F.greatest(length - F.size(values), F.lit(0)).cast("int")))
