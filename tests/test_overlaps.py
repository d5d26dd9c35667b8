"""Overlap joins and shared areas against brute force."""

import math
import random

import pytest
from pyspark.sql import functions as F

from foliospark.functions import polygons
from foliospark.operators import overlaps
from foliospark.plans import overlap_queries

POINTS = "array<struct<x:int,y:int>>"


def boxes(seed, n, pages=2, large=0.05, spread=400):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        x, y = rng.randrange(-spread, spread), rng.randrange(-spread, spread)
        side = (lambda: rng.randrange(0, 600)) if rng.random() < large else (lambda: rng.randrange(0, 40))
        rows.append((rng.randrange(pages), i, x, y, x + side(), y + side()))
    return [*rows, (0, n, None, 1, 2, 3), (None, n + 1, 0, 0, 9, 9)]


def meet(a, b):
    if None in (*a, *b) or a[0] != b[0]:
        return False
    return max(a[2], b[2]) < min(a[4], b[4]) and max(a[3], b[3]) < min(a[5], b[5])


@pytest.mark.parametrize(("cell", "block", "spread"), [(32, 500, 400), (8, 3, 60), (1000, 10, 400)])
def test_overlap_join(spark, cell, block, spread):
    schema = "page long, id long, x1 int, y1 int, x2 int, y2 int"
    a, b = boxes(1, 250, spread=spread), boxes(2, 200, spread=spread)
    da, db = spark.createDataFrame(a, schema), spark.createDataFrame(b, schema)
    got = [(r.id_a, r.id_b) for r in overlaps.overlap_join(da, db, "page", cell, block).collect()]
    assert sorted(got) == sorted((x[1], y[1]) for x in a for y in b if meet(x, y))
    got = [(r.id_a, r.id_b) for r in overlaps.overlap_join(da, None, "page", cell, block).collect()]
    assert sorted(got) == sorted((x[1], y[1]) for x in a for y in a if x[1] < y[1] and meet(x, y))
    assert overlaps.overlap_join(da.where("false"), db, "page").count() == 0


def test_no_cross_join(spark):
    plan = overlap_queries.shape_overlaps(spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def staircase(rng, x, y):
    """A concave polygon of unit cells: columns of one base and various heights."""
    heights = [rng.randrange(1, 8) for _ in range(rng.randrange(1, 7))]
    points, cells = [(x, y)], set()
    for i, h in enumerate(heights):
        points += [(x + i, y + h), (x + i + 1, y + h)]
        cells |= {(x + i, y + k) for k in range(h)}
    return [*points, (x + len(heights), y)], cells


def areas(spark, pairs, column):
    rows = spark.createDataFrame([(i, [tuple(p) for p in a], [tuple(p) for p in b]) for i, (a, b) in enumerate(pairs)], f"i int, a {POINTS}, b {POINTS}")
    return [r[0] for r in rows.select("i", column(F.col("a"), F.col("b")).alias("v")).orderBy("i").select("v").collect()]


def test_even_odd_areas_of_cells(spark):
    rng = random.Random(4)
    made = [(staircase(rng, 0, 0), staircase(rng, rng.randrange(-4, 5), rng.randrange(-4, 5))) for _ in range(60)]
    turned = [(a[0], b[0][::-1]) for a, b in made]
    for r, (a, b) in zip(areas(spark, turned, polygons.even_odd_areas), made, strict=True):
        assert math.isclose(r.a, len(a[1])) and math.isclose(r.b, len(b[1])) and math.isclose(r.both, len(a[1] & b[1]), abs_tol=1e-9)


def inside(points, x, y):
    """Even-odd."""
    return sum((ya <= y) != (yb <= y) and x < xa + (y - ya) * (xb - xa) / (yb - ya) for (xa, ya), (xb, yb) in zip(points, points[1:] + points[:1], strict=True)) % 2 == 1


def test_even_odd_areas_of_any_polygons(spark):
    rng = random.Random(5)
    pairs = [tuple([(rng.randrange(12), rng.randrange(12)) for _ in range(rng.randrange(3, 8))] for _ in "ab") for _ in range(12)]
    n = 30
    for r, (a, b) in zip(areas(spark, pairs, polygons.even_odd_areas), pairs, strict=True):
        cells = [(inside(a, (i + 0.5) / n, (j + 0.5) / n), inside(b, (i + 0.5) / n, (j + 0.5) / n)) for i in range(12 * n) for j in range(12 * n)]
        for got, want in ((r.a, sum(x for x, _ in cells)), (r.b, sum(y for _, y in cells)), (r.both, sum(x and y for x, y in cells))):
            assert abs(got - want / n**2) < 0.6


def test_convex_cuts_equal_slabs(spark):
    rng = random.Random(6)

    def hull(n):
        angles = sorted(rng.random() * 2 * math.pi for _ in range(n))
        cx, cy, r = rng.randrange(100), rng.randrange(100), rng.randrange(20, 90)
        points = [(round(cx + r * math.cos(t)), round(cy + r * math.sin(t))) for t in angles]
        return points if rng.random() < 0.5 else points[::-1]

    pairs = [(hull(rng.randrange(3, 7)), hull(4)) for _ in range(80)]
    cut, slab = areas(spark, pairs, polygons.convex_overlap), areas(spark, pairs, polygons.even_odd_areas)
    flags = areas(spark, pairs, lambda a, b: polygons.is_convex(b))
    n = 0
    for c, s, convex in zip(cut, slab, flags, strict=True):
        if convex:
            n += c > 0
            assert math.isclose(c, s.both, rel_tol=1e-9, abs_tol=1e-6)
    assert n > 20


def test_shapes_without_area(spark):
    flat = ([(0, 0), (5, 5)], [(0, 0), (9, 0), (9, 9)])
    line = ([(0, 0), (4, 0), (8, 0)], [(0, 0), (4, 4), (8, 8)])
    assert [tuple(r) for r in areas(spark, [([], []), flat, line], polygons.even_odd_areas)] == [(0, 0, 0), (0, 40.5, 0), (0, 0, 0)]
    assert areas(spark, [line, ([], flat[1])], polygons.polygon_iou) == [None, 0.0]
    assert areas(spark, [line, (flat[1], line[0])], polygons.convex_overlap) == [0.0, 0.0]
