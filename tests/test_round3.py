"""Steps that were wrong, or grew faster than their input, against brute force."""

import math
import random
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from foliospark.operators import overlaps, raster, resample, runs, tiling
from foliospark.plans import annotation_queries, document_queries, overlap_queries


def test_tile_starts_round_exact_halves_to_even(spark):
    sides = [501, 900, 1301, 5715, 5716, 17300, 20299, 39999]
    rows = spark.createDataFrame([(s,) for s in sides], "s int").select("s", tiling.tile_starts(F.col("s"), 500, 0.2).alias("at")).collect()
    for r in rows:
        n = math.ceil((r.s - 500) / 400)
        assert r["at"] == [round(Fraction(i * (r.s - 500), n)) for i in range(n + 1)]


KINDS = {"rectangle": "x int, y int, w int, h int", "circle": "cx int, cy int, r int", "polygon": "points array<struct<x:int,y:int>>", "stroke": "points array<struct<x:int,y:int>>"}


def shapes(kind, rng):
    at = lambda: rng.randrange(-30, 30)
    if kind == "rectangle":
        return (at(), at(), rng.randrange(20), rng.randrange(20))
    if kind == "circle":
        return (at(), at(), rng.randrange(12))
    return ([(at(), at()) for _ in range(rng.randrange(0, 6))],)


def holds(kind, s, y, x):
    if kind == "rectangle":
        return s[0] <= x <= s[0] + s[2] and s[1] <= y <= s[1] + s[3]
    if kind == "circle":
        return (x - s[0]) ** 2 + (y - s[1]) ** 2 <= s[2] ** 2
    ring = s[0]
    if kind == "polygon":
        if len(ring) < 3:
            return False
        crossed = [xa + (y - ya) * (xb - xa) / (yb - ya) for (xa, ya), (xb, yb) in zip(ring, ring[1:] + ring[:1], strict=True) if (ya <= y) != (yb <= y)]
        return sum(x >= c for c in crossed) % 2 == 1
    for (xa, ya), (xb, yb) in zip(ring, ring[1:], strict=False) if len(ring) > 1 else [(p, p) for p in ring]:
        dx, dy = xb - xa, yb - ya
        t = max(0.0, min(1.0, ((x - xa) * dx + (y - ya) * dy) / (dx * dx + dy * dy))) if dx or dy else 0.0
        if (x - (xa + t * dx)) ** 2 + (y - (ya + t * dy)) ** 2 <= 2.25:
            return True
    return False


@pytest.mark.parametrize("kind", sorted(KINDS))
@pytest.mark.parametrize("chunk", [1_000_000, 40])
def test_united_runs(spark, kind, chunk, monkeypatch):
    """Every pixel of a key's shapes once, over keys cut by chunks, with null keys and shapes."""
    monkeypatch.setattr(runs, "CHUNK", chunk)
    rng = random.Random(len(kind))
    rows = [(rng.choice([1, 2, None]), rng.choice("ab"), *shapes(kind, rng)) for _ in range(60)]
    df = spark.createDataFrame([*rows, (1, "a", *[None] * len(rows[0][2:]))], f"k long, n string, {KINDS[kind]}")
    made = {"rectangle": raster.rectangle_runs, "circle": raster.circle_runs, "polygon": raster.polygon_runs, "stroke": lambda d, keep: raster.stroke_runs(d, keep, 3)}[kind](df, ["k", "n"])
    got = [(r.k, r.n, r.y, x) for r in made.collect() for x in range(r.left, r.right + 1)]
    want = {(k, n, y, x) for k, n, *s in rows for y in range(-45, 55) for x in range(-45, 55) if holds(kind, s, y, x)}
    assert len(got) == len(set(got)) and set(got) == want


def test_masks_are_counted_as_runs(spark):
    """No row for each pixel: neither explosion nor sort of pixels before sums."""
    for name, module in (("rect_fill_mask", annotation_queries), ("circle_fill_mask", annotation_queries), ("pixel_intersection", annotation_queries), ("rect_fill_pixels", document_queries), ("polygon_iou", document_queries), ("stroke_polygons", document_queries)):
        plan = module.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
        assert "explode(sequence" not in plan and "Distinct" not in plan and "Join" not in plan


@pytest.mark.parametrize(("height", "width"), [(12, 5), (3, 17), (7, 7), (1, 1)])
def test_resized_without_a_join_of_pixels(spark, height, width):
    """Images of several sizes, one with a hole, against the formula place by place; no pixel is joined with another."""
    rng = random.Random(height)
    images = {1: (7, 7), 2: (1, 9), 3: (5, 2)}
    pixels = {(i, y, x): rng.random() for i, (h, w) in images.items() for y in range(h) for x in range(w) if (i, y, x) != (1, 3, 3)}
    df = spark.createDataFrame([(*k, v) for k, v in pixels.items()], "image_id long, y int, x int, v double")
    near, linear = {}, {}
    for i, (h, w) in images.items():
        for y in range(height):
            for x in range(width):
                if (k := (i, y * h // height, x * w // width)) in pixels:
                    near[i, y, x] = pixels[k]
                fy, fx = y * h / height, x * w / width
                taps = [((i, min(int(fy) + a, h - 1), min(int(fx) + b, w - 1)), (fy % 1 if a else 1 - fy % 1) * (fx % 1 if b else 1 - fx % 1)) for a in (0, 1) for b in (0, 1)]
                if any(k in pixels for k, _ in taps):
                    linear[i, y, x] = sum(s * pixels[k] for k, s in taps if k in pixels)
    made = resample.nearest(df, height, width)
    assert {(r.image_id, r.y, r.x): r.v for r in made.collect()} == near
    assert {(r.image_id, r.y, r.x): pytest.approx(r.v) for r in resample.bilinear(df, height, width).collect()} == linear
    assert "Join" not in made._jdf.queryExecution().optimizedPlan().toString()


def test_areas_of_many_pairs_at_once():
    """Against shares of a fine grid of points: polygons that cross themselves, of various sizes, and without area."""
    rng = random.Random(4)
    lists = [[(rng.randrange(0, 12), rng.randrange(0, 12)) for _ in range(rng.choice([0, 2, 3, 4, 5, 7]))] for _ in range(60)]
    column = pa.array([[{"x": x, "y": y} for x, y in p] for p in lists], pa.list_(pa.struct([("x", pa.int32()), ("y", pa.int32())])))
    one, two = overlaps.ragged(column[:30]), overlaps.ragged(column[30:])
    got = overlaps.even_odd_shared(*one, *two)
    y, x = (np.mgrid[0 : 12 * 16, 0 : 12 * 16] + 0.5) / 16

    def inside(p):
        hit = np.zeros(y.shape, bool)
        for (xa, ya), (xb, yb) in zip(p, p[1:] + p[:1], strict=True):
            if ya != yb:
                hit ^= ((ya <= y) != (yb <= y)) & (x >= xa + (y - ya) * (xb - xa) / (yb - ya))
        return hit

    for i in range(30):
        a, b = inside(lists[i]), inside(lists[30 + i])
        for k, want in enumerate((a, b, a & b)):
            assert abs(got[k][i] - want.sum() / 256) < 1.5


def test_pairs_are_not_shuffled(spark):
    """Shapes meet in one join of cells; boxes aren't fetched again for pairs."""
    for name in ("shape_overlaps", "polygon_overlaps"):
        plan = overlap_queries.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("Join Inner") == 3  # the cells, and their counts on either side
