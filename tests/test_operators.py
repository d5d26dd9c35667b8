import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from foliospark.config import TrainingSettings
from foliospark.functions import geometry as geo
from foliospark.functions import text as tx
from foliospark.operators import components as cc
from foliospark.operators import pixels as px
from foliospark.operators import raster, vectorize
from foliospark.operators import windows as win


def frame(spark, arrays):
    rows = [(i, y, x, float(a[y, x])) for i, a in enumerate(arrays) for y in range(a.shape[0]) for x in range(a.shape[1])]
    return spark.createDataFrame(rows, "image_id long, y int, x int, v double")


def grids(df, shape, value="v"):
    out = {}
    for r in df.collect():
        out.setdefault(r["image_id"], np.zeros(shape))[r["y"], r["x"]] = r[value]
    return out


def flood(mask):
    labels, n = np.zeros(mask.shape, int), 0
    for y, x in zip(*np.nonzero(mask), strict=True):
        if labels[y, x]:
            continue
        n += 1
        todo = [(y, x)]
        while todo:
            a, b = todo.pop()
            if 0 <= a < mask.shape[0] and 0 <= b < mask.shape[1] and mask[a, b] and not labels[a, b]:
                labels[a, b] = n
                todo += [(a + i, b + j) for i in (-1, 0, 1) for j in (-1, 0, 1)]
    return labels


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 12), st.integers(1, 12), st.integers(0, 10**6))
def test_label_grid_is_flood_fill(h, w, seed):
    mask = np.random.default_rng(seed).random((h, w)) > 0.5
    own, want = cc.label_grid(mask), flood(mask)
    assert ((own > 0) == mask).all()
    assert len({(a, b) for a, b in zip(own[mask], want[mask], strict=True)}) == len(set(want[mask])) == len(set(own[mask]))


def test_tiled_labels_equal_whole_image_labels(spark, tmp_path):
    spark.sparkContext.setCheckpointDir(str(tmp_path))
    rng = np.random.default_rng(3)
    masks = [rng.random((13, 17)) > 0.55 for _ in range(3)]
    fg = px.threshold(frame(spark, masks), 0.5)
    whole = {tuple(r) for r in cc.label_images(fg).collect()}
    assert whole == {tuple(r) for r in cc.label_tiled(fg, tile=5).collect()}


def test_opening_and_blur_match_numpy(spark):
    rng = np.random.default_rng(1)
    images = [rng.random((7, 9)) for _ in range(2)]

    def morph(a, f):
        p = np.pad(a, 1, constant_values=np.nan)
        return f([p[i : i + a.shape[0], j : j + a.shape[1]] for i in range(3) for j in range(3)], axis=0)

    got = grids(win.opened(frame(spark, images)), (7, 9))
    blurred = grids(win.gaussian(frame(spark, images)), (7, 9))
    for i, a in enumerate(images):
        assert np.allclose(got[i], morph(morph(a, np.nanmin), np.nanmax))
        p = np.pad(a, 2, mode="reflect")
        w = np.array(win.GAUSS5)
        want = sum(w[i + 2] * w[j + 2] * p[2 + i : 9 + i, 2 + j : 11 + j] for i in range(-2, 3) for j in range(-2, 3))
        assert np.allclose(blurred[i], want)


def test_polygon_fill_matches_crossing_test(spark):
    ring = [(1, 1), (9, 2), (7, 8), (4, 4), (2, 9)]
    df = spark.createDataFrame([(1, [{"x": x, "y": y} for x, y in ring])], "image_id long, points array<struct<x:int,y:int>>")
    got = {(r.y, r.x) for r in raster.fill_polygons(df, ["image_id"]).collect()}

    def inside(y, x):
        hit = False
        for (xa, ya), (xb, yb) in zip(ring, ring[1:] + ring[:1], strict=True):
            if (ya <= y) != (yb <= y) and x >= xa + (y - ya) * (xb - xa) / (yb - ya):
                hit = not hit
        return hit

    assert got == {(y, x) for y in range(12) for x in range(12) if inside(y, x)}


def test_shapes_of_a_rectangle(spark):
    mask = spark.createDataFrame([(1, y, x) for y in range(3, 9) for x in range(2, 12)], "image_id long, y int, x int")
    sizes = spark.createDataFrame([(1, 20, 20)], "image_id long, height int, width int")
    box = vectorize.find_boxes(mask, "min_rectangle", 0.01, sizes).first()
    assert {(p.x, p.y) for p in box.points} == {(2, 3), (11, 3), (11, 8), (2, 8)} and box.area == 45
    quad = vectorize.find_boxes(mask, "quadrilateral", 0.01, sizes).first()
    assert {(p.x, p.y) for p in quad.points} == {(2, 3), (11, 3), (11, 8), (2, 8)}
    ring = vectorize.find_polygons(mask).first().points
    assert ring[0] == ring[-1] and len(ring) == 5
    line = vectorize.find_lines(spark.createDataFrame([(1, 5, x) for x in range(20)], "image_id long, y int, x int")).first().points
    assert [(p.x, p.y) for p in line] == [(0, 5), (5, 5), (10, 5), (15, 5), (19, 5)]


def test_denoise_keeps_a_flat_image(spark):
    assert np.allclose(grids(vectorize.denoise(frame(spark, [np.full((6, 6), 0.3)]), search=5), (6, 6))[0], 0.3)


def test_points_and_tags(spark):
    df = spark.createDataFrame([("1,2 3.9,-4.9", "structure {type:heading;}"), ("", None), (None, "x {type:a;} {type:b;}")], "p string, c string")
    rows = df.select(geo.format_points(geo.parse_points(F.col("p"))).alias("p"), tx.tags(F.col("c")).alias("t")).collect()
    assert [(r.p, r.t) for r in rows] == [("1,2 3,-4", ["heading"]), ("", []), ("", ["a;} {type:b"])]
    with pytest.raises(Exception, match="not a point"):
        spark.createDataFrame([("1,2  3,4",)], "p string").select(geo.parse_points(F.col("p"))).collect()


def test_settings_are_checked():
    assert TrainingSettings.from_dict({"n_epochs": 3}).to_dict()["n_epochs"] == 3
    with pytest.raises(ValueError):
        TrainingSettings.from_dict({"no_such": 1})
    with pytest.raises(ValueError):
        TrainingSettings(margin=200)
