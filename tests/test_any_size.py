"""Operators that had a size limit or one task for a whole group, against brute force."""

import random

import pytest
from pyspark.sql import functions as F

from foliospark.config import TrainingSettings
from foliospark.operators import augment, labels, losses, pairing
from foliospark.plans import evaluation_queries


@pytest.mark.parametrize(("n", "edge", "spread"), [(100_000, 8, 256), (300, 8, 256), (3000, 16, 20), (40, 64, 256), (0, 8, 256)])
def test_nearest_of_many_colours(spark, n, edge, spread):
    """100,000 colours, few ones, and all in one corner of the cube; of equals the first class."""
    import numpy as np

    rng = np.random.default_rng(n)
    colours = rng.integers(0, spread, (n, 3))
    pixels = rng.integers(0, 256, (150, 3))
    frame = spark.createDataFrame([(i, *map(int, p)) for i, p in enumerate(pixels)] + [(999, None, 1, 2)], "i int, r int, g int, b int")
    palette = spark.createDataFrame([(k, *map(int, c)) for k, c in enumerate(colours)], "class_id int, r int, g int, b int")
    got = {r.i: r.class_id for r in labels.nearest_in_cells(frame, palette, edge=edge).collect()}
    for i, p in enumerate(pixels):
        assert got[i] == (int(((colours - p) ** 2).sum(axis=1).argmin()) if n else None)
    assert got[999] is None and len(got) == 151


def test_nearest_class_has_no_limit(spark):
    rng = random.Random(2)
    entries = [(k, rng.randrange(256), rng.randrange(256), rng.randrange(256)) for k in range(400)]
    frame = spark.createDataFrame([(i, rng.randrange(256), rng.randrange(256), rng.randrange(256)) for i in range(80)], "i int, r int, g int, b int")
    palette = spark.createDataFrame(entries, "class_id int, r int, g int, b int")
    one, two = ({r.i: r.class_id for r in labels.nearest_class(frame, palette, limit=k).collect()} for k in (10, 1000))
    assert one == two


def test_numbers_over_many_partitions(spark):
    rng = random.Random(3)
    rows = [(rng.choice(["a", "a", "a", "b", None]), i, rng.random()) for i in range(2000)]
    df = spark.createDataFrame(rows, "g string, i int, v double").repartition(7)
    got = {(r.g, r.i): r.place for r in pairing.numbered(df, ["g"], ["v"]).collect()}
    for g in ("a", "b", None):
        own = sorted((v, i) for x, i, v in rows if x == g)
        assert [got[g, i] for _, i in own] == list(range(len(own)))
    assert pairing.numbered(df.where("false"), ["g"], ["v"]).count() == 0


def test_no_window_over_a_group(spark):
    """Windows are within a partition of the order (or over the few sums of partitions), never over a language alone."""
    plan = evaluation_queries.batches(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    windows = [line for line in plan.split("\n") if "Window [" in line]
    assert len(windows) == 2 and all("_part" in line for line in windows)
    plan = evaluation_queries.focal_loss(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan


def test_buffered_shuffle_stays_near(spark):
    df = spark.range(1000).select(F.lit("x").alias("g"), F.col("id"))
    got = {r.id: r.place for r in pairing.buffered_shuffle(df, ["g"], ["id"], "id", 50, 1).collect()}
    assert sorted(got.values()) == list(range(1000)) and all(i // 50 == p // 50 for i, p in got.items())
    assert sum(i != p for i, p in got.items()) > 900


def test_padding(spark):
    rows = [(0, 1, y, x, 1.5) for y in range(2) for x in range(3)] + [(0, 2, y, x, 2.5) for y in range(4) for x in range(1)] + [(1, 3, 0, 0, 9.0)]
    df = spark.createDataFrame(rows, "batch int, image_id int, y int, x int, v double")
    got = {(r.image_id, r.y, r.x): r.v for r in pairing.pad_batches(df, "batch", ["v"]).collect()}
    held = {(i, y, x): v for _, i, y, x, v in rows}
    assert got == {(i, y, x): held.get((i, y, x), 0.0) for i in (1, 2) for y in range(4) for x in range(3)} | {(3, 0, 0): 9.0}


def test_focal_over_all_pixels(spark):
    df = spark.createDataFrame([(i, [float(i % 3), 1.0], i % 2) for i in range(20)], "i int, z array<double>, label int")
    rows = losses.focal(df, 2.0, per_pixel=False).collect()
    assert len({round(r.loss / losses_of(r), 9) for r in rows}) == 1


def losses_of(r):
    import math

    return math.log(sum(math.exp(v) for v in r.z)) - r.z[r.label]


def test_entropy_weights_in_the_training_table(spark):
    images = spark.createDataFrame([(i, y, x, y * 9, x * 9, 5) for i in range(3) for y in range(8) for x in range(8)], "image_id long, y int, x int, r int, g int, b int")
    marks = images.select("image_id", "y", "x", F.when((F.col("x") < 4) | (F.col("y") > 5), 255).otherwise(0).alias("r"), F.lit(0).alias("g"), F.lit(0).alias("b"))
    palette = spark.createDataFrame([(0, 0, 0, 0), (1, 255, 0, 0)], "class_id int, r int, g int, b int")
    plain = TrainingSettings(n_epochs=1, make_patches=False, augment_flip=False)
    assert "weight" not in augment.training_table(images, marks, palette, plain).columns
    weighted = TrainingSettings(n_epochs=1, make_patches=False, augment_flip=False, local_entropy_ratio=0.5, local_entropy_sigma=1.0)
    rows = augment.training_table(images, marks, palette, weighted).collect()
    assert len(rows) == 192 and min(r.weight for r in rows) >= 0.5 and len({round(r.weight, 6) for r in rows}) > 3
