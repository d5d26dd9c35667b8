"""Nearest colours of large palettes: over the cube of colours, against brute force."""

import random

import pytest

from foliospark.operators import labels


@pytest.mark.parametrize(("span", "entries", "shift"), [((-9, 260), 400, 0), ((0, 60), 3000, 5), ((0, 2000), 300, 0)])
def test_nearest_over_the_cube(spark, span, entries, shift, monkeypatch):
    """Negative values, equal colours, equal distances, nulls; channels too wide for the cube go by cells."""
    rng = random.Random(entries)
    colour = lambda low, high: tuple(rng.randint(low, high) for _ in range(3))
    palette = [(10**9 + 7 * i - (i % 3) * 1000, *colour(*span)) for i in range(entries)] + [(5, None, 1, 1)]
    pixels = [(i, *colour(span[0] - shift, span[1])) for i in range(300)] + [(999, None, 2, 2)]
    used = []
    cells = labels.nearest_in_cells
    monkeypatch.setattr(labels, "nearest_in_cells", lambda *a: used.append(1) or cells(*a, edge=256))
    found = labels.nearest_class(spark.createDataFrame(pixels, "i int, r int, g int, b int"), spark.createDataFrame(palette, "class_id long, r int, g int, b int"))
    got = {r.i: r.class_id for r in found.collect()}
    want = {i: min(((r - p) ** 2 + (g - q) ** 2 + (b - s) ** 2, c) for c, p, q, s in palette if p is not None)[1] for i, r, g, b in pixels if r is not None}
    assert got == want | {999: None} and bool(used) == (span[1] > 512)


def test_shuffles_do_not_grow_by_rings(spark):
    """Colours meet slabs and lines, not each colour of the cells around it."""
    from foliospark.plans import evaluation_queries

    made = []
    frame = type(spark.range(0))
    join = frame.join
    frame.join = lambda self, other, *a, **b: made.append(1) or join(self, other, *a, **b)
    try:
        assert evaluation_queries.rgb_to_many_classes(spark, "/root/testdata/sf0.001").count() > 0
    finally:
        frame.join = join
    assert len(made) == 1  # of pixels and their colours' classes
