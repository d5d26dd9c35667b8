"""Areas that polygons share, exact, as column expressions.

Convex polygons are cut by each other's half-planes. Any others, also concave ones and ones that cross themselves, are
cut into slabs at the heights of all corners and crossings: within a slab no edges cross, so the width that both
polygons cover by the even-odd rule is linear in the height and its middle gives the exact area.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

PLACES = "array<struct<x:double,y:double>>"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once a row, however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, v: a + v)


def _turned(points: Column) -> Column:
    """Each point's next one."""
    return F.concat(F.slice(points, F.lit(2), F.greatest(F.size(points) - 1, F.lit(0))), F.slice(points, 1, 1))


def _edges(points: Column) -> Column:
    return let(points.cast(PLACES), lambda p: F.zip_with(p, _turned(p), lambda a, b: F.struct(a["x"].alias("x1"), a["y"].alias("y1"), b["x"].alias("x2"), b["y"].alias("y2"))))


def signed_area(points: Column) -> Column:
    """Of a polygon that doesn't cross itself: positive if its corners go from x to y."""
    return _total(F.transform(_edges(points), lambda e: e["x1"] * e["y2"] - e["x2"] * e["y1"])) / 2


def convex_intersection(subject: Column, clip: Column) -> Column:
    """Corners (doubles) of what a polygon shares with a convex one, in either direction; empty if that is nothing or ``clip`` has no area."""
    none = F.array().cast(PLACES)

    def cut(poly: Column, e: Column, turn: Column) -> Column:
        side = lambda p: ((e["x2"] - e["x1"]) * (p["y"] - e["y1"]) - (e["y2"] - e["y1"]) * (p["x"] - e["x1"])) * turn
        sided = lambda ps: F.transform(ps, lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y"), side(p).alias("d")))
        place = lambda x, y: F.array(F.struct(x.alias("x"), y.alias("y")))

        def corner(p: Column, q: Column) -> Column:
            share = p["d"] / (p["d"] - q["d"])
            crossing = place(p["x"] + (q["x"] - p["x"]) * share, p["y"] + (q["y"] - p["y"]) * share)
            return F.concat(F.when(p["d"] >= 0, place(p["x"], p["y"])).otherwise(none), F.when((p["d"] >= 0) != (q["d"] >= 0), crossing).otherwise(none))

        return let(sided(poly), lambda ps: F.flatten(F.zip_with(ps, _turned(ps), corner)))

    whole = lambda turn: F.aggregate(_edges(clip), subject.cast(PLACES), lambda poly, e: cut(poly, e, turn))
    return let(F.signum(signed_area(clip)), lambda turn: F.when(turn == 0, none).otherwise(whole(turn)))


def convex_overlap(a: Column, b: Column) -> Column:
    """Area that a polygon shares with a convex one, ``b``."""
    return F.abs(signed_area(convex_intersection(a, b)))


def is_convex(points: Column) -> Column:
    """Do the corners turn one way only, once round? (Straight corners count for either.)"""

    def turns(e: Column) -> Column:
        return F.zip_with(e, _turned(e), lambda a, b: (a["x2"] - a["x1"]) * (b["y2"] - b["y1"]) - (a["y2"] - a["y1"]) * (b["x2"] - b["x1"]))

    def rises(e: Column) -> Column:
        """How often the way changes between up and down: twice for once round."""
        ups = F.filter(F.transform(e, lambda s: F.signum(s["y2"] - s["y1"])), lambda s: s != 0)
        return let(ups, lambda u: F.size(F.filter(F.zip_with(u, _turned(u), lambda p, q: p != q), lambda c: c)))

    return let(_edges(points), lambda e: let(turns(e), lambda t: (F.forall(t, lambda v: v >= 0) | F.forall(t, lambda v: v <= 0)) & (rises(e) <= 2)))


def even_odd_areas(a: Column, b: Column) -> Column:
    """struct a, b, both: the areas of two polygons by the even-odd rule and what they share. Fewer than three points have no area."""

    def crossing(e: Column, f: Column) -> Column:
        dx, dy, fx, fy = e["x2"] - e["x1"], e["y2"] - e["y1"], f["x2"] - f["x1"], f["y2"] - f["y1"]
        across = F.nullif(dx * fy - dy * fx, F.lit(0.0))
        t = ((f["x1"] - e["x1"]) * fy - (f["y1"] - e["y1"]) * fx) / across
        u = ((f["x1"] - e["x1"]) * dy - (f["y1"] - e["y1"]) * dx) / across
        return F.when((t > 0) & (t < 1) & (u > 0) & (u < 1), e["y1"] + t * dy)

    def spans(edges: Column, y: Column) -> Column:
        """left, right of the parts of a line that are inside."""
        crossed = F.filter(edges, lambda e: (e["y1"] <= y) != (e["y2"] <= y))
        at = F.array_sort(F.transform(crossed, lambda e: e["x1"] + (y - e["y1"]) * (e["x2"] - e["x1"]) / (e["y2"] - e["y1"])))
        paired = lambda xs: F.zip_with(xs, _turned(xs), lambda l, r: F.struct(l.alias("left"), r.alias("right")))
        return let(at, lambda xs: F.filter(paired(xs), lambda s, i: i % 2 == 0))

    def slab(low: Column, high: Column, ea: Column, eb: Column) -> Column:
        width = lambda s: _total(F.transform(s, lambda p: p["right"] - p["left"]))
        shared = lambda s, t: _total(F.transform(s, lambda p: _total(F.transform(t, lambda q: F.greatest(F.lit(0.0), F.least(p["right"], q["right"]) - F.greatest(p["left"], q["left"]))))))
        middle, high_of = (low + high) / 2, high - low
        return let(F.struct(spans(ea, middle).alias("a"), spans(eb, middle).alias("b")), lambda s: F.struct((width(s["a"]) * high_of).alias("a"), (width(s["b"]) * high_of).alias("b"), (shared(s["a"], s["b"]) * high_of).alias("both")))

    def slabs(e: Column) -> Column:
        every = F.concat(e["a"], e["b"])
        ys = lambda es: F.concat(F.transform(es, lambda s: s["y1"]), F.flatten(F.transform(es, lambda s: F.filter(F.transform(es, lambda f: crossing(s, f)), lambda y: y.isNotNull()))))
        levels = F.array_sort(F.array_distinct(let(every, ys)))
        return let(levels, lambda v: F.zip_with(F.slice(v, F.lit(1), F.greatest(F.size(v) - 1, F.lit(0))), F.slice(v, F.lit(2), F.greatest(F.size(v) - 1, F.lit(0))), lambda low, high: slab(low, high, e["a"], e["b"])))

    def sums(s: Column) -> Column:
        field = lambda name: lambda p: p[name]
        return F.struct(*[_total(F.transform(s, field(c))).alias(c) for c in ("a", "b", "both")])

    return let(let(F.struct(_edges(a).alias("a"), _edges(b).alias("b")), slabs), sums)


def polygon_iou(a: Column, b: Column, convex: bool = False) -> Column:
    """Shared area over the area of both together; null if neither has any. ``convex``: both are known to be so."""
    if convex:
        areas = F.struct(F.abs(signed_area(a)).alias("a"), F.abs(signed_area(b)).alias("b"), convex_overlap(a, b).alias("both"))
    else:
        areas = even_odd_areas(a, b)
    return let(areas, lambda s: s["both"] / F.nullif(s["a"] + s["b"] - s["both"], F.lit(0.0)))
