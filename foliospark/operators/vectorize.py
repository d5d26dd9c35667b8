"""Masks to shapes: contours, polygons, rotated boxes, quadrilaterals, lines. NumPy kernels on images."""

from __future__ import annotations

from collections import deque
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels
from .components import label_grid, largest

_AROUND = [(0, 1), (1, 1), (1, 0), (1, -1), (0, -1), (-1, -1), (-1, 0), (-1, 1)]  # clockwise from the right
POINTS = "array<struct<x:int,y:int>>"


def grid_of(image: tuple) -> tuple[np.ndarray, int, int]:
    y0, x0 = int(image.y.min()), int(image.x.min())
    grid = np.zeros((int(image.y.max()) - y0 + 1, int(image.x.max()) - x0 + 1), bool)
    grid[image.y - y0, image.x - x0] = True
    return grid, y0, x0


def _packed(mask: DataFrame, sizes: DataFrame | None = None, sized: bool = False) -> DataFrame:
    """A row for each image; for each component if ``mask`` has them (``components.label_tiled``), so that images of any size will do. ``sized``: with height and width."""
    keys = ["image_id", "component"] if "component" in mask.columns else ["image_id"]
    rows = mask.select(F.col("image_id").cast("long"), *keys[1:], F.col("y").cast("int"), F.col("x").cast("int"))
    if sized and sizes is None:
        sizes = rows.groupBy("image_id").agg((F.max("y") + 1).alias("height"), (F.max("x") + 1).alias("width"))
    packed = kernels.pack(rows, keys)
    return packed.join(sizes.select("image_id", "height", "width"), "image_id") if sized else packed


def outer_contour(grid: np.ndarray, start: tuple[int, int]) -> list[tuple[int, int]]:
    """(x, y) around the component whose first pixel in reading order is ``start``: Moore tracing, corners only."""
    h, w = grid.shape

    def inside(y: int, x: int) -> bool:
        return 0 <= y < h and 0 <= x < w and bool(grid[y, x])

    y, x = start
    walk, seen, way = [(x, y)], set(), 4  # as if it came from the left
    while True:
        for turn in range(1, 9):
            k = (way + turn) % 8
            if inside(y + _AROUND[k][0], x + _AROUND[k][1]):
                break
        else:
            break
        if (y, x, k) in seen:
            break
        seen.add((y, x, k))
        y, x, way = y + _AROUND[k][0], x + _AROUND[k][1], (k + 4) % 8
        walk.append((x, y))
    if len(walk) > 1 and walk[-1] == walk[0]:
        walk.pop()
    n = len(walk)
    step = lambda i: (walk[(i + 1) % n][0] - walk[i % n][0], walk[(i + 1) % n][1] - walk[i % n][1])
    return [walk[i] for i in range(n) if n < 3 or step(i - 1) != step(i)]


def contours(grid: np.ndarray) -> list[list[tuple[int, int]]]:
    labels = label_grid(grid)
    firsts = np.unique(labels[labels > 0]) - 1
    ys, xs = np.nonzero(labels)
    order = np.argsort(labels[ys, xs], kind="stable")
    ys, xs, own = ys[order], xs[order], labels[ys, xs][order]
    out = []
    for f, lo, hi in zip(firsts, np.searchsorted(own, firsts + 1), np.searchsorted(own, firsts + 1, side="right"), strict=True):
        y0, x0 = int(ys[lo:hi].min()), int(xs[lo:hi].min())  # a component's own box, not the whole image
        part = np.zeros((int(ys[lo:hi].max()) - y0 + 1, int(xs[lo:hi].max()) - x0 + 1), bool)
        part[ys[lo:hi] - y0, xs[lo:hi] - x0] = True
        out.append([(x + x0, y + y0) for x, y in outer_contour(part, (int(f) // grid.shape[1] - y0, int(f) % grid.shape[1] - x0))])
    return out


def polygon_area(points: list[tuple[float, float]]) -> float:
    return abs(sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(points, points[1:] + points[:1], strict=True))) / 2


def hull(points: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Convex hull (monotone chain)."""
    points = sorted(set(points))
    if len(points) < 3:
        return points

    def half(path: list[tuple[int, int]]) -> list[tuple[int, int]]:
        out: list[tuple[int, int]] = []
        for p in path:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(p)
        return out[:-1]

    return half(points) + half(points[::-1])


def min_area_rectangle(points: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Corners (rounded down) of the smallest rectangle around the points: one side lies on a side of the hull."""
    around = np.array(hull(points), float)
    if len(around) < 3:
        return [tuple(map(int, p)) for p in np.repeat(around, 4 // max(1, len(around)), axis=0)[:4]]
    best, corners = np.inf, around
    for a, b in zip(around, np.roll(around, -1, axis=0), strict=True):
        u = (b - a) / np.hypot(*(b - a))
        v = np.array([-u[1], u[0]])
        s, t = around @ u, around @ v
        size = (s.max() - s.min()) * (t.max() - t.min())
        if size < best - 1e-9:
            best = size
            corners = np.array([u * i + v * j for i, j in ((s.min(), t.min()), (s.max(), t.min()), (s.max(), t.max()), (s.min(), t.max()))])
    return [(int(np.floor(x + 1e-9)), int(np.floor(y + 1e-9))) for x, y in corners]


def simplify(points: list[tuple[int, int]], tolerance: float) -> list[tuple[int, int]]:
    """A ring with fewer corners, none of the left-out ones further off than ``tolerance`` (Douglas-Peucker)."""
    if len(points) < 4:
        return points
    p = np.array(points, float)
    far = int(np.argmax(((p - p[0]) ** 2).sum(axis=1)))
    keep = {0, far}
    todo = [(0, far), (far, len(p))]
    while todo:
        i, j = todo.pop()
        if j - i < 2:
            continue
        a, b = p[i], p[j % len(p)]
        d = b - a
        n = np.hypot(*d)
        off = np.abs(d[0] * (p[i + 1 : j, 1] - a[1]) - d[1] * (p[i + 1 : j, 0] - a[0])) / n if n else np.hypot(*(p[i + 1 : j] - a).T)
        k = i + 1 + int(np.argmax(off))
        if off[k - i - 1] > tolerance:
            keep.add(k)
            todo += [(i, k), (k, j)]
    return [points[i] for i in sorted(keep)]


def quadrilateral(points: list[tuple[int, int]], height: int, width: int, tolerance: float = 0.02) -> list[tuple[int, int]] | None:
    """Four corners of a contour: its simplified hull, or of more corners those nearest to the image's; fewer than four: none."""
    ring = list(zip(points, points[1:] + points[:1], strict=True))
    length = sum(np.hypot(b[0] - a[0], b[1] - a[1]) for a, b in ring)
    corners = hull(simplify(points, tolerance * length))
    if len(corners) < 4:
        return None
    if len(corners) > 4:
        ends = [(0, 0), (width - 1, 0), (width - 1, height - 1), (0, height - 1)]
        corners = [min(corners, key=lambda c, e=e: (np.hypot(c[0] - e[0], c[1] - e[1]), corners.index(c))) for e in ends]
    return corners


def _top(found: DataFrame, n: int | None) -> DataFrame:
    """The n largest of each image, of equals by their points."""
    return found if n is None else largest(found, n, "area", ties=("points",))


def find_boxes(mask: DataFrame, mode: str = "min_rectangle", min_area: float = 0.0, sizes: DataFrame | None = None, tolerance: float = 0.02, n_max: int | None = None) -> DataFrame:
    """image_id, points (four corners), area of each component's box; modes min_rectangle, quadrilateral, rectangle.

    mask: image_id, y, x of the foreground. sizes (image_id, height, width): the images' sizes; without it the
    foreground's extent. With a column component the work is done by component. Boxes of ``min_area`` (a share of the image) or less are left out, and all but the
    ``n_max`` largest of an image; corners are held inside the image.
    """
    if mode not in ("min_rectangle", "quadrilateral", "rectangle"):
        raise ValueError(f"unknown mode: {mode}")

    def kernel(image: tuple) -> list[tuple]:
        grid, y0, x0 = grid_of(image)
        h, w = int(image.height), int(image.width)
        out = []
        for ring in contours(grid):
            ring = [(x + x0, y + y0) for x, y in ring]
            if mode == "rectangle":
                xs, ys = [p[0] for p in ring], [p[1] for p in ring]
                corners = [(min(xs), min(ys)), (max(xs) + 1, min(ys)), (max(xs) + 1, max(ys) + 1), (min(xs), max(ys) + 1)]
            elif mode == "min_rectangle":
                corners = min_area_rectangle(ring)
            else:
                corners = quadrilateral(ring, h, w, tolerance)
            if corners is None:
                continue
            area = polygon_area(corners)
            if area > min_area * h * w:
                out.append((image.image_id, [{"x": max(0, min(w, x)), "y": max(0, min(h, y))} for x, y in corners], area))
        return out

    return _top(kernels.run(_packed(mask, sizes, True), kernel, f"image_id long, points {POINTS}, area double"), n_max)


def find_polygons(mask: DataFrame, min_area: float = 0.1, sizes: DataFrame | None = None, n_max: int | None = None) -> DataFrame:
    """image_id, points (a closed ring of the outer contour), area, of each image's ``n_max`` largest.

    Rings under three corners or of ``min_area`` (a share of the image) or less are left out; sizes as for ``find_boxes``.
    """

    def kernel(image: tuple) -> list[tuple]:
        grid, y0, x0 = grid_of(image)
        h, w = int(image.height), int(image.width)
        rings = [[(x + x0, y + y0) for x, y in ring] for ring in contours(grid)]
        return [(image.image_id, [{"x": x, "y": y} for x, y in [*r, r[0]]], polygon_area(r)) for r in rings if len(r) > 2 and polygon_area(r) > min_area * h * w]

    return _top(kernels.run(_packed(mask, sizes, True), kernel, f"image_id long, points {POINTS}, area double"), n_max)


def skeleton(grid: np.ndarray) -> np.ndarray:
    """One-pixel-wide lines by parallel thinning in two alternating steps (Zhang and Suen, 1984)."""
    a = np.pad(grid, 1).astype(np.uint8)
    while True:
        changed = False
        for step in (0, 1):
            n = [a[:-2, 1:-1], a[:-2, 2:], a[1:-1, 2:], a[2:, 2:], a[2:, 1:-1], a[2:, :-2], a[1:-1, :-2], a[:-2, :-2]]
            count = sum(x.astype(int) for x in n)
            turns = sum(((p == 0) & (q == 1)).astype(int) for p, q in zip(n, n[1:] + n[:1], strict=True))
            up, right, down, left = n[0], n[2], n[4], n[6]
            third = (up * right * down == 0) & (right * down * left == 0) if step == 0 else (up * right * left == 0) & (up * down * left == 0)
            gone = (a[1:-1, 1:-1] == 1) & (count >= 2) & (count <= 6) & (turns == 1) & third
            if gone.any():
                a[1:-1, 1:-1][gone] = 0
                changed = True
        if not changed:
            return a[1:-1, 1:-1].astype(bool)


def trace_lines(grid: np.ndarray, every: int = 5) -> list[list[tuple[int, int]]]:
    """(x, y) along each skeleton component, between the two end pixels furthest apart, every ``every``-th pixel and the last; closed loops have no end and give nothing."""
    thin = skeleton(grid)
    labels = label_grid(thin)
    h, w = grid.shape
    out = []
    for label in np.unique(labels[labels > 0]):
        ys, xs = np.nonzero(labels == label)
        pixels = set(zip(ys.tolist(), xs.tolist(), strict=True))
        near = lambda p: [(p[0] + dy, p[1] + dx) for dy, dx in _AROUND if (p[0] + dy, p[1] + dx) in pixels]  # noqa: E731, B023
        ends = sorted(p for p in pixels if len(near(p)) <= 1)
        if not ends:
            continue
        a, b = max(((p, q) for i, p in enumerate(ends) for q in ends[i:]), key=lambda e: (e[0][0] - e[1][0]) ** 2 + (e[0][1] - e[1][1]) ** 2)
        back, queue = {a: a}, deque([a])
        while queue and b not in back:
            p = queue.popleft()
            for q in near(p):
                if q not in back:
                    back[q] = p
                    queue.append(q)
        path = [b]
        while path[-1] != a:
            path.append(back[path[-1]])
        path.reverse()
        picked = path[::every] + ([path[-1]] if (len(path) - 1) % every else [])
        out.append([(x, y) for y, x in picked])
    return out


def find_lines(mask: DataFrame, every: int = 5) -> DataFrame:
    """image_id, points of the centre line of each component."""

    def kernel(image: tuple) -> list[tuple]:
        grid, y0, x0 = grid_of(image)
        return [(image.image_id, [{"x": x + x0, "y": y + y0} for x, y in line]) for line in trace_lines(grid, every)]

    return kernels.run(_packed(mask), kernel, f"image_id long, points {POINTS}")


def _map_images(pixels: DataFrame, filtered: Callable[[np.ndarray], np.ndarray], value: str) -> DataFrame:
    def kernel(r: tuple) -> list[tuple]:
        a = np.asarray(getattr(r, value), np.float64).reshape(int(r.y.max() - r.y.min()) + 1, -1)
        return [(r.image_id, r.y, r.x, filtered(a).ravel())]

    rows = pixels.select(F.col("image_id").cast("long"), F.col("y").cast("int"), F.col("x").cast("int"), F.col(value).cast("double"))
    out = kernels.run(kernels.pack(rows, ["image_id"], [value]), kernel, f"image_id long, y array<int>, x array<int>, {value} array<double>")
    return kernels.unpack(out, ["image_id"], ["y", "x", value])


def denoise(pixels: DataFrame, strength: float = 20 / 255, patch: int = 3, search: int = 7, value: str = "v") -> DataFrame:
    """Non-local means: each pixel becomes the mean of those in the search window, weighted by how alike their patches are."""

    def kernel(a: np.ndarray) -> np.ndarray:
        r, s = patch // 2, search // 2
        big = np.pad(a, r + s, mode="reflect" if min(a.shape) > r + s else "edge")
        total, weights = np.zeros_like(a), np.zeros_like(a)
        for dy in range(-s, s + 1):
            for dx in range(-s, s + 1):
                far = np.zeros_like(a)
                for py in range(-r, r + 1):
                    for px in range(-r, r + 1):
                        own = big[r + s + py : r + s + py + a.shape[0], r + s + px : r + s + px + a.shape[1]]
                        other = big[r + s + py + dy : r + s + py + dy + a.shape[0], r + s + px + dx : r + s + px + dx + a.shape[1]]
                        far += (own - other) ** 2
                w = np.exp(-far / (patch * patch * strength * strength))
                total += w * big[r + s + dy : r + s + dy + a.shape[0], r + s + dx : r + s + dx + a.shape[1]]
                weights += w
        return total / weights

    return _map_images(pixels, kernel, value)


def local_entropy(classes: DataFrame, sigma: float = 3.0, kinds: int = 20, seed: int = 0, value: str = "v") -> DataFrame:
    """Weight map: how mixed the components around a pixel are. Components get one of ``kinds`` ids by a seeded hash; their blurred shares give an entropy."""

    def kernel(a: np.ndarray) -> np.ndarray:
        r = 3 * round(sigma)
        g = np.exp(-(np.arange(-r, r + 1) ** 2) / (2 * sigma * sigma))
        ids = np.zeros(a.shape, int)
        for c in np.unique(a):
            labels = label_grid(a == c)
            ids = np.where(labels > 0, (labels * 2654435761 + int(c) * 40503 + seed) % kinds, ids)
        blur = lambda x: np.apply_along_axis(np.convolve, 1, np.apply_along_axis(np.convolve, 0, np.pad(x, r), g, "valid"), g, "valid")
        shares = np.stack([blur((ids == k).astype(float)) ** (1 / 1.4) for k in range(kinds)])
        shares /= shares.sum(axis=0)
        return -(shares * np.log(np.maximum(shares, 1e-12))).sum(axis=0)

    return _map_images(classes, kernel, value)
