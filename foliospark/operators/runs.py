"""Shapes as runs of pixels, united by key.

Shapes are brought together by key, sorted by it within their partitions and streamed through: only runs of rows are ever
held, never pixels, and of a key no more than its united runs and a million new ones at a time. So work and bytes moved grow with shapes and the rows
they cross, not with their areas.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of shapes that are cut into runs at once.
CHUNK = 1_000_000

Runs = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]  # shape (place in the chunk), y, left, right


def _counted(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each shape's rows: the shape's place, and the row's number within it."""
    own = np.repeat(np.arange(len(counts)), counts)
    return own, np.arange(len(own)) - np.repeat(np.cumsum(counts) - counts, counts)


def _ints(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return batch.column(name).to_numpy(zero_copy_only=False).astype(np.int64)


def _points(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sizes of lists of points, and all points' x and y."""
    column = batch.column("points")
    places = column.flatten()
    return np.asarray(pc.list_value_length(column)).astype(np.int64), *[np.asarray(pc.struct_field(places, c)).astype(np.int64) for c in "xy"]


def rectangle_rows(batch: pa.RecordBatch) -> np.ndarray:
    return _ints(batch, "h") + 1


def rectangle_runs(batch: pa.RecordBatch) -> Runs:
    """From x to x + w and y to y + h, both inclusive."""
    x, y, w = (_ints(batch, c) for c in "xyw")
    own, k = _counted(np.maximum(rectangle_rows(batch), 0))
    return own, y[own] + k, x[own], x[own] + w[own]


def circle_rows(batch: pa.RecordBatch) -> np.ndarray:
    return 2 * _ints(batch, "r") + 1


def circle_runs(batch: pa.RecordBatch) -> Runs:
    """Within r of (cx, cy)."""
    cx, cy, r = (_ints(batch, c) for c in ("cx", "cy", "r"))
    own, k = _counted(np.maximum(circle_rows(batch), 0))
    dy = k - r[own]
    square = r[own] ** 2 - dy**2
    half = np.sqrt(square).astype(np.int64)
    half += (half + 1) ** 2 <= square
    half -= half**2 > square
    return own, cy[own] + dy, cx[own] - half, cx[own] + half


def polygon_rows(batch: pa.RecordBatch) -> np.ndarray:
    size, _, ys = _points(batch)
    return _span(size, ys) * np.maximum(size // 2, 1)


def _span(size: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Largest less smallest value of lists."""
    out, some = np.zeros(len(size), np.int64), size > 0
    at = (np.cumsum(size) - size)[some]
    if len(at):
        out[some] = np.maximum.reduceat(v, at) - np.minimum.reduceat(v, at)
    return out


def polygon_runs(batch: pa.RecordBatch) -> Runs:
    """Pixels inside by the even-odd rule: from a left crossing, rounded up, to before the right one; three points at least."""
    size, x1, y1 = _points(batch)
    own = np.repeat(np.arange(len(size)), size)
    after = np.arange(1, len(own) + 1)
    last = np.cumsum(size)[size > 0]
    after[last - 1] = last - size[size > 0]  # of a ring's last point the first
    x2, y2 = x1[after], y1[after]
    edge = np.flatnonzero((y1 != y2) & (size[own] >= 3))
    edge, k = (lambda o, k: (edge[o], k))(*_counted(np.abs(y2 - y1)[edge]))
    y = np.minimum(y1, y2)[edge] + k
    at = x1[edge] + (y - y1[edge]) * (x2 - x1)[edge].astype(np.float64) / (y2 - y1)[edge]
    own, y, at = sort_rows(own[edge], y, np.ceil(at).astype(np.int64))
    # an even number of edges crosses each row
    return own[::2], y[::2], at[::2], at[1::2] - 1


def stroke_rows(batch: pa.RecordBatch) -> np.ndarray:
    """Places looked at, about: the rows of each segment times their widths."""
    size, xs, ys = _points(batch)
    reach = 2 * int(batch.column("reach")[0].as_py()) + 3 if batch.num_rows else 0
    return size * (_span(size, ys) + reach) * (reach + 2) + _span(size, xs) * size * reach


def stroke_runs(batch: pa.RecordBatch) -> Runs:
    """Pixels within ``half`` of a polyline."""
    size, x1, y1 = _points(batch)
    if not len(x1):
        return (np.empty(0, np.int64),) * 4
    r, reach = float(batch.column("half")[0].as_py()), int(batch.column("reach")[0].as_py())
    own = np.repeat(np.arange(len(size)), size)
    ends = np.cumsum(size)[size > 0] - 1
    after = np.arange(1, len(own) + 1)
    after[ends] = ends
    begin = np.ones(len(own), bool)
    begin[ends] = size[size > 0] == 1  # a lone point is a segment of its own
    seg = np.flatnonzero(begin)
    own, x1, y1, x2, y2 = own[seg], x1[seg], y1[seg], x1[after][seg], y1[after][seg]
    dx, dy = x2 - x1, y2 - y1
    low = np.minimum(y1, y2) - reach
    s, k = _counted(np.maximum(y1, y2) + reach - low + 1)
    y = low[s] + k
    # of the row only what may be near: places beside the line, by as much as half the thickness is along the row
    left, right = np.minimum(x1, x2)[s] - reach, np.maximum(x1, x2)[s] + reach
    steep = np.flatnonzero(dy[s] != 0)
    t = s[steep]
    middle, aside = x1[t] + (y[steep] - y1[t]) * dx[t] / dy[t], r * np.sqrt((dx * dx + dy * dy)[t]) / np.abs(dy[t]) + 1
    left[steep] = np.maximum(left[steep], np.floor(middle - aside).astype(np.int64))
    right[steep] = np.minimum(right[steep], np.ceil(middle + aside).astype(np.int64))
    row, k = _counted(np.maximum(right - left + 1, 0))
    x, y, s = left[row] + k, y[row], s[row]
    length = (dx * dx + dy * dy)[s]
    along = np.divide((x - x1[s]) * dx[s] + (y - y1[s]) * dy[s], length, out=np.zeros(len(s)), where=length != 0)
    along = np.clip(along, 0.0, 1.0)
    ex, ey = x - (x1[s] + along * dx[s]), y - (y1[s] + along * dy[s])
    near = np.flatnonzero(ex * ex + ey * ey <= r * r)
    new = np.ones(len(near), bool)
    new[1:] = (row[near][1:] != row[near][:-1]) | (np.diff(x[near]) > 1)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(near)) - 1 if len(near) else first
    return own[s[near[first]]], y[near[first]], x[near[first]], x[near[last]]


def sort_rows(*columns: np.ndarray) -> tuple[np.ndarray, ...]:
    """Columns of whole numbers, sorted by the first, then the second and so on."""
    if not len(columns[0]):
        return columns
    lows, spans = zip(*[(int(c.min()), int(c.max()) - int(c.min()) + 1) for c in columns], strict=True)
    size = 1
    for s in spans:
        size *= s
    if size >= 2**62:
        order = np.lexsort(columns[::-1])
        return tuple(c[order] for c in columns)
    packed = np.zeros(len(columns[0]), np.int64)
    for c, low, span in zip(columns, lows, spans, strict=True):
        packed *= span
        packed += c - low
    packed.sort()
    out = []
    for low, span in zip(lows[:0:-1], spans[:0:-1], strict=True):
        packed, rest = np.divmod(packed, span)
        out.append(rest + low)
    return (packed + lows[0], *out[::-1])


def unite(own: np.ndarray, y: np.ndarray, left: np.ndarray, right: np.ndarray) -> Runs:
    """Runs without common pixels, sorted."""
    keep = left <= right
    own, y, left, right = sort_rows(own[keep], y[keep], left[keep], right[keep])
    if not len(own):
        return own, y, left, right
    new = np.ones(len(own), bool)
    new[1:] = (own[1:] != own[:-1]) | (y[1:] != y[:-1])
    far = np.cumsum(new) << np.int64(34)  # a row's places are beyond all of the rows before
    reach = np.maximum.accumulate(far + right)
    left = left.copy()
    left[1:] = np.maximum(left[1:], (reach[:-1] - far[1:]) + 1)
    keep = left <= right
    return own[keep], y[keep], left[keep], right[keep]


def changes(batch: pa.RecordBatch, names: list[str]) -> np.ndarray:
    """Number of the key in each row, counted from 0; rows are sorted by key."""
    new = np.zeros(batch.num_rows, bool)
    for c in names:
        v = batch.column(c)
        a, b = v[1:], v[:-1]
        new[1:] |= np.asarray(pc.fill_null(pc.not_equal(a, b), False)) | np.asarray(pc.xor(pc.is_null(a), pc.is_null(b)))
    return np.cumsum(new)


def united_runs(shapes: DataFrame, keep: list[str], columns: list[str], rows_of: Callable[[pa.RecordBatch], np.ndarray], runs_of: Callable[[pa.RecordBatch], Runs]) -> DataFrame:
    """keep, y, left, right: the pixels of all of a key's shapes, each in one run. Shapes with a null among ``columns`` have none."""
    typed = shapes.select(*keep, *columns).dropna(subset=columns)
    # an even spread over tasks whatever keys' types are; a key's shapes are sorted together
    typed = typed.repartition(*keep).sortWithinPartitions(*keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the last key (a row) and its runs so far
        for batch in batches:
            if not batch.num_rows:
                continue
            counts = np.cumsum(np.maximum(rows_of(batch), 1))
            at = 0
            while at < batch.num_rows:
                until = max(at + 1, int(np.searchsorted(counts, (counts[at - 1] if at else 0) + CHUNK, side="right")))
                part = batch.slice(at, until - at)
                at = until
                keys, runs = part.select(keep), runs_of(part)
                if held is not None:
                    keys = pa.Table.from_batches([held[0], keys]).combine_chunks().to_batches()[0]
                    old = held[1]
                    runs = tuple(np.concatenate([a, b + (i == 0)]) for i, (a, b) in enumerate(zip((np.zeros(len(old[0]), np.int64), *old), runs, strict=True)))
                number = changes(keys, keep)
                first = np.flatnonzero(np.diff(number, prepend=-1))
                own, y, left, right = unite(number[runs[0]], *runs[1:])
                cut = int(np.searchsorted(own, number[-1]))
                held = (keys.slice(keys.num_rows - 1, 1), (y[cut:], left[cut:], right[cut:]))
                yield from out(keys, first[own[:cut]], y[:cut], left[:cut], right[:cut])
        if held is not None:
            yield from out(held[0], np.zeros(len(held[1][0]), np.int64), *held[1])

    def out(keys: pa.RecordBatch, place: np.ndarray, y: np.ndarray, left: np.ndarray, right: np.ndarray) -> Iterator[pa.RecordBatch]:
        for i in range(0, len(place), 100_000):
            cut = slice(i, i + 100_000)
            taken = [keys.column(c).take(pa.array(place[cut])) for c in keep]
            yield pa.RecordBatch.from_arrays([*taken, *[pa.array(v[cut].astype(np.int32)) for v in (y, left, right)]], names=[*keep, "y", "left", "right"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in shapes.select(*keep).schema)
    return typed.mapInArrow(run, f"{kinds}, y int, left int, right int")


def pixels(runs: DataFrame) -> DataFrame:
    """A row for each pixel of runs, its place as y and x."""
    keep = [c for c in runs.columns if c not in ("left", "right")]
    return runs.select(*keep, F.explode(F.sequence("left", "right")).alias("x"))
