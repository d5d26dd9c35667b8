"""Words of many texts at once, as 64-bit hashes in NumPy arrays, for use inside tasks."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np

_PRIME = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xD6E8FEB86659FD93)
_POWERS = np.ones(1, np.uint64)
CHUNK = 1_500_000  # bytes of text handled at once


@dataclass
class Words:
    hashes: np.ndarray  # of A-Z-lower-cased words, all rows in order
    first: np.ndarray  # place of each row's first word, and the end
    begin: np.ndarray  # byte at which a word begins, in its row
    end: np.ndarray

    def rows(self) -> np.ndarray:
        """Row of each word."""
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * _MIX
    h = (h ^ (h >> np.uint64(29))) * _MIX
    return h ^ (h >> np.uint64(32))


def _powers(n: int) -> np.ndarray:
    global _POWERS
    if len(_POWERS) < n:
        _POWERS = np.cumprod(np.r_[np.ones(1, np.uint64), np.full(max(n, 256) - 1, _PRIME)])
    return _POWERS[:n]


def words(texts: Sequence[str | None]) -> Words:
    """Words are runs of bytes other than space and 9 to 13; a null text has none."""
    raw = [(t or "").encode("utf-8", "replace") for t in texts]
    joined = np.frombuffer(b" ".join(raw) + b" ", dtype=np.uint8)
    starts = np.cumsum([0, *[len(x) + 1 for x in raw]])
    inside = ~((joined == 32) | ((joined >= 9) & (joined <= 13)))
    edge = np.diff(inside.astype(np.int8), prepend=0)
    begin, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    first = np.searchsorted(begin, starts)
    if not len(begin):
        return Words(np.zeros(0, np.uint64), first, begin, end)
    length = end - begin
    letters = joined[inside].astype(np.uint64)
    letters += np.uint64(32) * ((letters >= 65) & (letters <= 90)).astype(np.uint64)
    at = np.cumsum(length) - length
    place = np.arange(len(letters)) - np.repeat(at, length)
    h = np.add.reduceat((letters + np.uint64(1)) * _powers(int(length.max()))[place], at)
    base = np.repeat(starts[:-1], np.diff(first))
    return Words(mix(h + length.astype(np.uint64)), first, begin - base, end - base)


def chunks(texts: Sequence[str | None], size: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Ranges of rows that hold about ``size`` characters, or one longer text."""
    at = 0
    while at < len(texts):
        stop, n = at, 0
        while stop < len(texts) and (stop == at or n + len(texts[stop] or "") <= size):
            n += len(texts[stop] or "")
            stop += 1
        yield at, stop
        at = stop


def runs(w: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each run of ``n`` words within a row, and the place of its first word."""
    if len(w.hashes) < n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    m = len(w.hashes) - n + 1
    h = w.hashes[:m].copy()
    for j in range(1, n):
        h = h * _PRIME + w.hashes[j : j + m]
    rows = w.rows()
    at = np.flatnonzero(rows[:m] == rows[n - 1 :])
    return mix(h[at]), at


def windows(w: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """As ``runs``, for long ones: hashes of runs of powers of two are put together."""
    m = len(w.hashes) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    power, length, out, done = w.hashes, 1, np.zeros(m, np.uint64), 0
    while True:
        if n & length:
            out = mix(out * _PRIME + power[done : done + m])
            done += length
        if done == n:
            break
        power = mix(power[:-length] * _PRIME + power[length:])
        length *= 2
    rows = w.rows()
    at = np.flatnonzero(rows[:m] == rows[n - 1 :])
    return out[at], at


def shingle_sets(texts: Sequence[str | None], n: int) -> list[np.ndarray]:
    """Each text's distinct shingle hashes, ascending; fewer than ``n`` words make one shingle, none none."""
    out: list[np.ndarray] = []
    for lo, hi in chunks(texts):
        w = words(texts[lo:hi])
        h, at = runs(w, n)
        rows = np.searchsorted(w.first, at, side="right") - 1
        short = [r for r in range(hi - lo) if 0 < w.first[r + 1] - w.first[r] < n]
        if short:
            value = []
            for r in short:
                x = np.uint64(w.first[r + 1] - w.first[r])
                for y in w.hashes[w.first[r] : w.first[r + 1]]:
                    x = mix(np.array([x], np.uint64) * _PRIME + y)[0]
                value.append(x)
            h, rows = np.r_[h, np.array(value, np.uint64)], np.r_[rows, np.array(short, np.int64)]
        order = np.lexsort((h, rows))
        h, rows = h[order], rows[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (rows[1:] != rows[:-1])
        h, rows = h[new], rows[new]
        out += np.split(h, np.searchsorted(rows, np.arange(1, hi - lo)))
    return out
