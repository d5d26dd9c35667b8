"""Elias-Fano sequences and a two-level n-gram trie on them, laid out in one block of bytes.

A block is written to a file and mapped, or read from a binary column; either way it is read in place: all arrays
are views of its bytes, and high bits stay in unary, with a directory of one count for each 64 bits for select.
"""

from __future__ import annotations

import struct

import numpy as np

#: Probabilities are kept as codes of so many decades each, rounded down; 0: less than the last code's.
STEP = 0.04
#: Probability that each code stands for: 255 is 1, 254 10^-0.04, and so on.
CODEBOOK = np.append(0.0, 10.0 ** (-STEP * np.arange(254, -1, -1)))

_ONES = np.array([bin(b).count("1") for b in range(256)], np.uint8)
#: Place of the k-th one of each byte, from the highest bit.
_PLACE = np.array([([i for i in range(8) if b >> (7 - i) & 1] + [0] * 8)[:8] for b in range(256)], np.uint8)
_AT_ONCE = 1 << 18  # queries, so that temporaries stay small


def quantise(p: np.ndarray) -> np.ndarray:
    """8-bit codes of probabilities, rounded down."""
    with np.errstate(divide="ignore"):
        code = 255 + np.floor(np.log10(np.asarray(p, np.float64)) / STEP + 1e-9)
    return np.clip(code, 0, 255).astype(np.uint8)


def _select(raw: np.ndarray, before: np.ndarray, i: np.ndarray, flip: int) -> np.ndarray:
    """Place of the i-th one (flip 0) or zero (flip 255) of bits; before: how many there are before each 8 bytes."""
    out = np.empty(len(i), np.int64)
    for lo in range(0, len(i), _AT_ONCE):
        q = i[lo : lo + _AT_ONCE]
        word = np.searchsorted(before, q, side="right") - 1
        rest = (q - before[word])[:, None]
        eight = raw[word] ^ np.uint8(flip)
        upto = np.cumsum(_ONES[eight], axis=1, dtype=np.uint8)
        byte = np.minimum((upto <= rest).sum(axis=1), 7)
        at = np.arange(len(q))
        rest = rest[:, 0] - np.where(byte > 0, upto[at, byte - 1], 0)
        out[lo : lo + _AT_ONCE] = 64 * word + 8 * byte + _PLACE[eight[at, byte], rest]
    return out


def encode(values: np.ndarray, universe: int) -> bytes:
    """A non-decreasing sequence below ``universe``: low bits in an array, high bits in unary, ones before each 64 bits."""
    n = len(values)
    low_bits = max(0, (max(1, universe // max(1, n))).bit_length() - 1)
    kind = next(k for k in (0, 1, 2, 4, 8) if 8 * k >= low_bits)
    values = values.astype(np.uint64)
    low = (values & np.uint64((1 << low_bits) - 1)).astype(f"<u{kind}").tobytes() if kind else b""
    high = (values >> np.uint64(low_bits)).astype(np.int64)
    bits = np.zeros(-(-(n + int(high[-1] if n else 0) + 1) // 64) * 64, np.uint8)
    bits[high + np.arange(n)] = 1
    before = np.cumsum(np.append(0, bits.reshape(-1, 64).sum(axis=1)))[:-1].astype("<u4").tobytes()
    head = struct.pack("<QQQQ", n, low_bits, len(low), len(bits) // 8)
    return head + low + b"\0" * (-len(low) % 8) + np.packbits(bits).tobytes() + before + b"\0" * (-len(before) % 8)


class EliasFano:
    """A sequence read in place."""

    def __init__(self, block: memoryview | bytes, at: int = 0) -> None:
        self.n, self.low_bits, n_low, n_unary = struct.unpack_from("<QQQQ", block, at)
        at += 32
        kind = n_low // self.n if self.n else 0
        self._low = np.frombuffer(block, f"<u{kind}", self.n, at) if kind else None
        at += n_low + -n_low % 8
        self._raw = np.frombuffer(block, np.uint8, n_unary, at).reshape(-1, 8)
        at += n_unary
        self._ones = np.frombuffer(block, "<u4", n_unary // 8, at)
        self._zeros = 64 * np.arange(n_unary // 8) - self._ones
        self.stop = at + n_unary // 2 + -(n_unary // 2) % 8

    def _lows(self, i: np.ndarray) -> np.ndarray:
        return self._low[i].astype(np.uint64) if self._low is not None else np.zeros(len(i), np.uint64)

    def __getitem__(self, i: np.ndarray) -> np.ndarray:
        high = _select(self._raw, self._ones, i, 0) - i
        return (high.astype(np.uint64) << np.uint64(self.low_bits)) | self._lows(i)

    def _first(self, top: np.ndarray) -> np.ndarray:
        """Place of the first value whose high part is ``top`` or more."""
        out = np.zeros(len(top), np.int64)
        n_zeros = 64 * len(self._raw) - self.n
        some, beyond = top > 0, top > n_zeros
        k = np.flatnonzero(some & ~beyond)
        out[k] = np.minimum(self.n, _select(self._raw, self._zeros, top[k] - 1, 255) - (top[k] - 1))
        out[beyond] = self.n
        return out

    def successor(self, x: np.ndarray) -> np.ndarray:
        """Place of the first value at or above each x; n if there is none."""
        x = x.astype(np.uint64)
        top = (x >> np.uint64(self.low_bits)).astype(np.int64)
        low = x & np.uint64((1 << self.low_bits) - 1)
        lo, hi = self._first(top), self._first(top + 1)
        todo = np.flatnonzero(lo < hi)
        while len(todo):
            mid = (lo[todo] + hi[todo]) // 2
            less = self._lows(mid) < low[todo]
            lo[todo[less]] = mid[less] + 1
            hi[todo[~less]] = mid[~less]
            todo = todo[lo[todo] < hi[todo]]
        return lo


def build_trie(contexts: np.ndarray, followers: np.ndarray, probabilities: np.ndarray, backoff: np.ndarray) -> bytes:
    """A block for bigrams (context hash, follower hash, smoothed probability), sorted by context, then follower, all different.

    Levels: the contexts with their back-off weights, and the follower vocabulary, as sorted hashes; monotone pointers
    from each context to its followers; followers as context-relative values (rank in the vocabulary plus the context's
    number times the vocabulary's size, which makes the level monotone); quantised probabilities. ``backoff``: a weight
    for each context, in order.
    """
    heads, at = np.unique(contexts, return_index=True)
    vocabulary, rank = np.unique(followers, return_inverse=True)
    number = np.searchsorted(heads, contexts)
    pointers = np.append(at, len(contexts))
    level = number.astype(np.uint64) * np.uint64(len(vocabulary)) + rank.astype(np.uint64)
    weights = np.asarray(backoff, "<f4").tobytes()
    head = struct.pack("<QQQQ", len(heads), len(vocabulary), len(contexts), len(weights))
    return b"".join([head, heads.astype("<u8").tobytes(), vocabulary.astype("<u8").tobytes(), encode(pointers, len(contexts) + 1), encode(level, len(heads) * len(vocabulary)), weights, quantise(probabilities).tobytes()])


class Trie:
    """A block read in place."""

    def __init__(self, block: memoryview | bytes) -> None:
        n_heads, n_vocabulary, n_codes, n_weights = struct.unpack_from("<QQQQ", block, 0)
        self.heads = np.frombuffer(block, "<u8", n_heads, 32)
        self.vocabulary = np.frombuffer(block, "<u8", n_vocabulary, 32 + 8 * n_heads)
        self.pointers = EliasFano(block, 32 + 8 * (n_heads + n_vocabulary))
        self.level = EliasFano(block, self.pointers.stop)
        self.backoff = np.frombuffer(block, "<f4", n_heads, self.level.stop)
        self.codes = np.frombuffer(block, np.uint8, n_codes, self.level.stop + n_weights)

    def lookup(self, contexts: np.ndarray, followers: np.ndarray) -> np.ndarray:
        """Codes of bigrams' probabilities, 0 for those that the trie lacks."""
        out = np.zeros(len(contexts), np.uint8)
        if not len(self.heads):
            return out
        number = np.minimum(np.searchsorted(self.heads, contexts), len(self.heads) - 1)
        rank = np.minimum(np.searchsorted(self.vocabulary, followers), len(self.vocabulary) - 1)
        known = np.flatnonzero((self.heads[number] == contexts) & (self.vocabulary[rank] == followers))
        wanted = number[known].astype(np.uint64) * np.uint64(len(self.vocabulary)) + rank[known].astype(np.uint64)
        place = self.level.successor(wanted)
        stop = self.pointers[number[known] + 1].astype(np.int64)
        hit = place < stop
        hit[hit] = self.level[place[hit]] == wanted[hit]
        out[known[hit]] = self.codes[place[hit]]
        return out
