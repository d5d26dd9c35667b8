"""Raster codecs that need no imaging library: PNG (8 bit grey, RGB, RGBA) and NPY, and image headers."""

from __future__ import annotations

import ast
import struct
import zlib

import numpy as np

_PNG = b"\x89PNG\r\n\x1a\n"


def png_encode(pixels: np.ndarray) -> bytes:
    """uint8 [h, w], [h, w, 3] or [h, w, 4] to a PNG file."""
    pixels = np.ascontiguousarray(pixels, np.uint8)
    h, w = pixels.shape[:2]
    colour = {1: 0, 3: 2, 4: 6}[1 if pixels.ndim == 2 else pixels.shape[2]]
    rows = np.concatenate([np.zeros((h, 1), np.uint8), pixels.reshape(h, -1)], axis=1).tobytes()

    def chunk(kind: bytes, body: bytes) -> bytes:
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    return _PNG + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, colour, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b"")


def png_decode(data: bytes) -> np.ndarray:
    """A PNG of 8 bits a channel, not interlaced, to uint8 [h, w, channels]."""
    at, body, head = 8, b"", None
    while at < len(data):
        n, kind = struct.unpack_from(">I4s", data, at)
        if kind == b"IHDR":
            head = struct.unpack_from(">IIBBBBB", data, at + 8)
        elif kind == b"IDAT":
            body += data[at + 8 : at + 8 + n]
        at += 12 + n
    if data[:8] != _PNG or head is None or head[2] != 8 or head[3] not in (0, 2, 6) or head[6]:
        raise ValueError("not a PNG of 8-bit grey, RGB or RGBA")
    w, h, c = head[0], head[1], {0: 1, 2: 3, 6: 4}[head[3]]
    raw = np.frombuffer(zlib.decompress(body), np.uint8).reshape(h, 1 + w * c)
    out = np.zeros((h, w * c), np.uint8)
    for y in range(h):
        line, above = raw[y, 1:].astype(np.int64), out[y - 1].astype(np.int64) if y else np.zeros(w * c, np.int64)
        kind = raw[y, 0]
        if kind == 0:
            out[y] = line
        elif kind == 2:
            out[y] = line + above
        else:
            got = np.zeros(w * c, np.int64)
            for i in range(w * c):
                left, up, corner = (got[i - c] if i >= c else 0), above[i], (above[i - c] if i >= c else 0)
                if kind == 1:
                    guess = left
                elif kind == 3:
                    guess = (left + up) // 2
                else:
                    p = left + up - corner
                    guess = min((abs(p - left), 0, left), (abs(p - up), 1, up), (abs(p - corner), 2, corner))[2]
                got[i] = (line[i] + guess) & 255
            out[y] = got
    return out.reshape(h, w, c)


def image_size(data: bytes) -> tuple[int, int] | None:
    """Height and width from the header of a PNG or JPEG; null if it is neither."""
    if data[:8] == _PNG and len(data) >= 24:
        w, h = struct.unpack_from(">II", data, 16)
        return h, w
    if data[:2] != b"\xff\xd8":
        return None
    at = 2
    while at + 9 < len(data):
        if data[at] != 0xFF:
            return None
        kind = data[at + 1]
        if 0xC0 <= kind <= 0xCF and kind not in (0xC4, 0xC8, 0xCC):
            h, w = struct.unpack_from(">HH", data, at + 5)
            return h, w
        at += 2 if kind in (0x01, *range(0xD0, 0xD9)) else 2 + struct.unpack_from(">H", data, at + 2)[0]
    return None


def npy_decode(data: bytes) -> np.ndarray:
    """An NPY file of numbers."""
    if data[:6] != b"\x93NUMPY":
        raise ValueError("not an NPY file")
    wide = data[6] >= 2
    n = struct.unpack_from("<I" if wide else "<H", data, 8)[0]
    start = (12 if wide else 10) + n
    head = ast.literal_eval(data[12 if wide else 10 : start].decode("latin1").strip())
    if "O" in head["descr"]:
        raise ValueError("an array of objects")
    return np.frombuffer(data, np.dtype(head["descr"]), offset=start).reshape(head["shape"], order="F" if head["fortran_order"] else "C")


def npy_encode(array: np.ndarray) -> bytes:
    head = repr({"descr": array.dtype.str, "fortran_order": False, "shape": array.shape}).encode()
    head += b" " * (-(10 + len(head) + 1) % 64) + b"\n"
    return b"\x93NUMPY\x01\x00" + struct.pack("<H", len(head)) + head + np.ascontiguousarray(array).tobytes()
