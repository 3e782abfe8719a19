"""Inflating and undoing of PNG predictors."""

from __future__ import annotations

import zlib

import numpy as np

from .errors import PdfError


def inflate(raw: bytes, limit: int = 1 << 28, skip_checksum: bool = False) -> bytes:
    """The inflated bytes of a zlib stream. A stream that is cut, has no trailer or exceeds ``limit`` is an error; bytes after it are not."""
    if len(raw) < 2 or raw[0] & 15 != 8 or (raw[0] << 8 | raw[1]) % 31 or raw[1] & 32:
        raise PdfError("zlib: bad header")
    d = zlib.decompressobj(-15 if skip_checksum else 15)
    try:
        out = d.decompress(raw[2:] if skip_checksum else raw, limit + 1)
    except zlib.error as e:
        raise PdfError(f"zlib: {e}") from None
    if len(out) > limit:
        raise PdfError("Codec memory limit hit")
    if not d.eof or skip_checksum and len(d.unused_data) < 4:
        raise PdfError("zlib: unexpected end of stream")
    return out


def paeth(a: int, b: int, c: int) -> int:
    """The neighbour nearest to a + b - c; of equal ones left before up before their corner."""
    return min((abs(b - c), 0, a), (abs(a - c), 1, b), (abs(a + b - 2 * c), 2, c))[2]


def unpredict(data: bytes, columns: int, colors: int = 1, bits: int = 8) -> bytes:
    """Rows that each begin with a filter number, as they were before the filters."""
    size, step = (columns * colors * bits + 7) // 8, max(1, colors * bits // 8)
    if not size or len(data) % (size + 1):
        raise PdfError("predictor rows don't fill the stream")
    rows = np.frombuffer(data, np.uint8).reshape(-1, size + 1)
    kinds = rows[:, 0]
    if len(kinds) and kinds.max() > 4:
        raise PdfError("bad predictor filter")
    if (kinds <= 2).all() and (kinds == 2).all():
        return np.cumsum(rows[:, 1:], axis=0, dtype=np.uint8).tobytes()
    out = np.zeros((len(rows) + 1, size), np.uint8)
    for k, row in enumerate(rows, 1):
        f, x, up = int(row[0]), row[1:], out[k - 1]
        if f == 0:
            out[k] = x
        elif f == 1:
            for j in range(step):
                out[k, j::step] = np.cumsum(x[j::step], dtype=np.uint8)
        elif f == 2:
            out[k] = x + up
        else:
            cur, above = [0] * size, up.tolist()
            for j, v in enumerate(x.tolist()):
                left = cur[j - step] if j >= step else 0
                corner = above[j - step] if j >= step else 0
                cur[j] = (v + ((left + above[j]) // 2 if f == 3 else paeth(left, above[j], corner))) & 255
            out[k] = cur
    return out[1:].tobytes()
