"""Arrays packed into one compressed binary value, to travel through a shuffle as few bytes."""

from __future__ import annotations

import struct

import numpy as np
import zstandard

LEVEL = 3


def packed(*arrays: np.ndarray) -> bytes:
    """Arrays of fixed-width values; bytes of equal rank lie together, so that small values and steps compress."""
    parts = [struct.pack("<B", len(arrays))]
    for one in arrays:
        width = one.dtype.itemsize
        parts.append(struct.pack("<ccQ", one.dtype.kind.encode(), str(width).encode(), len(one)))
        raw = np.ascontiguousarray(one).view(np.uint8)
        parts.append(raw.reshape(len(one), width).T.tobytes() if width > 1 else raw.tobytes())
    return zstandard.ZstdCompressor(level=LEVEL).compress(b"".join(parts))


def unpacked(blob: bytes) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    at, found = 1, []
    for _ in range(raw[0]):
        kind, width, n = struct.unpack_from("<ccQ", raw, at)
        at += struct.calcsize("<ccQ")
        size = int(width)
        body = np.frombuffer(raw, np.uint8, n * size, at)
        found.append(np.ascontiguousarray(body.reshape(size, n).T).view(f"{kind.decode()}{size}").reshape(n))
        at += n * size
    return found


def steps(values: np.ndarray) -> np.ndarray:
    """Differences of a sorted array, the first value kept; np.cumsum undoes it."""
    return np.diff(values, prepend=values.dtype.type(0))
