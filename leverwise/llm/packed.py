"""Arrays of numbers as short compressed bytes."""

from __future__ import annotations

import numpy as np
import zstandard


def pack(numbers: np.ndarray) -> bytes:
    """Unsigned numbers as compressed planes of bytes, the first byte of all before the second of all."""
    planes = np.ascontiguousarray(numbers).view(np.uint8).reshape(len(numbers), numbers.itemsize).T
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(planes).tobytes())


def unpack(data: bytes, kind: type) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(raw.reshape(width, len(raw) // width).T).reshape(-1).view(kind)
