"""Numeric arrays as compressed bytes, so that they shuffle and store compactly."""

from __future__ import annotations

import numpy as np
import zstandard

_LEVEL = 1


def pack_sorted(values: np.ndarray) -> bytes:
    """Ascending unsigned 64-bit numbers: differences, split into byte planes, compressed."""
    delta = np.diff(values.astype(np.uint64), prepend=np.uint64(0))
    return zstandard.compress(np.ascontiguousarray(delta.view(np.uint8).reshape(-1, 8).T).tobytes(), _LEVEL)


def unpack_sorted(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(data), np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view(np.uint64).ravel(), dtype=np.uint64)


def pack_counts(values: np.ndarray) -> bytes:
    """Non-negative 32-bit numbers, most of them small."""
    planes = np.ascontiguousarray(values.astype(np.uint32).view(np.uint8).reshape(-1, 4).T)
    return zstandard.compress(planes.tobytes(), _LEVEL)


def unpack_counts(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(data), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view(np.uint32).ravel()


def pack_floats(values: np.ndarray) -> bytes:
    return zstandard.compress(values.astype(np.float32).tobytes(), _LEVEL)


def unpack_floats(data: bytes) -> np.ndarray:
    return np.frombuffer(zstandard.decompress(data), np.float32)


def pack_text(text: str) -> bytes:
    return zstandard.compress(text.encode("utf-8", "surrogatepass"), _LEVEL)


def unpack_text(data: bytes) -> str:
    return zstandard.decompress(data).decode("utf-8", "surrogatepass")
