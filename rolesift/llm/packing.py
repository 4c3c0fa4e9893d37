"""Arrays of integers as bytes that compress: one plane per byte, empty planes left out."""

from __future__ import annotations

import numpy as np


def pack(values: np.ndarray) -> bytes:
    """Non-negative integers; the planes of low bytes first, so the high ones compress away."""
    planes = np.ascontiguousarray(values, dtype="<u8").view(np.uint8).reshape(-1, 8).T
    used = int(np.flatnonzero(planes.any(axis=1)).max(initial=0)) + 1
    return bytes([used]) + np.ascontiguousarray(planes[:used]).tobytes()


def unpack(data: bytes) -> np.ndarray:
    used = data[0]
    planes = np.frombuffer(data, dtype=np.uint8, offset=1).reshape(used, -1)
    out = np.zeros((planes.shape[1], 8), dtype=np.uint8)
    out[:, :used] = planes.T
    return out.reshape(-1).view("<u8")


def pack_sorted(values: np.ndarray) -> bytes:
    """Ascending integers, as their differences."""
    values = np.asarray(values, dtype=np.uint64)
    return pack(np.diff(values, prepend=np.zeros(1, dtype=np.uint64)))


def unpack_sorted(data: bytes) -> np.ndarray:
    return np.cumsum(unpack(data), dtype=np.uint64)
