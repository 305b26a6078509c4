"""Packed key lists that travel between blocks and buckets.

A block sends each bucket one row with its distinct 64-bit keys of that bucket, sorted and as differences in byte planes;
the bucket, which sees the keys of all blocks, answers with one row per block. A key that a third of all rows hold is
one entry per block, so no bucket grows with the copies of a key.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np


@lru_cache(4)
def _edges(buckets: int) -> np.ndarray:
    return np.array((np.arange(buckets, dtype=object) * (1 << 64)) // buckets, dtype=np.uint64)


def bucket_bounds(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Positions that split sorted keys into the buckets, which are equal ranges of the key space."""
    return np.append(np.searchsorted(keys, _edges(buckets)), len(keys))


def encode(keys: np.ndarray, shift: int = 0) -> bytes:
    """Sorted distinct keys without their lowest `shift` bits: byte planes of the differences."""
    if not len(keys):
        return b""
    gaps = np.diff(keys >> np.uint64(shift), prepend=np.uint64(0))
    first, rest = int(gaps[0]), gaps[1:]
    width = max(1, (int(rest.max()).bit_length() + 7) // 8) if len(rest) else 1
    planes = rest.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T
    return first.to_bytes(8, "little") + bytes([width]) + planes.tobytes()


def decode(data) -> np.ndarray:
    data = bytes(data)
    if not data:
        return np.zeros(0, dtype=np.uint64)
    width = data[8]
    planes = np.frombuffer(data, dtype=np.uint8, offset=9).reshape(width, -1)
    gaps = np.zeros((planes.shape[1], 8), dtype=np.uint8)
    gaps[:, :width] = planes.T
    return np.cumsum(np.append(np.frombuffer(data[:8], dtype="<u8"), gaps.reshape(-1).view("<u8")), dtype=np.uint64)
