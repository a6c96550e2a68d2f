"""Hashes of many byte strings of one buffer, by prefix sums of a polynomial modulo 2^64."""

from __future__ import annotations

import numpy as np

CHUNK = 1 << 18
_ROOM = 1 << 14
#: Two odd multipliers for two independent hashes.
MULTIPLIERS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_POWERS: dict[int, np.ndarray] = {}


def powers(multiplier: int) -> np.ndarray:
    if multiplier not in _POWERS:
        p = np.full(CHUNK + _ROOM + 1, multiplier, np.uint64)
        p[0] = 1
        _POWERS[multiplier] = np.multiply.accumulate(p)
    return _POWERS[multiplier]


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(32))


def prefix(segment: np.ndarray, multiplier: int) -> np.ndarray:
    sums = np.zeros(len(segment) + 1, np.uint64)
    np.cumsum((segment.astype(np.uint64) + np.uint64(1)) * powers(multiplier)[: len(segment)], out=sums[1:])
    return sums


def between(sums: np.ndarray, start: np.ndarray, end: np.ndarray, multiplier: int) -> np.ndarray:
    """Hashes of segment[start:end]; equal strings give equal hashes wherever they stand."""
    p = powers(multiplier)
    return mix((sums[end] - sums[start]) * p[len(p) - 1 - start] + (end - start).astype(np.uint64))


def span_hashes(buffer: np.ndarray, start: np.ndarray, end: np.ndarray, multiplier: int = MULTIPLIERS[0]) -> np.ndarray:
    """Hashes of buffer[start:end] for spans shorter than 16 KB, with memory for one chunk at a time."""
    out = np.zeros(len(start), np.uint64)
    if len(start) > 1 and (np.diff(start) < 0).any():
        order = np.argsort(start, kind="stable")
        out[order] = span_hashes(buffer, start[order], end[order], multiplier)
        return out
    i = 0
    while i < len(start):
        x = int(start[i])
        j = int(np.searchsorted(start, x + CHUNK))
        sums = prefix(buffer[x : x + CHUNK + _ROOM], multiplier)
        out[i:j] = between(sums, start[i:j] - x, end[i:j] - x, multiplier)
        i = j
    return out


def sliding_minimum(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each window of ``width`` values, from running minima of blocks."""
    n = len(values) - width + 1
    room = -(-len(values) // width) * width
    padded = np.full(room, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(values)] = values
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])
