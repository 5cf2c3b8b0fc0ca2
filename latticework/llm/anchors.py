"""Anchors: positions chosen by content such that equal strings of a given length have equal anchors inside."""

from __future__ import annotations

import numpy as np

from latticework.llm.common import U64

GRAM = 16  # bytes of an anchor
ONE, TWO, THREE = U64(0x9E3779B97F4A7C15), U64(0xC2B2AE3D27D4EB4F), U64(0xD6E8FEB86659FD93)
HIGH, LOW = U64(0xFFFFFFFF00000000), U64(0xFFFFFFFF)


def eights(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each position as one number; zeros follow the end."""
    n = len(data)
    padded = np.zeros(-(-n // 8) * 8 + 16, np.uint8)
    padded[:n] = data
    out = np.empty(-(-n // 8) * 8, U64)
    for r in range(8):
        out[r::8] = padded[r : r + len(out)].view(U64)[: len(out[r::8])]
    return out[:n]


def anchors(data: np.ndarray, at: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For all windows of `window` bytes inside the texts, in runs that share an anchor: its hash, its place, the run's
    first window, its number of windows, its text. A window's anchor is the leftmost of its GRAM-byte strings with the least hash.
    """
    none = np.zeros(0, np.int64)
    size = np.diff(at)
    count = np.maximum(0, size - window + 1)
    if not count.any():
        return np.zeros(0, U64), none, none, none, none
    e = eights(data)
    h = np.zeros(len(data), U64)
    np.add(e[:-8] * ONE, e[8:] * TWO, out=h[:-8]) if len(data) > 8 else None
    h ^= h >> U64(32)
    h *= THREE
    h ^= h >> U64(29)
    least = (h & HIGH) | np.arange(len(h), dtype=U64)
    width, wanted = 1, window - GRAM + 1
    while width < wanted:
        step = min(width, wanted - width)
        least = np.minimum(least[:-step], least[step:])
        width += step
    owner = np.repeat(np.arange(len(size)), count)
    start = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count) + at[owner]
    place = (least[start] & LOW).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], (place[1:] != place[:-1]) | (owner[1:] != owner[:-1])]))
    return h[place[first]], place[first], start[first], np.diff(np.append(first, len(start))), owner[first]
