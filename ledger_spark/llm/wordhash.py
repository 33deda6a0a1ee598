"""Vectorised word splitting and hashing over the bytes of many texts at once.

A span's hash takes its bytes eight at a time: each lane is mixed into the state by a bijection, so that spans of one
length of up to eight bytes never collide and longer ones do by chance only. Two seeds give 128 bits where a wrong match
would matter.
"""

from __future__ import annotations

import numpy as np

SEEDS = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
_KEPT = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)  # the bytes of a lane that belong to the span


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def span_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = SEEDS[0]) -> np.ndarray:
    """A 64-bit hash of values[start:end] for each span, over the bytes of the values."""
    values = np.ascontiguousarray(values)
    raw = np.concatenate((values.view(np.uint8), np.zeros(8, np.uint8)))
    lanes = np.ndarray(len(raw) - 7, "<u8", raw, strides=(1,))  # the eight bytes from every place on
    at, left = np.asarray(starts, np.int64) * values.itemsize, (np.asarray(ends, np.int64) - starts) * values.itemsize
    out = mix(left.astype(np.uint64) + np.uint64(seed))
    live = np.flatnonzero(left > 0)
    at, left = at[live], left[live]
    while len(live):
        out[live] = mix(out[live] * np.uint64(seed) + (lanes[at] & _KEPT[np.minimum(left, 8)]))
        more = left > 8
        live, at, left = live[more], at[more] + 8, left[more] - 8
    return out


def words(data: np.ndarray, offsets: np.ndarray, separator: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every run of non-separator bytes, and for each text the index of its first word (n + 1)."""
    inside = ~separator[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before = np.concatenate(([False], inside[:-1])) if len(data) else inside
    after = np.concatenate((inside[1:], [False])) if len(data) else inside
    starts = np.flatnonzero(inside & (~before | edge[:-1]))
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def lowered(data: np.ndarray) -> np.ndarray:
    """A-Z in lower case, every other byte as it is."""
    return np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8)


def run_hashes(hashes: np.ndarray, width: int) -> np.ndarray:
    """Hash of every `width` consecutive entries (len - width + 1 of them)."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = mix(hashes[:n] + np.uint64(width))
    for k in range(1, width):
        out = mix(out * np.uint64(0x9FB21C651E98DF25) + hashes[k : k + n])
    return out
