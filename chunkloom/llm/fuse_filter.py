"""Static binary-fuse filters over 64-bit keys (three-wise, 8-bit fingerprints), built and probed with whole-array operations."""

from __future__ import annotations

import numpy as np

U = np.uint64


def _mixed(keys: np.ndarray, seed: int) -> np.ndarray:
    """The keys under one of many bijective mixings."""
    with np.errstate(over="ignore"):
        h = keys + U(seed * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
        for shift, factor in ((33, 0xFF51AFD7ED558CCD), (33, 0xC4CEB9FE1A85EC53)):
            h ^= h >> U(shift)
            h *= U(factor)
        return h ^ (h >> U(33))


def _slots(h: np.ndarray, segment: int, segments: int) -> np.ndarray:
    """Three slots in neighbouring segments for every hash."""
    first = ((h >> U(32)) * U(segments * segment)) >> U(32)
    mask = U(segment - 1)
    second = (first + U(segment)) ^ ((h >> U(18)) & mask)
    third = (first + U(2 * segment)) ^ (h & mask)
    return np.stack([first, second, third]).astype(np.int64)


def _prints(h: np.ndarray) -> np.ndarray:
    return ((h ^ (h >> U(40))) & U(0xFF)).astype(np.uint8)


def build(keys: np.ndarray) -> bytes:
    """Filter of the distinct keys: no false negatives, about one false positive in 256."""
    keys = np.unique(np.asarray(keys, U))
    n = len(keys)
    segment = 1 << max(2, min(18, int(np.log(max(n, 2)) / np.log(3.33) + 2.25)))
    size = int(max(1.125, 0.875 + 0.25 * np.log(1e6) / np.log(max(n, 2))) * n)
    segments = max(1, -(-size // segment) - 2)
    for seed in range(1, 101):
        h = _mixed(keys, seed)
        slots = _slots(h, segment, segments)
        order = _peel(slots, (segments + 2) * segment)
        if order is not None:
            break
        segments += 1 + segments // 20
    else:
        raise ValueError("no arrangement of the keys was found")
    prints, table = _prints(h), np.zeros((segments + 2) * segment, np.uint8)
    for rows, own in reversed(order):
        s = slots[:, rows]
        table[own] = 0
        table[own] = prints[rows] ^ table[s[0]] ^ table[s[1]] ^ table[s[2]]
    return np.array([seed, segment, segments, n], "<i8").tobytes() + table.tobytes()


def _peel(slots: np.ndarray, size: int) -> list | None:
    """Rounds of (keys, slot that holds each alone); None if some keys cannot be freed."""
    n = slots.shape[1]
    degree, holder = np.zeros(size, np.int64), np.zeros(size, np.int64)
    index = np.arange(n)
    for s in slots:
        degree += np.bincount(s, minlength=size)
        np.bitwise_xor.at(holder, s, index)
    order, freed = [], 0
    ready = np.flatnonzero(degree == 1)
    while len(ready):
        rows, at = np.unique(holder[ready], return_index=True)
        order.append((rows, ready[at]))
        freed += len(rows)
        touched = slots[:, rows]
        for s in touched:
            np.subtract.at(degree, s, 1)
            np.bitwise_xor.at(holder, s, rows)
        ready = np.unique(touched)
        ready = ready[degree[ready] == 1]
    return order if freed == n else None


def probe(data: bytes, keys: np.ndarray) -> np.ndarray:
    """True for every key of the filter, and for about one other key in 256."""
    seed, segment, segments, n = np.frombuffer(data, "<i8", 4).tolist()
    if not n:
        return np.zeros(len(keys), bool)
    table = np.frombuffer(data, np.uint8, offset=32)
    h = _mixed(np.asarray(keys, U), seed)
    s = _slots(h, segment, segments)
    return (table[s[0]] ^ table[s[1]] ^ table[s[2]]) == _prints(h)
