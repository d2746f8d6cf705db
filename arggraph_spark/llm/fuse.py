"""Static binary-fuse filters (three places a key, 8-bit fingerprints), built and probed with whole arrays."""

from __future__ import annotations

import math

import numpy as np

from .common import mix


def _places(h: np.ndarray, segment: int, count: int) -> np.ndarray:
    """The three slots of each hash, in three neighbouring segments."""
    mask = np.uint64(segment - 1)
    first = ((h >> np.uint64(32)) * np.uint64(count * segment)) >> np.uint64(32)
    second = (first + np.uint64(segment)) ^ ((h >> np.uint64(18)) & mask)
    third = (first + np.uint64(2 * segment)) ^ (h & mask)
    return np.stack([first, second, third]).astype(np.int64)


def _prints(h: np.ndarray) -> np.ndarray:
    return (mix(h ^ np.uint64(0x51ED270B7F4A7C15)) & np.uint64(0xFF)).astype(np.uint8)


def build(keys: np.ndarray) -> bytes:
    """The filter of distinct 64-bit ``keys``, as bytes: seed, segment length, segment count, then the slots."""
    keys = np.unique(np.asarray(keys, np.uint64))
    n = max(len(keys), 2)
    segment = min(1 << 18, 1 << max(2, int(math.log(n) / math.log(3.33) + 2.25)))
    factor = max(1.125, 0.875 + 0.25 * math.log(1e6) / math.log(n))
    for attempt in range(100):
        # A small set that can't be peeled gets another seed, then more room.
        count = max(1, math.ceil(n * factor * 1.1 ** (attempt // 4) / segment) - 2)
        slots = (count + 2) * segment
        seed = np.uint64(0x9E3779B97F4A7C15 * (attempt + 1) & (1 << 64) - 1)
        h = mix(keys ^ seed)
        where = _places(h, segment, count)
        held = np.bincount(where.ravel(), minlength=slots)
        names = np.zeros(slots, np.int64)
        for w in where:
            np.bitwise_xor.at(names, w, np.arange(len(keys)))
        rounds, left = [], len(keys)
        while left:
            single = np.flatnonzero(held == 1)
            if not len(single):
                break
            key, at = np.unique(names[single], return_index=True)
            rounds.append((key, single[at]))
            for w in where[:, key]:
                np.subtract.at(held, w, 1)
                np.bitwise_xor.at(names, w, key)
            left -= len(key)
        if left:
            continue
        prints, table = _prints(h), np.zeros(slots, np.uint8)
        for key, slot in reversed(rounds):
            table[slot] = 0
            a, b, c = where[:, key]
            table[slot] = prints[key] ^ table[a] ^ table[b] ^ table[c]
        return np.array([seed, segment, count], np.uint64).tobytes() + table.tobytes()
    raise ValueError("no filter could be built")


def probe(filter_: bytes, keys: np.ndarray) -> np.ndarray:
    """Whether each key may be in the filter; always true for those it was built of."""
    seed, segment, count = np.frombuffer(filter_[:24], np.uint64)
    table = np.frombuffer(filter_, np.uint8, offset=24)
    h = mix(np.asarray(keys, np.uint64) ^ seed)
    a, b, c = _places(h, int(segment), int(count))
    return (_prints(h) ^ table[a] ^ table[b] ^ table[c]) == 0
