"""Minimal perfect hash over integer keys (hash, displace and compress).

Keys fall into buckets by one hash; buckets are placed largest first, each with
the smallest displacement that sends its keys to free slots. n keys fill exactly
n slots, so a lookup is two hashes, one displacement and one fingerprint.
"""

from __future__ import annotations

import numpy as np

PER_BUCKET = 4


def mix(x: np.ndarray, seed) -> np.ndarray:
    """64-bit finaliser with a seed; seed may be an array."""
    with np.errstate(over="ignore"):
        x = x.astype(np.uint64) + (np.asarray(seed).astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def build(keys: np.ndarray) -> np.ndarray:
    """Displacement of each bucket for distinct 64-bit keys."""
    n = len(keys)
    m = max(1, -(-n // PER_BUCKET))
    bucket = (mix(keys, 0) % np.uint64(m)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    sizes = np.bincount(bucket, minlength=m)
    starts = np.cumsum(sizes) - sizes
    taken = np.zeros(n, bool)
    shift = np.zeros(m, np.uint32)
    tries = np.arange(1, 257)
    for b in np.argsort(-sizes, kind="stable"):
        if not sizes[b]:
            break
        own = keys[order[starts[b] : starts[b] + sizes[b]]]
        first = 1
        while True:
            seeds = first - 1 + tries
            slots = (mix(own[None, :], seeds[:, None]) % np.uint64(n)).astype(np.int64)
            good = ~taken[slots].any(axis=1)
            if sizes[b] > 1:
                s = np.sort(slots, axis=1)
                good &= (s[:, 1:] != s[:, :-1]).all(axis=1)
            if good.any():
                i = int(np.argmax(good))
                shift[b] = seeds[i]
                taken[slots[i]] = True
                break
            first += 256
    return shift


def slots(keys: np.ndarray, shift: np.ndarray, n: int) -> np.ndarray:
    """Slot of each key; of a key that was not built in, any slot."""
    bucket = (mix(keys, 0) % np.uint64(len(shift))).astype(np.int64)
    return (mix(keys, shift[bucket]) % np.uint64(max(1, n))).astype(np.int64)


def fingerprints(keys: np.ndarray) -> np.ndarray:
    return (mix(keys, 2**32) >> np.uint64(32)).astype(np.uint32)
