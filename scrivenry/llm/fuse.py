"""Static binary-fuse filters over 64-bit keys, built and probed with numpy."""

from __future__ import annotations

import math

import numpy as np

from .textnum import mix

U64 = np.uint64


def _slots(keys: np.ndarray, seed: int, segment: int, segments: int) -> tuple[np.ndarray, np.ndarray]:
    h = mix(keys ^ U64(seed * 0x9E3779B97F4A7C15 % 2**64))
    first = ((h >> U64(32)) * U64(segments * segment) >> U64(32)).astype(np.int64)
    mask = segment - 1
    second = (first + segment) ^ ((h >> U64(18)).astype(np.int64) & mask)
    third = (first + 2 * segment) ^ (h.astype(np.int64) & mask)
    return np.stack([first, second, third]), (mix(h) & U64(0xFFFF)).astype(np.uint16)


def build(keys: np.ndarray) -> bytes:
    """A filter with 16-bit fingerprints: no key of the set is missed, another passes about once in 65,536."""
    keys = np.unique(np.asarray(keys).astype(np.int64)).view(U64)
    n = len(keys)
    segment = 1 << min(18, max(2, math.floor(math.log(max(n, 2)) / math.log(3.33) + 2.25)))
    capacity = math.ceil(n * max(1.125, 0.875 + 0.25 * math.log(1e6) / math.log(max(n, 3)))) + 8
    segments = max(1, math.ceil(capacity / segment) - 2)
    for seed in range(1, 200):
        if seed % 20 == 0:
            segments += 1
        slots, prints = _slots(keys, seed, segment, segments)
        size = (segments + 2) * segment
        degree = np.bincount(slots.ravel(), minlength=size)
        which = np.zeros(size, np.int64)
        for row in slots:
            np.bitwise_xor.at(which, row, np.arange(n))
        order, alone = [], np.flatnonzero(degree == 1)
        while len(alone):
            own, at = np.unique(which[alone], return_index=True)
            order.append((own, alone[at]))
            for row in slots[:, own]:
                np.subtract.at(degree, row, 1)
                np.bitwise_xor.at(which, row, own)
            alone = np.unique(slots[:, own])
            alone = alone[degree[alone] == 1]
        if sum(len(x) for x, _ in order) == n:
            break
    else:
        raise RuntimeError("no filter found")
    table = np.zeros(size, np.uint16)
    for own, at in reversed(order):
        a, b, c = table[slots[0, own]], table[slots[1, own]], table[slots[2, own]]
        table[at] = prints[own] ^ a ^ b ^ c
    return np.array([seed, segment, segments], "<u4").tobytes() + table.astype("<u2").tobytes()


def contains(blob: bytes, keys: np.ndarray) -> np.ndarray:
    """Which keys may be in the set."""
    seed, segment, segments = np.frombuffer(blob, "<u4", 3).tolist()
    table = np.frombuffer(blob, "<u2", offset=12)
    slots, prints = _slots(np.asarray(keys).astype(np.int64).view(U64), seed, segment, segments)
    return table[slots[0]] ^ table[slots[1]] ^ table[slots[2]] == prints
