"""Static 3-wise binary fuse filters over 64-bit keys, built and probed with numpy.

A filter holds one byte per slot and about 1.13-1.3 slots per key; a probe of a key that is in the
set is always positive, another key's is positive with a chance of 1 in 256.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np

_M1, _M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)


def _mix(keys: np.ndarray, seed: int) -> np.ndarray:
    """The 64-bit murmur finalizer of key + seed."""
    h = keys + np.uint64(seed)
    h ^= h >> np.uint64(33)
    h *= _M1
    h ^= h >> np.uint64(33)
    h *= _M2
    return h ^ (h >> np.uint64(33))


@dataclass(frozen=True)
class FuseFilter:
    seed: int
    segment: int  # slots of a segment, a power of two
    segments: int  # start segments; a key's three slots are in consecutive ones
    slots: np.ndarray  # uint8

    def _places(self, h: np.ndarray) -> list[np.ndarray]:
        start = ((h >> np.uint64(32)) * np.uint64(self.segments)) >> np.uint64(32)
        mask = np.uint64(self.segment - 1)
        return [((start + np.uint64(i)) * np.uint64(self.segment) + ((h >> np.uint64(18 * i)) & mask)).astype(np.int64) for i in range(3)]

    def has(self, keys: np.ndarray) -> np.ndarray:
        """A boolean per key: false only if it is surely not in the set."""
        if not len(self.slots):
            return np.zeros(len(keys), bool)
        h = _mix(np.asarray(keys, np.uint64), self.seed)
        a, b, c = self._places(h)
        return (self.slots[a] ^ self.slots[b] ^ self.slots[c]) == _print_of(h)

    def to_bytes(self) -> bytes:
        return np.array([self.seed, self.segment, self.segments], "<i8").tobytes() + self.slots.tobytes()

    @classmethod
    def from_bytes(cls, data: bytes) -> FuseFilter:
        seed, segment, segments = (int(x) for x in np.frombuffer(data[:24], "<i8"))
        return cls(seed, segment, segments, np.frombuffer(data[24:], np.uint8))


def _print_of(h: np.ndarray) -> np.ndarray:
    return ((h ^ (h >> np.uint64(29))) & np.uint64(255)).astype(np.uint8)


def build(keys: np.ndarray) -> FuseFilter:
    """The filter of a set of keys; repeated keys count once, no keys give an always-false one."""
    keys = np.unique(np.asarray(keys, np.uint64))
    n = len(keys)
    if not n:
        return FuseFilter(0, 1, 1, np.zeros(0, np.uint8))
    segment = 1 << max(2, min(18, int(math.log(n) / math.log(3.33) + 2.25) if n > 1 else 2))
    for seed in range(1, 200):
        room = max(1.125, 0.875 + 0.25 * math.log(1e6) / math.log(max(n, 10))) * (1 + 0.05 * (seed // 8))
        segments = max(1, -(-int(n * room) // segment) - 2)
        shape = FuseFilter(seed, segment, segments, np.zeros((segments + 2) * segment, np.uint8))
        h = _mix(keys, seed)
        if filled := _peel(shape, h):
            return FuseFilter(seed, segment, segments, filled[0])
    raise RuntimeError("no seed peels")


def _peel(shape: FuseFilter, h: np.ndarray) -> tuple[np.ndarray] | None:
    """Peel all slots of one key at once, round by round; fill in the reverse order. Slots that are
    peeled in one round never share a key, so a round is a vector operation."""
    size, n = len(shape.slots), len(h)
    places = np.stack(shape._places(h))
    ids = np.arange(n, dtype=np.int64)
    count = np.bincount(places.ravel(), minlength=size)
    total = np.zeros(size, np.int64)
    for row in places:
        np.add.at(total, row, ids)
    rounds, left = [], n
    lone = np.flatnonzero(count == 1)
    while len(lone):
        key, first = np.unique(total[lone], return_index=True)
        slot = lone[first]
        rounds.append((key, slot))
        left -= len(key)
        touched = places[:, key].ravel()
        np.subtract.at(count, touched, 1)
        np.subtract.at(total, touched, np.tile(key, 3))
        lone = np.unique(touched)
        lone = lone[count[lone] == 1]
    if left:
        return None
    slots, prints = np.zeros(size, np.uint8), _print_of(h)
    for key, slot in reversed(rounds):
        a, b, c = places[:, key]
        slots[slot] = 0
        slots[slot] = prints[key] ^ slots[a] ^ slots[b] ^ slots[c]
    return (slots,)
