"""Vectorised 64-bit hashes of byte ranges, and a growing index from hash to row."""

from __future__ import annotations

import numpy as np

_B = 0x9E3779B97F4A7C55 | 1
_B_INV = pow(_B, -1, 1 << 64)
_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS[0]) < n:
        for k, base in enumerate((_B, _B_INV)):
            steps = np.full(1 << (n - 1).bit_length(), base, np.uint64)
            steps[0] = 1
            _POWERS[k] = np.cumprod(steps, dtype=np.uint64)
    return _POWERS[0][:n], _POWERS[1][:n]


#: Bytes of data whose running sums and powers are held at a time (a longer range is one of its own).
CHUNK = 1 << 19


def range_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of each ``data[start:end]`` (bytes), by content and length alone; starts must not fall."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    if len(data) > CHUNK:
        part = starts // CHUNK
        cut = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1], [True])))
        if len(cut) > 2:
            return np.concatenate([range_hashes(data[starts[a] : ends[a:b].max()], starts[a:b] - starts[a], ends[a:b] - starts[a]) for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)])
    up, down = _powers(len(data))
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up, dtype=np.uint64)))
    return mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


class HashIndex:
    """Open addressing over numpy arrays: many look-ups or insertions at a time."""

    def __init__(self, bits: int = 16):
        self._room(bits)
        self.n = 0

    def _room(self, bits: int) -> None:
        self.mask = (1 << bits) - 1
        self.keys, self.rows = np.zeros(1 << bits, np.uint64), np.zeros(1 << bits, np.int32)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The row of each key, -1 if it has none."""
        keys = np.maximum(keys, np.uint64(1))
        out = np.full(len(keys), -1, np.int32)
        left = np.arange(len(keys))
        slot = (keys & np.uint64(self.mask)).astype(np.int64)
        while len(left):
            there = self.keys[slot]
            hit = there == keys[left]
            out[left[hit]] = self.rows[slot[hit]]
            go = ~hit & (there != 0)
            left, slot = left[go], (slot[go] + 1) & self.mask
        return out

    def add(self, keys: np.ndarray, rows: np.ndarray) -> None:
        """New keys, each once."""
        if 1.5 * (self.n + len(keys)) > self.mask:
            full = self.keys != 0
            old = self.keys[full], self.rows[full]
            self._room((2 * (self.n + len(keys))).bit_length())
            self.n = 0
            self.add(*old)
        self.n += len(keys)
        keys = np.maximum(keys, np.uint64(1))
        slot = (keys & np.uint64(self.mask)).astype(np.int64)
        while len(keys):
            free = np.flatnonzero(self.keys[slot] == 0)
            _, first = np.unique(slot[free], return_index=True)
            put = free[first]
            self.keys[slot[put]], self.rows[slot[put]] = keys[put], rows[put]
            rest = np.ones(len(keys), bool)
            rest[put] = False
            keys, rows, slot = keys[rest], rows[rest], (slot[rest] + 1) & self.mask
