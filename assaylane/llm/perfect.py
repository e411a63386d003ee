"""Minimal perfect hashing of 64-bit keys, in arrays: n keys get the slots 0 to n - 1, and strangers are told by the stored key."""

from __future__ import annotations

import pickle

import numpy as np

from .grams import mix64

#: Places for each key that is left, in a level of bits.
SPREAD = 1.5


class PerfectHash:
    """Levels of bits: a key's slot is the rank of its bit in the first level where no other key fell on its place.

    Keys that meet on a place go on to the next level. The key of each slot is stored, so that a key that was not there when the
    table was built is found out by comparison.
    """

    def __init__(self, keys: np.ndarray) -> None:
        keys = np.asarray(keys).astype(np.uint64)
        self.levels: list[tuple[int, np.ndarray, np.ndarray, int]] = []
        self.keys = np.zeros(len(keys), np.uint64)
        rest, base = keys, 0
        while len(rest):
            places = -(-max(64, int(len(rest) * SPREAD)) // 64) * 64
            at = self._place(rest, len(self.levels), places)
            alone = np.bincount(at, minlength=places) == 1
            words = np.packbits(alone, bitorder="little").view("<u8")
            before = np.concatenate([[0], np.bitwise_count(words).cumsum(dtype=np.int64)[:-1]])
            self.levels.append((places, words, before, base))
            mine = alone[at]
            self.keys[self._rank(words, before, at[mine]) + base] = rest[mine]
            base += int(mine.sum())
            rest = rest[~mine]
            if len(self.levels) > 200:
                raise ValueError("keys must be different")

    @staticmethod
    def _place(keys: np.ndarray, level: int, places: int) -> np.ndarray:
        salt = np.uint64((level + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
        return (mix64(keys ^ salt) % np.uint64(places)).astype(np.int64)

    @staticmethod
    def _rank(words: np.ndarray, before: np.ndarray, at: np.ndarray) -> np.ndarray:
        below = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return before[at >> 6] + np.bitwise_count(words[at >> 6] & below)

    def __len__(self) -> int:
        return len(self.keys)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each key, or -1 for a key that is not in the table."""
        out = np.full(len(keys), -1, np.int64)
        if not len(self.keys):
            return out
        left = np.arange(len(keys))
        for level, (places, words, before, base) in enumerate(self.levels):
            at = self._place(keys[left], level, places)
            hit = words[at >> 6] >> (at & 63).astype(np.uint64) & np.uint64(1) == 1
            found, at = left[hit], at[hit]
            slot = self._rank(words, before, at) + base
            out[found] = np.where(self.keys[slot] == keys[found], slot, -1)
            left = left[~hit]
            if not len(left):
                break
        return out

    def to_bytes(self) -> bytes:
        return pickle.dumps((self.levels, self.keys))

    @classmethod
    def from_bytes(cls, data: bytes) -> PerfectHash:
        out = cls.__new__(cls)
        out.levels, out.keys = pickle.loads(data)
        return out
