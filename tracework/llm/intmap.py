"""A map of integers in two arrays, asked for many keys at a time."""

from __future__ import annotations

import numpy as np

_ODD = np.uint64(0x9E3779B97F4A7C15)


class IntMap:
    """Keys are not negative; values are positive, 0 stands for a key that is not there."""

    def __init__(self, room: int):
        self._bits = max(4, (2 * room - 1).bit_length())  # at most half of the places are taken
        self._keys = np.full(1 << self._bits, -1, np.int64)
        self._values = np.zeros(1 << self._bits, np.int32)
        self._room, self._taken = max(room, 1), 0

    def __len__(self) -> int:
        return self._taken

    def _places(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * _ODD) >> np.uint64(64 - self._bits)).astype(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        at = self._places(keys)
        met = self._keys[at]
        out = self._values[at]
        wrong = np.flatnonzero(met != keys)
        out[wrong] = 0
        wrong = wrong[met[wrong] >= 0]
        while len(wrong):
            at[wrong] = (at[wrong] + 1) & (len(self._keys) - 1)
            met = self._keys[at[wrong]]
            hit = met == keys[wrong]
            out[wrong[hit]] = self._values[at[wrong[hit]]]
            wrong = wrong[~hit & (met >= 0)]
        return out

    def put(self, keys: np.ndarray, values: np.ndarray) -> None:
        """Add keys that are different from each other and not there yet."""
        if self._taken + len(keys) > self._room:
            raise ValueError("more keys than there is room for")
        self._taken += len(keys)
        at = self._places(keys)
        while len(keys):
            free = self._keys[at] < 0
            self._keys[at[free]] = keys[free]
            mine = self._keys[at] == keys
            self._values[at[mine]] = values[mine]
            keys, values, at = keys[~mine], values[~mine], (at[~mine] + 1) & (len(self._keys) - 1)
