"""Word shingles of a text as 64-bit hashes."""

from __future__ import annotations

import numpy as np
import xxhash

WORDS = 5
_UPPER = bytes(range(256)).lower()
_MIX = np.uint64(0x9E3779B97F4A7C15)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads their bits."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingle_set(text: str | None, width: int = WORDS) -> np.ndarray:
    """Sorted distinct hashes (uint64) of the shingles of ``width`` words.

    A-Z are lower-cased; words are runs of anything but space and 0x09-0x0D,
    which is what ``bytes.split`` cuts at in UTF-8. A text with fewer words has
    its whole sequence as the only shingle; one without words has none.
    """
    if not text:
        return np.empty(0, np.uint64)
    words = text.encode("utf-8", "surrogatepass").translate(_UPPER).split()
    if not words:
        return np.empty(0, np.uint64)
    w = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    size = min(width, len(w))
    h = w[: len(w) - size + 1] + np.uint64(size)
    for k in range(1, size):
        h = (h ^ (h >> np.uint64(29))) * _MIX + w[k : len(w) - size + 1 + k]
    return np.unique(mix(h))
