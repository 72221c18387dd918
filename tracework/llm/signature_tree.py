"""Signature trees over token sets: dual traversal with an exact overlap bound.

A document's signature is a bitmap of its hashed tokens. A node holds the
OR-combined bitmap of its documents, the range of their set sizes, and the most
tokens that any of them lost to shared bits. Two nodes are opened only if some
pair below them could still reach the similarity.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Bits of the bitmaps in the trees, and of the wider ones by which the pairs that are left are looked at again.
BITS, WIDE_BITS = 512, 2048
FAN = 8
_CHUNK = 100_000


def signature(tokens: np.ndarray, bits: int = BITS) -> bytes:
    """Bitmap of a set of 64-bit tokens."""
    on = np.zeros(bits, np.uint8)
    on[tokens % np.uint64(bits)] = 1
    return np.packbits(on).tobytes()


def folded(wide: np.ndarray) -> np.ndarray:
    """Rows of ``WIDE_BITS`` bits (as uint64 words) as those of ``BITS`` bits: the same as signatures of that many."""
    return np.bitwise_or.reduce(wide.reshape(len(wide), WIDE_BITS // BITS, -1), axis=1)


def may_link(wide: np.ndarray, n: np.ndarray, i: np.ndarray, j: np.ndarray, percent: int) -> np.ndarray:
    """Whether the wide bitmaps leave it open that pairs of rows link."""
    lost = n - np.bitwise_count(wide).sum(axis=1, dtype=np.int64)
    bound = np.bitwise_count(wide[i] & wide[j]).sum(axis=1, dtype=np.int64) + np.minimum(lost[i], lost[j])
    return linked(bound, n[i], n[j], percent)


def as_words(sigs: list[bytes]) -> np.ndarray:
    """Bitmaps as rows of uint64 words."""
    return np.frombuffer(b"".join(sigs), np.uint64).reshape(len(sigs), -1)


def linked(inter, a, b, percent: int):
    """Whether two sets of sizes a and b with ``inter`` common tokens link."""
    return 100 * inter >= percent * (a + b - inter)


def candidate_pairs(
    size: np.ndarray,
    sigs: np.ndarray,
    percent: int,
    group: np.ndarray | None = None,
    tree: np.ndarray | None = None,
) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs (i, j) that the bounds cannot exclude, in chunks.

    ``sigs`` has a row of ``BITS`` bits (as uint64 words) for each set. Every pair of one tree whose Jaccard similarity reaches ``percent`` comes
    out; with ``group``, only pairs of different groups do. All trees are
    traversed together, level by level; without ``tree`` there is one.
    """
    if len(size) < 2:
        return
    tree = np.zeros(len(size), np.int64) if tree is None else tree
    group = np.arange(len(size)) if group is None else group
    order = np.lexsort((size, tree))
    bits = sigs[order]
    n, g, t = size[order].astype(np.int64), group[order], tree[order]
    lost = n - np.bitwise_count(bits).sum(axis=1, dtype=np.int64)
    levels = [(bits, n, n, lost, g, g)]
    children: list[tuple[np.ndarray, np.ndarray]] = []
    while not children or (t[1:] == t[:-1]).any():
        first = np.flatnonzero(np.concatenate([[True], t[1:] != t[:-1]]))
        place = np.arange(len(t)) - np.repeat(first, np.diff(np.append(first, len(t))))
        cut = np.flatnonzero(place % FAN == 0)
        low = levels[-1]
        how = (np.bitwise_or, np.minimum, np.maximum, np.maximum, np.minimum, np.maximum)
        levels.append(tuple(f.reduceat(x, cut, axis=0) for f, x in zip(how, low)))
        children.append((cut, np.diff(np.append(cut, len(t)))))
        t = t[cut]
    roots = np.arange(len(t))
    step = max(1, _CHUNK // FAN**2)
    stack = [(len(children), roots[k : k + step], roots[k : k + step]) for k in range(0, len(roots), step)]
    di, dj = (x.ravel() for x in np.meshgrid(np.arange(FAN), np.arange(FAN), indexing="ij"))
    while stack:
        level, a, b = stack.pop()
        start, count = children[level - 1]
        low_bits, least, most, lost, g_lo, g_hi = levels[level - 1]
        fits = (di < count[a][:, None]) & (dj < count[b][:, None])
        i = (start[a][:, None] + di)[fits]
        j = (start[b][:, None] + dj)[fits]
        keep = (i < j if level == 1 else i <= j) & ~(
            (g_lo[i] == g_hi[i]) & (g_lo[j] == g_hi[j]) & (g_lo[i] == g_lo[j])
        )
        i, j = i[keep], j[keep]
        bound = np.bitwise_count(low_bits[i] & low_bits[j]).sum(axis=1, dtype=np.int64)
        bound += np.minimum(lost[i], lost[j])
        bound = np.minimum(bound, np.minimum(most[i], most[j]))
        keep = linked(bound, least[i], least[j], percent)
        i, j = i[keep], j[keep]
        if level == 1:
            if len(i):
                yield order[i], order[j]
        else:
            stack += [(level - 1, i[k : k + step], j[k : k + step]) for k in range(0, len(i), step)]


class PairTally:
    """Counts of keys in bounded memory: what has come together is given out whenever ``most`` keys differ."""

    def __init__(self, most: int):
        self.most, self.held, self.size = most, [], 0

    def add(self, keys: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        self.held.append((keys, np.ones(len(keys), np.int64)))
        self.size += len(keys)
        if self.size >= 4 * self.most:
            self._sum()
            if self.size >= self.most:
                yield from self.rest()

    def rest(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        self._sum()
        if self.size:
            yield self.held[0]
        self.held, self.size = [], 0

    def _sum(self) -> None:
        if self.held:
            keys, at = np.unique(np.concatenate([k for k, _ in self.held]), return_inverse=True)
            counts = np.bincount(at, np.concatenate([c for _, c in self.held]), len(keys)).astype(np.int64)
            self.held, self.size = [(keys, counts)], len(keys)


class Forest:
    """Union-find over a few indices."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def find(self, i: int) -> int:
        root = self.root
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    def union(self, i: int, j: int) -> None:
        i, j = self.find(i), self.find(j)
        self.root[max(i, j)] = min(i, j)


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    """Common elements of two sorted arrays of distinct values."""
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int(np.count_nonzero(b[at] == a)) if len(b) else 0
