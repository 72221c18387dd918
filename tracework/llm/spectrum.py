"""Leading eigenpairs of a symmetric matrix by slicing its spectrum.

The signs of the pivots of an LDLᵀ factorisation of ``A - shift`` are those of its
eigenvalues, so one factorisation counts the eigenvalues above a shift. Halving
intervals by such counts isolates each leading eigenvalue; Rayleigh quotient
iteration then converges cubically inside its interval, and counts on both sides
of what it found certify the number. Eigenvalues that no shift can tell apart at
double precision are taken together, by iteration on a block of vectors.
"""

from __future__ import annotations

import numpy as np

#: Share of a pivot's column that makes a single pivot stable (Bunch and Parlett).
_ALPHA = (1 + 17**0.5) / 8


def above(matrix: np.ndarray, shift: float) -> int:
    """How many eigenvalues of a symmetric matrix are greater than ``shift``: positive pivots of LDLᵀ with pivots of one and two rows."""
    a = matrix - shift * np.eye(len(matrix))
    tiny = np.finfo(float).eps * len(a) * np.abs(a).max(initial=0)
    count = 0
    while len(a):
        diagonal = np.abs(np.diagonal(a))
        rest = np.abs(a - np.diag(np.diagonal(a)))
        one, two = diagonal.max(), rest.max()
        if max(one, two) <= tiny * 1e-3:  # what is left equals the shift
            break
        if one >= _ALPHA * two:
            k = int(diagonal.argmax())
            pivot = a[k, k]
            count += bool(pivot > 0)
            others = np.arange(len(a)) != k
            column = a[others, k]
            a = a[np.ix_(others, others)] - np.outer(column, column) / pivot
        else:
            r, s = np.unravel_index(int(rest.argmax()), rest.shape)
            count += 1  # such a pair has one eigenvalue of either sign
            pair = [r, s]
            others = np.ones(len(a), bool)
            others[pair] = False
            columns = a[np.ix_(others, pair)]
            a = a[np.ix_(others, others)] - columns @ np.linalg.solve(a[np.ix_(pair, pair)], columns.T)
        a = (a + a.T) / 2
    return count


class Slices:
    """Counts made so far, and the interval each numbered eigenvalue lies in."""

    def __init__(self, matrix: np.ndarray):
        self.matrix = matrix
        self.top = float(np.abs(matrix).sum(axis=1).max(initial=0))
        span = self.top * (1 + 1e-9) + 1e-300
        self.known = {-span: len(matrix), span: 0}

    def count(self, shift: float) -> int:
        if shift not in self.known:
            self.known[shift] = above(self.matrix, shift)
        return self.known[shift]

    def around(self, k: int) -> tuple[float, float]:
        """The narrowest known interval with the ``k``-th greatest eigenvalue."""
        low = max(s for s, c in self.known.items() if c >= k)
        high = min(s for s, c in self.known.items() if c < k and s > low)
        return low, high


def leading(matrix: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``most`` greatest eigenvalues, falling, and their orthonormal eigenvectors as columns."""
    size = len(matrix)
    most = min(most, size)
    values, vectors = np.zeros(most), np.zeros((size, most))
    slices = Slices(matrix)
    if not slices.top:  # nothing but zeros: any basis will do
        return values, np.eye(size)[:, :most]
    least = 64 * np.finfo(float).eps * slices.top  # narrower intervals cannot be told apart
    rng = np.random.default_rng(13)
    k = 1
    while k <= most:
        low, high = slices.around(k)
        while high - low > least and not (slices.count(low) == k and slices.count(high) == k - 1):
            middle = (low + high) / 2
            slices.count(middle)
            low, high = slices.around(k)
        together = 1
        if high - low > least:
            value, vector = _quotient(slices, k, vectors[:, : k - 1], rng)
            values[k - 1], vectors[:, k - 1] = value, vector
        else:
            together = min(slices.count(low) - slices.count(high), most - k + 1)
            found = _block(matrix, (low + high) / 2, slices.count(low) - slices.count(high), vectors[:, : k - 1], rng)[:, :together]
            vectors[:, k - 1 : k - 1 + together] = found
            values[k - 1 : k - 1 + together] = np.einsum("ij,ij->j", found, matrix @ found)
        k += together
    _certify(slices, values, vectors)
    return values, vectors


def _solve(matrix: np.ndarray, shift: float, right: np.ndarray) -> np.ndarray:
    """Solution for ``matrix - shift``; where that is singular, for a shift next to it."""
    scale = np.abs(matrix).max(initial=0) or 1.0
    for step in (0.0, 1e-16, 1e-15, 1e-14):
        try:
            out = np.linalg.solve(matrix - (shift + step * scale) * np.eye(len(matrix)), right)
        except np.linalg.LinAlgError:
            continue
        if np.isfinite(out).all():
            return out
    raise ArithmeticError("no shift next to an eigenvalue could be solved for")


def _apart(vector: np.ndarray, others: np.ndarray) -> np.ndarray:
    for _ in range(2):
        vector = vector - others @ (others.T @ vector)
    return vector / np.linalg.norm(vector)


def _quotient(slices: Slices, k: int, others: np.ndarray, rng: np.random.Generator) -> tuple[float, np.ndarray]:
    """Rayleigh quotient iteration for an isolated eigenvalue; the interval is halved where the iteration leaves it."""
    matrix = slices.matrix
    small = 4 * np.finfo(float).eps * slices.top
    while True:
        low, high = slices.around(k)
        vector = _apart(rng.standard_normal(len(matrix)), others)
        for _ in range(2):
            vector = _apart(_solve(matrix, (low + high) / 2, vector), others)
        best = np.inf
        for _ in range(12):
            value = float(vector @ matrix @ vector)
            residual = float(np.linalg.norm(matrix @ vector - value * vector))
            if not low <= value <= high or residual >= best:
                break
            best, kept = residual, (value, vector)
            if residual <= small:
                break
            vector = _apart(_solve(matrix, value, vector), others)
        if best <= 16 * small * len(matrix) ** 0.5 and low - best <= kept[0] <= high + best:
            return kept
        if high - low <= small:
            return kept if np.isfinite(best) else (value, vector)
        slices.count((low + high) / 2)


def _block(matrix: np.ndarray, shift: float, size: int, others: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """An orthonormal basis for eigenvalues that are equal at double precision."""
    block = rng.standard_normal((len(matrix), size))
    for _ in range(4):
        block = _solve(matrix, shift, block)
        block /= np.abs(block).max()
        for _ in range(2):
            block = block - others @ (others.T @ block)
            block, _ = np.linalg.qr(block)
    return block


def _certify(slices: Slices, values: np.ndarray, vectors: np.ndarray) -> None:
    """Every value is the one of its number: enough eigenvalues above it less its error, few enough above it plus that."""
    residual = np.linalg.norm(slices.matrix @ vectors - vectors * values, axis=0)
    error = residual + 256 * np.finfo(float).eps * slices.top
    for k, (value, e) in enumerate(zip(values, error), 1):
        if not above(slices.matrix, value - e) >= k > above(slices.matrix, value + e):
            raise ArithmeticError(f"eigenvalue {k} could not be certified")
