"""Nearest points of the E8 lattice and cells of random projections."""

from __future__ import annotations

import numpy as np


def _d8(x: np.ndarray) -> np.ndarray:
    """Nearest point with integer coordinates of even sum."""
    near = np.rint(x)
    odd = (near.sum(axis=1).astype(np.int64) & 1).astype(bool)
    if odd.any():
        rest = (x - near)[odd]
        worst = np.abs(rest).argmax(axis=1)
        rows = np.flatnonzero(odd)
        near[rows, worst] += np.where(rest[np.arange(len(rest)), worst] >= 0, 1.0, -1.0)
    return near


def decode(x: np.ndarray) -> np.ndarray:
    """Nearest E8 point of each row, doubled so that coordinates are integers."""
    whole, half = _d8(x), _d8(x - 0.5) + 0.5
    nearer = ((x - whole) ** 2).sum(axis=1) <= ((x - half) ** 2).sum(axis=1)
    return np.rint(2 * np.where(nearer[:, None], whole, half)).astype(np.int64)


def minimal_vectors() -> np.ndarray:
    """The 240 shortest vectors of the lattice, doubled."""
    out = []
    for i in range(8):
        for j in range(i):
            for a in (2, -2):
                for b in (2, -2):
                    v = np.zeros(8, np.int64)
                    v[i], v[j] = a, b
                    out.append(v)
    for signs in range(256):
        v = np.array([1 if signs >> k & 1 else -1 for k in range(8)], np.int64)
        if (v < 0).sum() % 2 == 0:
            out.append(v)
    return np.stack(out)


_NEIGHBOURS = minimal_vectors()
_ODD = np.random.default_rng(8).integers(1, 1 << 63, 8).astype(np.uint64) * np.uint64(2) + np.uint64(1)


def _cell(points: np.ndarray, table: int) -> np.ndarray:
    h = (points.astype(np.uint64) * _ODD).sum(axis=-1, dtype=np.uint64) + np.uint64(
        (table + 1) * 0xD1B54A32D192ED03 % (1 << 64)
    )
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return (h ^ (h >> np.uint64(29))).view(np.int64)


def cells(unit: np.ndarray, tables: int, probes: int, scale: float, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Home cell (rows, tables) and probed neighbours (rows, tables, probes) of unit vectors.

    Each table projects with its own Gaussian matrix to eight dimensions and
    takes the nearest lattice point; the neighbours probed are those of the 240
    whose centres lie nearest to the projected vector.
    """
    home = np.empty((len(unit), tables), np.int64)
    near = np.empty((len(unit), tables, probes), np.int64)
    for t in range(tables):
        y = unit @ np.random.default_rng((seed, t, unit.shape[1])).standard_normal((unit.shape[1], 8)) * scale
        point = decode(y)
        home[:, t] = _cell(point, t)
        if probes:
            gain = (2 * y - point) @ _NEIGHBOURS.T.astype(float)
            best = np.argpartition(-gain, probes - 1, axis=1)[:, :probes]
            near[:, t] = _cell(point[:, None, :] + _NEIGHBOURS[best], t)
    return home, near
