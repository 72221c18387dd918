"""Small models fitted on bounded samples: logistic regression and boosted trees."""

from __future__ import annotations

import numpy as np


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(z, -40, 40)))


def logit(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-9, 1 - 1e-9)
    return np.log(p / (1 - p))


class Logistic:
    """L2-regularised logistic regression on standardised columns (held to five deviations), by Newton steps.

    ``scale`` multiplies the standardised columns: below 1, a column costs more to rely on.
    """

    def __init__(self, scale: np.ndarray | float = 1.0):
        self.scale = scale

    def fit(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None, l2: float = 1.0) -> Logistic:
        self.mean, self.std = x.mean(axis=0), x.std(axis=0)
        self.std = np.where(self.std > 1e-12, self.std, 1.0)
        z = self._wide(x)
        weight = np.ones(len(y)) if weight is None else weight
        ridge = np.full(z.shape[1], l2)
        ridge[-1] = 1e-6
        self.coef = np.zeros(z.shape[1])
        for _ in range(25):
            p = sigmoid(z @ self.coef)
            grad = z.T @ (weight * (p - y)) + ridge * self.coef
            h = (z * (weight * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ z + np.diag(ridge)
            step = np.linalg.solve(h, grad)
            self.coef -= step
            if np.abs(step).max() < 1e-6:
                break
        return self

    def _wide(self, x: np.ndarray) -> np.ndarray:
        return np.hstack([self.scale * np.clip((x - self.mean) / self.std, -5, 5), np.ones((len(x), 1))])

    def decision(self, x: np.ndarray) -> np.ndarray:
        return self._wide(x) @ self.coef

    def predict(self, x: np.ndarray) -> np.ndarray:
        return sigmoid(self.decision(x))


class BoostedTrees:
    """Gradient boosting of depth-two trees on binned columns, for logistic loss."""

    def __init__(self, rounds: int = 40, rate: float = 0.3, bins: int = 16):
        self.rounds, self.rate, self.bins = rounds, rate, bins

    def fit(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        cuts = [np.unique(np.quantile(c, np.linspace(0, 1, self.bins + 1)[1:-1])) for c in x.T]
        b = np.stack([np.searchsorted(q, c, side="left") for q, c in zip(cuts, x.T)], axis=1)
        rate = np.clip(y.mean(), 1e-3, 1 - 1e-3)
        self.start, self.trees = float(np.log(rate / (1 - rate))), []
        score = np.full(len(y), self.start)
        for _ in range(self.rounds):
            p = sigmoid(score)
            g, h = y - p, np.maximum(p * (1 - p), 1e-6)
            everyone = np.ones(len(y), bool)
            root = self._split(b, g, h, everyone)
            if root is None:
                break
            left = b[:, root[0]] <= root[1]
            tree = [(root[0], float(cuts[root[0]][root[1]]))]
            for side in (left, ~left):
                s = self._split(b, g, h, side)
                if s is None:
                    v = self._leaf(g, h, side)
                    tree.append((0, np.inf, v, v))
                    score[side] += v
                    continue
                low = side & (b[:, s[0]] <= s[1])
                high = side & ~low
                v = self._leaf(g, h, low), self._leaf(g, h, high)
                tree.append((s[0], float(cuts[s[0]][s[1]]), *v))
                score[low] += v[0]
                score[high] += v[1]
            self.trees.append(tree)
        return self

    def _leaf(self, g: np.ndarray, h: np.ndarray, rows: np.ndarray) -> float:
        return float(self.rate * g[rows].sum() / (h[rows].sum() + 1.0))

    def _split(self, b: np.ndarray, g: np.ndarray, h: np.ndarray, rows: np.ndarray):
        best, gain = None, 1e-6
        total_g, total_h = g[rows].sum(), h[rows].sum()
        for k in range(b.shape[1]):
            sg = np.bincount(b[rows, k], g[rows], self.bins).cumsum()[:-1]
            sh = np.bincount(b[rows, k], h[rows], self.bins).cumsum()[:-1]
            if not len(sg):
                continue
            value = sg**2 / (sh + 1) + (total_g - sg) ** 2 / (total_h - sh + 1) - total_g**2 / (total_h + 1)
            value[b[rows, k].max(initial=0) :] = -1
            at = int(value.argmax())
            if value[at] > gain:
                best, gain = (k, at), value[at]
        return best

    def decision(self, x: np.ndarray) -> np.ndarray:
        score = np.full(len(x), self.start)
        for (k, cut), low, high in self.trees:
            left = x[:, k] <= cut
            for rows, (f, c, a, b) in ((left, low), (~left, high)):
                score += np.where(rows, np.where(x[:, f] <= c, a, b), 0.0)
        return score
