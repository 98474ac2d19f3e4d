"""Gradient-boosted trees in numpy: logistic loss, quantile bins, level-wise trees of fixed depth, each grown
on a part of the rows that a seed draws."""

from __future__ import annotations

import numpy as np


class Booster:
    """Complete binary trees in arrays: split feature and bin per inner node, value per leaf."""

    def __init__(self, trees: int = 40, depth: int = 4, rate: float = 0.25, bins: int = 32, ridge: float = 1.0, rows: int = 8_000, seed: int = 5):
        self.n_trees, self.depth, self.rate, self.bins, self.ridge, self.rows, self.seed = trees, depth, rate, bins, ridge, rows, seed

    def fit(self, x: np.ndarray, y: np.ndarray) -> Booster:
        x, y = np.asarray(x, np.float32), np.asarray(y, float)
        self.edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, self.bins + 1)[1:-1])) for j in range(x.shape[1])]
        every, r = self._binned(x), np.random.default_rng(self.seed)
        mean = np.clip(y.mean(), 1e-3, 1 - 1e-3)
        self.base = float(np.log(mean / (1 - mean)))
        z = np.full(len(y), self.base)
        self.feature = np.zeros((self.n_trees, (1 << self.depth) - 1), np.int32)
        self.bin = np.full(self.feature.shape, self.bins, np.int32)
        self.value = np.zeros((self.n_trees, 1 << self.depth))
        used = [j for j, e in enumerate(self.edges) if len(e)]
        for t in range(self.n_trees):
            some = r.choice(len(y), self.rows, replace=False) if len(y) > self.rows else np.arange(len(y))
            b, p = every[some], 1 / (1 + np.exp(-z[some]))
            g, h = y[some] - p, p * (1 - p) + 1e-6
            at = np.zeros(len(some), np.int64)
            for level in range(self.depth):
                width = 1 << level
                gain, feature, cut = np.full(width, 1e-3), np.zeros(width, np.int32), np.full(width, self.bins, np.int32)
                for j in used:
                    key = at * (self.bins + 1) + b[:, j]
                    gs = np.bincount(key, g, width * (self.bins + 1)).reshape(width, -1).cumsum(1)
                    hs = np.bincount(key, h, width * (self.bins + 1)).reshape(width, -1).cumsum(1)
                    gt, ht = gs[:, -1:], hs[:, -1:]
                    s = gs**2 / (hs + self.ridge) + (gt - gs) ** 2 / (ht - hs + self.ridge) - gt**2 / (ht + self.ridge)
                    best = s.argmax(1)
                    better = s[np.arange(width), best] > gain
                    gain[better], feature[better], cut[better] = s[np.arange(width), best][better], j, best[better]
                self.feature[t, width - 1 : 2 * width - 1], self.bin[t, width - 1 : 2 * width - 1] = feature, cut
                at = 2 * at + (b[np.arange(len(b)), feature[at]] > cut[at])
            gs, hs = np.bincount(at, g, 1 << self.depth), np.bincount(at, h, 1 << self.depth)
            self.value[t] = self.rate * gs / (hs + self.ridge)
            z += self._tree(every, t)
        return self

    def _tree(self, b: np.ndarray, t: int) -> np.ndarray:
        """A tree's values for binned rows."""
        at, rows = np.zeros(len(b), np.int64), np.arange(len(b))
        for level in range(self.depth):
            i = at + (1 << level) - 1
            at = 2 * at + (b[rows, self.feature[t][i]] > self.bin[t][i])
        return self.value[t][at]

    def _binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(self.edges)], 1).astype(np.int32)

    def margin(self, x: np.ndarray) -> np.ndarray:
        """Log-odds."""
        b = self._binned(np.asarray(x, np.float32))
        return self.base + sum(self._tree(b, t) for t in range(self.n_trees))
