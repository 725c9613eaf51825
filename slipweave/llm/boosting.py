"""Small gradient-boosted trees for binary labels, on numpy alone."""

from __future__ import annotations

import numpy as np


class BoostedTrees:
    """Logistic boosting of complete trees over quantile bins; fitting is deterministic."""

    def __init__(self, trees: int = 60, depth: int = 4, rate: float = 0.2, bins: int = 32, leaf: float = 5.0):
        self.n, self.depth, self.rate, self.bins, self.leaf = trees, depth, rate, bins, leaf

    def fit(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        rows, cols = x.shape
        self.edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, self.bins + 1)[1:-1])) for j in range(cols)]
        binned = np.stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(self.edges)], 1)
        mean = min(max(float(y.mean()), 1e-3), 1 - 1e-3) if rows else 0.5
        self.base = float(np.log(mean / (1 - mean)))
        score = np.full(rows, self.base)
        inner = 2**self.depth - 1
        self.feature = np.zeros((self.n, inner), np.int32)
        self.cut = np.full((self.n, inner), np.inf)
        self.value = np.zeros((self.n, inner + 1))
        width = self.bins + 1
        for t in range(self.n):
            p = 1 / (1 + np.exp(-score))
            g, h = p - y, np.maximum(p * (1 - p), 1e-6)
            node = np.zeros(rows, np.int64)
            for level in range(self.depth):
                first, count = 2**level - 1, 2**level
                best = np.zeros(count)
                feature, cut = np.zeros(count, np.int32), np.full(count, width)
                for j in range(cols):
                    key = node * width + binned[:, j]
                    gs = np.bincount(key, g, count * width).reshape(count, width).cumsum(1)
                    hs = np.bincount(key, h, count * width).reshape(count, width).cumsum(1)
                    gt, ht = gs[:, -1:], hs[:, -1:]
                    gain = gs**2 / (hs + 1) + (gt - gs) ** 2 / (ht - hs + 1) - gt**2 / (ht + 1)
                    gain[(hs < self.leaf) | (ht - hs < self.leaf)] = 0
                    at = gain.argmax(1)
                    top = gain[np.arange(count), at]
                    better = top > best + 1e-9
                    best[better], feature[better], cut[better] = top[better], j, at[better]
                for k in range(count):
                    self.feature[t, first + k] = feature[k]
                    e = self.edges[feature[k]]
                    self.cut[t, first + k] = e[cut[k]] if cut[k] < len(e) else np.inf
                node = node * 2 + (binned[np.arange(rows), feature[node]] > cut[node])
            gs, hs = np.bincount(node, g, inner + 1), np.bincount(node, h, inner + 1)
            self.value[t] = -self.rate * gs / (hs + 1)
            score += self.value[t][node]
        return self

    def predict(self, x: np.ndarray) -> np.ndarray:
        """Probability of the label 1."""
        score = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for t in range(self.n):
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[rows, self.feature[t][node]] > self.cut[t][node])
            score += self.value[t][node - (2**self.depth - 1)]
        return 1 / (1 + np.exp(-score))
