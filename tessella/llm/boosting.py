"""Gradient-boosted trees on small integer features, in numpy."""

from __future__ import annotations

import numpy as np

#: Features are clipped to 0 .. BINS - 1.
BINS = 16


class Boosted:
    """Binary classifier: ``trees`` trees of fixed ``depth``, logistic loss; ``threshold`` is calibrated on held-out rows."""

    def __init__(self, trees: int = 40, depth: int = 4, rate: float = 0.3, ridge: float = 1.0):
        self.n, self.depth, self.rate, self.ridge = trees, depth, rate, ridge
        self.base, self.threshold = 0.0, 0.5
        self.feature: list[np.ndarray] = []
        self.cut: list[np.ndarray] = []
        self.leaf: list[np.ndarray] = []

    def fit(self, x: np.ndarray, y: np.ndarray) -> "Boosted":
        x = np.clip(x, 0, BINS - 1).astype(np.int64)
        rows, cols = x.shape
        rate = min(max(y.mean(), 1e-4), 1 - 1e-4)
        self.base = float(np.log(rate / (1 - rate)))
        score = np.full(rows, self.base)
        flat = x + np.arange(cols) * BINS
        for _ in range(self.n):
            p = 1 / (1 + np.exp(-score))
            grad, hess = y - p, np.maximum(p * (1 - p), 1e-6)
            node = np.zeros(rows, np.int64)
            feature, cut = np.zeros(2**self.depth - 1, np.int64), np.full(2**self.depth - 1, BINS)
            for level in range(self.depth):
                width = 2**level
                at = (node[:, None] * (cols * BINS) + flat).ravel()
                size = width * cols * BINS
                g = np.bincount(at, np.repeat(grad, cols), size).reshape(width, cols, BINS).cumsum(2)
                h = np.bincount(at, np.repeat(hess, cols), size).reshape(width, cols, BINS).cumsum(2)
                gt, ht = g[:, :, -1:], h[:, :, -1:]
                gain = g**2 / (h + self.ridge) + (gt - g) ** 2 / (ht - h + self.ridge) - gt**2 / (ht + self.ridge)
                best = gain.reshape(width, -1).argmax(1)
                f, c = best // BINS, best % BINS
                ok = gain.reshape(width, -1)[np.arange(width), best] > 1e-6
                start = width - 1
                feature[start : start + width] = f
                cut[start : start + width] = np.where(ok, c, BINS)
                node = node * 2 + (x[np.arange(rows), f[node]] > np.where(ok, c, BINS)[node])
            g = np.bincount(node, grad, 2**self.depth)
            h = np.bincount(node, hess, 2**self.depth)
            leaf = self.rate * g / (h + self.ridge)
            score += leaf[node]
            self.feature.append(feature)
            self.cut.append(cut)
            self.leaf.append(leaf)
        return self

    def calibrate(self, x: np.ndarray, y: np.ndarray) -> "Boosted":
        """The threshold of the best F1 on rows that were held out."""
        p = self.predict(x)
        order = np.argsort(-p)
        hit = np.cumsum(y[order])
        f1 = 2 * hit / (np.arange(1, len(p) + 1) + y.sum())
        best = int(f1.argmax())
        # of all thresholds that give this F1 the one nearest to even odds
        low = p[order[best + 1]] if best + 1 < len(p) else 0.0
        self.threshold = float(np.clip(0.5, (low + p[order[best]]) / 2, p[order[best]]))
        self.f1 = float(f1[best])
        return self

    def predict(self, x: np.ndarray) -> np.ndarray:
        x = np.clip(x, 0, BINS - 1).astype(np.int64)
        rows = np.arange(len(x))
        score = np.full(len(x), self.base)
        for feature, cut, leaf in zip(self.feature, self.cut, self.leaf):
            node = np.zeros(len(x), np.int64)
            for level in range(self.depth):
                at = node + 2**level - 1
                node = node * 2 + (x[rows, feature[at]] > cut[at])
            score += leaf[node]
        return 1 / (1 + np.exp(-score))
