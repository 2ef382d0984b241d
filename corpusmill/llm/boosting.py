"""Gradient-boosted trees for two classes, over numpy arrays."""

from __future__ import annotations

import numpy as np


class BoostedTrees:
    """Logistic boosting with histogram splits; every tree is a full binary tree of ``depth`` levels."""

    def __init__(self, trees: int = 80, depth: int = 4, rate: float = 0.25, bins: int = 32, smooth: float = 2.0):
        self.trees, self.depth, self.rate, self.bins, self.smooth = trees, depth, rate, bins, smooth

    def _binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(self.edges)], 1)

    def fit(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        quantiles = np.linspace(0, 1, self.bins)[1:-1]
        self.edges = [np.unique(np.quantile(x[:, j], quantiles)) for j in range(x.shape[1])]
        b = self._binned(x)
        mean = np.clip(y.mean(), 1e-6, 1 - 1e-6)
        self.start = float(np.log(mean / (1 - mean)))
        raw = np.full(len(y), self.start)
        self.model = []
        for _ in range(self.trees):
            p = 1 / (1 + np.exp(-raw))
            tree, at = self._grow(b, y - p, p * (1 - p))
            self.model.append(tree)
            raw += tree[2][at]
        return self

    def _grow(self, b, grad, hess):
        n, m = b.shape
        feature, cut = np.zeros((1 << self.depth) - 1, np.int64), np.full((1 << self.depth) - 1, self.bins, np.int64)
        node = np.zeros(n, np.int64)
        for level in range(self.depth):
            width, first = 1 << level, (1 << level) - 1
            g, h = np.empty((m, width, self.bins)), np.empty((m, width, self.bins))
            for j in range(m):
                key = node * self.bins + b[:, j]
                g[j] = np.bincount(key, grad, width * self.bins).reshape(width, -1)
                h[j] = np.bincount(key, hess, width * self.bins).reshape(width, -1)
            gl, hl = g.cumsum(2), h.cumsum(2)
            gt, ht = gl[:, :, -1:], hl[:, :, -1:]
            gain = gl**2 / (hl + self.smooth) + (gt - gl) ** 2 / (ht - hl + self.smooth) - gt**2 / (ht + self.smooth)
            gain[(hl < 1) | (ht - hl < 1)] = -1
            best = gain.transpose(1, 0, 2).reshape(width, -1)
            at = best.argmax(1)
            split = best[np.arange(width), at] > 1e-6
            feature[first : first + width] = at // self.bins
            cut[first : first + width] = np.where(split, at % self.bins, self.bins)
            node = 2 * node + (b[np.arange(n), feature[first + node]] > cut[first + node])
        g, h = np.bincount(node, grad, 1 << self.depth), np.bincount(node, hess, 1 << self.depth)
        return (feature, cut, self.rate * g / (h + self.smooth)), node

    def probability(self, x: np.ndarray) -> np.ndarray:
        b = self._binned(x)
        raw, rows = np.full(len(x), self.start), np.arange(len(x))
        for feature, cut, leaf in self.model:
            node = np.zeros(len(x), np.int64)
            for level in range(self.depth):
                k = (1 << level) - 1 + node
                node = 2 * node + (b[rows, feature[k]] > cut[k])
            raw += leaf[node]
        return 1 / (1 + np.exp(-raw))
