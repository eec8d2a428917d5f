"""Gradient-boosted trees for a binary target, on binned features, in numpy."""

from __future__ import annotations

import numpy as np

BINS = 32


class Boosted:
    """Depth-limited trees on quantile bins, logistic loss, Newton leaves, and a threshold."""

    def __init__(self, rounds: int = 40, depth: int = 3, rate: float = 0.2, ridge: float = 1.0):
        self.rounds, self.depth, self.rate, self.ridge = rounds, depth, rate, ridge
        self.threshold = 0.5

    def _binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, f], side="right") for f, e in enumerate(self.edges)], axis=1).astype(np.int64)

    def fit(self, x: np.ndarray, y: np.ndarray) -> Boosted:
        self.edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) for f in range(x.shape[1])]
        b, features = self._binned(x), x.shape[1]
        self.start = float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1)))
        score, self.trees = np.full(len(y), self.start), []
        columns = np.arange(features) * BINS
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-score))
            g, h = p - y, p * (1 - p)
            node, splits = np.zeros(len(y), np.int64), []
            for level in range(self.depth):
                nodes = 1 << level
                cell = (node[:, None] * features * BINS + columns + b).reshape(-1)
                size = nodes * features * BINS
                gs = np.bincount(cell, np.repeat(g, features), size).reshape(nodes, features, BINS).cumsum(axis=2)
                hs = np.bincount(cell, np.repeat(h, features), size).reshape(nodes, features, BINS).cumsum(axis=2)
                gt, ht = gs[..., -1:], hs[..., -1:]
                gain = gs**2 / (hs + self.ridge) + (gt - gs) ** 2 / (ht - hs + self.ridge)
                gain[..., -1] = -1
                best = gain.reshape(nodes, -1).argmax(axis=1)
                feature, cut = best // BINS, best % BINS
                splits.append((feature, cut))
                node = 2 * node + (b[np.arange(len(y)), feature[node]] > cut[node])
            gs, hs = np.bincount(node, g, 1 << self.depth), np.bincount(node, h, 1 << self.depth)
            leaf = -self.rate * gs / (hs + self.ridge)
            score += leaf[node]
            self.trees.append((splits, leaf))
        return self

    def predict(self, x: np.ndarray) -> np.ndarray:
        """Probabilities."""
        b, rows = self._binned(x), np.arange(len(x))
        score = np.full(len(x), self.start)
        for splits, leaf in self.trees:
            node = np.zeros(len(x), np.int64)
            for feature, cut in splits:
                node = 2 * node + (b[rows, feature[node]] > cut[node])
            score += leaf[node]
        return 1 / (1 + np.exp(-score))

    def calibrate(self, x: np.ndarray, y: np.ndarray, precision: float) -> Boosted:
        """Sets the lowest threshold above which held-out rows reach ``precision``."""
        p = self.predict(x)
        order = np.argsort(-p, kind="stable")
        reached = np.cumsum(y[order]) / np.arange(1, len(y) + 1) >= precision
        self.threshold = float(p[order][np.flatnonzero(reached)[-1]]) if reached.any() else 1.0
        return self
