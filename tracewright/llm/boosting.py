"""Gradient-boosted trees for two classes: small, in numpy, for models that are fitted on bounded samples."""

from __future__ import annotations

import numpy as np


class BoostedTrees:
    """Trees of depth 3 over binned features, fitted to the logistic loss by second-order steps."""

    def __init__(self, trees: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 32, ridge: float = 1.0, least: float = 1.0):
        self.n, self.depth, self.rate, self.bins, self.ridge, self.least = trees, depth, rate, bins, ridge, least
        self.trees: list[list[tuple[int, float]]] = []
        self.leaves: list[np.ndarray] = []
        self.bias = 0.0

    def _best(self, bins: np.ndarray, g: np.ndarray, h: np.ndarray) -> tuple[int, float]:
        """Feature and cut of the greatest gain, from sums of g and h per bin; (-1, 0) if no split gains."""
        best, out = 1e-6, (-1, 0.0)
        score = lambda a, b: a * a / (b + self.ridge)
        all_g, all_h = g.sum(), h.sum()
        for f, cuts in enumerate(self.cuts):
            if len(cuts):
                left_g = np.bincount(bins[:, f], g, len(cuts) + 1).cumsum()[:-1]
                left_h = np.bincount(bins[:, f], h, len(cuts) + 1).cumsum()[:-1]
                gain = score(left_g, left_h) + score(all_g - left_g, all_h - left_h) - score(all_g, all_h)
                gain[np.minimum(left_h, all_h - left_h) < self.least] = -np.inf
                at = int(gain.argmax())
                if gain[at] > best:
                    best, out = float(gain[at]), (f, float(cuts[at]))
        return out

    def fit(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        self.cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, self.bins + 1)[:-1])) for f in range(x.shape[1])]
        bins = np.stack([np.searchsorted(cuts, x[:, f], "left") for f, cuts in enumerate(self.cuts)], axis=1)  # bin k: up to cut k
        share = np.clip(y.mean(), 1e-3, 1 - 1e-3)
        self.bias = float(np.log(share / (1 - share)))
        raw = np.full(len(y), self.bias)
        for _ in range(self.n):
            p = 1 / (1 + np.exp(-raw))
            g, h = y - p, p * (1 - p)
            nodes = np.zeros(len(y), int)  # number of the node within its level
            tree: list[tuple[int, float]] = []
            for level in range(self.depth):
                splits = [self._best(bins[nodes == k], g[nodes == k], h[nodes == k]) if (nodes == k).any() else (-1, 0.0) for k in range(1 << level)]
                tree += splits
                nodes = nodes * 2 + self._right(x, nodes, splits)
            leaf = np.bincount(nodes, g, 1 << self.depth) / (np.bincount(nodes, h, 1 << self.depth) + self.ridge) * self.rate
            self.trees.append(tree)
            self.leaves.append(leaf)
            raw += leaf[nodes]
        return self

    @staticmethod
    def _right(x: np.ndarray, nodes: np.ndarray, splits: list[tuple[int, float]]) -> np.ndarray:
        f, cut = np.array([s[0] for s in splits])[nodes], np.array([s[1] for s in splits])[nodes]
        return ((f >= 0) & (x[np.arange(len(x)), np.maximum(f, 0)] > cut)).astype(int)

    def predict(self, x: np.ndarray) -> np.ndarray:
        """The probability of class 1."""
        raw = np.full(len(x), self.bias)
        for tree, leaf in zip(self.trees, self.leaves, strict=True):
            nodes = np.zeros(len(x), int)
            for level in range(self.depth):
                nodes = nodes * 2 + self._right(x, nodes, tree[(1 << level) - 1 : (2 << level) - 1])
            raw += leaf[nodes]
        return 1 / (1 + np.exp(-raw))
