"""Gradient-boosted regression trees with logistic loss, on binned features, in numpy."""

from __future__ import annotations

import numpy as np


class BoostedTrees:
    """Trees of fixed depth; each level of a tree picks one feature and cut for each node."""

    def __init__(self, rounds: int = 40, depth: int = 3, rate: float = 0.2, bins: int = 16, least: int = 10, l2: float = 1.0):
        self.rounds, self.depth, self.rate, self.bins, self.least, self.l2 = rounds, depth, rate, bins, least, l2
        self.trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.start = 0.0

    def fit(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        cuts = [np.unique(np.quantile(c, np.linspace(0, 1, self.bins + 1)[1:-1])) for c in x.T]
        binned = np.stack([np.searchsorted(q, c, side="left") for q, c in zip(cuts, x.T)], axis=1)
        p = np.clip(y.mean(), 1e-3, 1 - 1e-3)
        self.start = float(np.log(p / (1 - p)))
        raw = np.full(len(y), self.start)
        for _ in range(self.rounds):
            prob = 1 / (1 + np.exp(-raw))
            grad, hess = y - prob, prob * (1 - prob)
            node = np.zeros(len(y), np.int64)
            feature, cut = np.full(2**self.depth - 1, -1), np.zeros(2**self.depth - 1)
            for level in range(self.depth):
                for k in range(2**level):
                    own = node == k
                    if (best := self._split(binned[own], grad[own], hess[own], cuts)) is not None:
                        f, c = best
                        at = 2**level - 1 + k
                        feature[at], cut[at] = f, cuts[f][c]
                node = self._down(x, node, level, feature, cut)
            leaf = np.zeros(2**self.depth)
            for k in range(2**self.depth):
                own = node == k
                leaf[k] = self.rate * grad[own].sum() / (hess[own].sum() + self.l2)
            self.trees.append((feature, cut, leaf))
            raw += leaf[node]
        return self

    def _split(self, binned, grad, hess, cuts) -> tuple[int, int] | None:
        if len(grad) < 2 * self.least:
            return None
        best, where = 1e-6, None
        whole = grad.sum() ** 2 / (hess.sum() + self.l2)
        for f in range(binned.shape[1]):
            size = len(cuts[f]) + 1
            g, h, n = (np.bincount(binned[:, f], w, size).cumsum()[:-1] for w in (grad, hess, None))
            right_g, right_h = grad.sum() - g, hess.sum() - h
            gain = g**2 / (h + self.l2) + right_g**2 / (right_h + self.l2) - whole
            gain[(n < self.least) | (len(grad) - n < self.least)] = -1
            if len(gain) and gain.max() > best:
                best, where = gain.max(), (f, int(gain.argmax()))
        return where

    @staticmethod
    def _down(x, node, level, feature, cut) -> np.ndarray:
        at = 2**level - 1 + node
        f = feature[at]
        return 2 * node + ((f >= 0) & (x[np.arange(len(x)), np.maximum(f, 0)] > cut[at]))

    def predict(self, x: np.ndarray) -> np.ndarray:
        raw = np.full(len(x), self.start)
        for feature, cut, leaf in self.trees:
            node = np.zeros(len(x), np.int64)
            for level in range(self.depth):
                node = self._down(x, node, level, feature, cut)
            raw += leaf[node]
        return 1 / (1 + np.exp(-raw))
