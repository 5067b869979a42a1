"""Gradient-boosted trees for small training sets, in numpy.

Logistic loss, trees of depth two or three on quantile bins, no randomness: the
same rows give the same model. Prediction works on whole arrays.
"""

from __future__ import annotations

import numpy as np


class Booster:
    """``fit`` on features (rows x columns) and labels 0/1; ``predict`` gives probabilities."""

    def __init__(self, rounds: int = 60, depth: int = 3, rate: float = 0.25, bins: int = 32, least: float = 4.0):
        self.rounds, self.depth, self.rate, self.bins, self.least = rounds, depth, rate, bins, least
        self.base = 0.0
        self.trees: list[list[tuple]] = []

    def fit(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None) -> Booster:
        x, y = np.asarray(x, float), np.asarray(y, float)
        w = np.ones(len(y)) if weight is None else np.asarray(weight, float)
        cuts = []
        for j in range(x.shape[1]):
            q = np.unique(np.quantile(x[:, j], np.linspace(0, 1, self.bins + 1)[1:-1])) if len(x) else np.zeros(0)
            cuts.append(q)
        binned = np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)], axis=1) if x.size else np.zeros(x.shape, int)
        p = float(np.clip((w * y).sum() / max(w.sum(), 1e-9), 1e-3, 1 - 1e-3))
        self.base = float(np.log(p / (1 - p)))
        score = np.full(len(y), self.base)
        for _ in range(self.rounds):
            q = 1 / (1 + np.exp(-score))
            grad, hess = w * (y - q), w * q * (1 - q)
            nodes: list[tuple] = []
            value = np.zeros(len(y))
            self._grow(binned, cuts, grad, hess, np.arange(len(y)), 0, nodes, value)
            self.trees.append(nodes)
            score += value
        return self

    def _grow(self, binned, cuts, grad, hess, rows, depth, nodes, value) -> int:
        g, h = grad[rows].sum(), hess[rows].sum()
        at = len(nodes)
        leaf = self.rate * g / (h + 1.0)
        nodes.append((-1, 0.0, 0, 0, leaf))
        best = (1e-6, -1, 0)
        if depth < self.depth and len(rows) >= 2 * self.least:
            for j, c in enumerate(cuts):
                if not len(c):
                    continue
                b = binned[rows, j]
                n = len(c) + 1
                gs, hs = np.bincount(b, grad[rows], n).cumsum()[:-1], np.bincount(b, hess[rows], n).cumsum()[:-1]
                ns = np.bincount(b, minlength=n).cumsum()[:-1]
                gain = gs**2 / (hs + 1) + (g - gs) ** 2 / (h - hs + 1) - g**2 / (h + 1)
                gain[(ns < self.least) | (len(rows) - ns < self.least)] = 0
                k = int(gain.argmax())
                if gain[k] > best[0]:
                    best = (gain[k], j, k)
        if best[1] < 0:
            value[rows] = leaf
            return at
        _, j, k = best
        left = binned[rows, j] <= k
        a = self._grow(binned, cuts, grad, hess, rows[left], depth + 1, nodes, value)
        b = self._grow(binned, cuts, grad, hess, rows[~left], depth + 1, nodes, value)
        nodes[at] = (j, float(cuts[j][k]), a, b, 0.0)
        return at

    def predict(self, x: np.ndarray) -> np.ndarray:
        x = np.asarray(x, float)
        score = np.full(len(x), self.base)
        for nodes in self.trees:
            at = np.zeros(len(x), int)
            columns = np.array([n[0] for n in nodes])
            cuts = np.array([n[1] for n in nodes])
            lefts, rights = np.array([n[2] for n in nodes]), np.array([n[3] for n in nodes])
            leaves = np.array([n[4] for n in nodes])
            for _ in range(self.depth):
                inner = columns[at] >= 0
                if not inner.any():
                    break
                v = x[np.arange(len(x)), np.maximum(columns[at], 0)]
                at = np.where(inner, np.where(v <= cuts[at], lefts[at], rights[at]), at)
            score += leaves[at]
        return 1 / (1 + np.exp(-score))
