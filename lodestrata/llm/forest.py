"""A random forest of binary classification trees in numpy."""

from __future__ import annotations

import numpy as np


class Forest:
    """Trees on bootstrap samples, each split the best of some random features by Gini impurity."""

    def __init__(self, x: np.ndarray, y: np.ndarray, trees: int = 40, depth: int = 9, least: int = 3, seed: int = 3) -> None:
        rng = np.random.default_rng(seed)
        x, y = np.asarray(x, float), np.asarray(y, float)
        self._trees = []
        for _ in range(trees):
            rows = rng.integers(len(y), size=len(y))
            nodes: list[list[float]] = []
            self._grow(x[rows], y[rows], depth, least, rng, nodes)
            self._trees.append(np.array(nodes))

    def _grow(self, x, y, depth, least, rng, nodes) -> int:
        """Append a subtree: rows of feature (-1: leaf), cut, left, right, share of label 1."""
        me = len(nodes)
        nodes.append([-1, 0, 0, 0, y.mean()])
        if depth == 0 or len(y) < 2 * least or y.min() == y.max():
            return me
        best = (np.inf, -1, 0.0)
        for f in rng.permutation(x.shape[1])[: max(2, int(x.shape[1] ** 0.5) + 1)]:
            order = np.argsort(x[:, f], kind="stable")
            v, ones = x[order, f], np.cumsum(y[order])
            n = np.arange(1, len(v))
            left, right = ones[:-1] / n, (ones[-1] - ones[:-1]) / (len(v) - n)
            cost = n * left * (1 - left) + (len(v) - n) * right * (1 - right)
            cost[(v[1:] == v[:-1]) | (n < least) | (len(v) - n < least)] = np.inf
            i = int(cost.argmin())
            if cost[i] < best[0]:
                best = (cost[i], f, (v[i] + v[i + 1]) / 2)
        if best[1] < 0:
            return me
        low = x[:, best[1]] <= best[2]
        nodes[me][:2] = best[1], best[2]
        nodes[me][2] = self._grow(x[low], y[low], depth - 1, least, rng, nodes)
        nodes[me][3] = self._grow(x[~low], y[~low], depth - 1, least, rng, nodes)
        return me

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Mean share of label 1 in the leaves that each row reaches."""
        out, rows = np.zeros(len(x)), np.arange(len(x))
        for t in self._trees:
            at = np.zeros(len(x), int)
            while True:
                f = t[at, 0].astype(int)
                open_ = f >= 0
                if not open_.any():
                    break
                low = x[rows, np.maximum(f, 0)] <= t[at, 1]
                at = np.where(open_, np.where(low, t[at, 2], t[at, 3]).astype(int), at)
            out += t[at, 4]
        return out / len(self._trees)
