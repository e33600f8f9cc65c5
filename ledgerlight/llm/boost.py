"""Gradient-boosted regression trees for the logistic loss, on binned features, in numpy."""

from __future__ import annotations

import numpy as np


class Trees:
    """Depth-limited trees stored as full binary arrays: feature, threshold, leaf values."""

    def __init__(self, depth: int = 3, rounds: int = 60, rate: float = 0.2, ridge: float = 1.0):
        self.depth, self.rounds, self.rate, self.ridge = depth, rounds, rate, ridge
        self.trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.base = 0.0

    def fit(self, x: np.ndarray, y: np.ndarray) -> Trees:
        share = np.clip(y.mean(), 1e-3, 1 - 1e-3)
        self.base = float(np.log(share / (1 - share)))
        edges = [np.unique(c)[:-1] + np.diff(np.unique(c)) / 2 for c in x.T]
        edges = [e if len(e) <= 32 else e[np.linspace(0, len(e) - 1, 32).astype(int)] for e in edges]
        binned = np.stack([np.searchsorted(e, c, "left") for e, c in zip(edges, x.T, strict=True)], 1)
        f = np.full(len(y), self.base)
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-f))
            g, h = p - y, p * (1 - p)
            node = np.zeros(len(y), np.int64)
            feature, cut = np.zeros((1 << self.depth) - 1, np.int64), np.full((1 << self.depth) - 1, np.inf)
            for at in range((1 << self.depth) - 1):
                mine = np.flatnonzero(node == at)
                j, c = self._best(binned[mine], g[mine], h[mine], edges)
                if j >= 0:
                    feature[at], cut[at] = j, edges[j][c]
                right = x[mine, feature[at]] > cut[at]
                node[mine] = 2 * at + 1 + right
            leaf = node - ((1 << self.depth) - 1)
            value = -np.bincount(leaf, g, 1 << self.depth) / (np.bincount(leaf, h, 1 << self.depth) + self.ridge) * self.rate
            self.trees.append((feature, cut, value))
            f += value[leaf]
        return self

    def _best(self, binned, g, h, edges) -> tuple[int, int]:
        best, found = 1e-6, (-1, 0)
        for j, e in enumerate(edges):
            if not len(e) or not len(g):
                continue
            gl, hl = (np.cumsum(np.bincount(binned[:, j], v, len(e) + 1))[:-1] for v in (g, h))
            gain = gl**2 / (hl + self.ridge) + (g.sum() - gl) ** 2 / (h.sum() - hl + self.ridge) - g.sum() ** 2 / (h.sum() + self.ridge)
            c = int(gain.argmax())
            if gain[c] > best:
                best, found = gain[c], (j, c)
        return found

    def raw(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        for feature, cut, value in self.trees:
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[np.arange(len(x)), feature[node]] > cut[node])
            out += value[node - ((1 << self.depth) - 1)]
        return out


def platt(z: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the logistic curve that fits outcomes y to raw scores z."""
    u = np.array([1.0, 0.0])
    x = np.stack([z, np.ones_like(z)], 1)
    for _ in range(50):
        q = 1 / (1 + np.exp(-np.clip(x @ u, -50, 50)))
        u -= np.clip(np.linalg.solve((x * (q * (1 - q))[:, None]).T @ x + 0.1 * np.eye(2), x.T @ (q - y) + 0.1 * (u - [1, 0])), -2, 2)
    return float(u[0]), float(u[1])
