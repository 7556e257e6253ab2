"""Boosted trees on small whole-number features, for models of a bounded sample."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

BINS = 32


@dataclass
class BoostedTrees:
    """Trees of a fixed depth as arrays: at a node, feature and the largest value that goes left; at a leaf, what it adds."""

    depth: int
    bias: float = 0.0
    feature: list[np.ndarray] = field(default_factory=list)
    split: list[np.ndarray] = field(default_factory=list)
    leaf: list[np.ndarray] = field(default_factory=list)

    def _leaves(self, x: np.ndarray, k: int) -> np.ndarray:
        node = np.zeros(len(x), np.int64)
        for _ in range(self.depth):
            node = 2 * node + 1 + (x[np.arange(len(x)), self.feature[k][node]] > self.split[k][node])
        return node - (2**self.depth - 1)

    def probability(self, x: np.ndarray) -> np.ndarray:
        """x: rows of features from 0 to BINS - 1."""
        z = np.full(len(x), self.bias)
        for k in range(len(self.leaf)):
            z += self.leaf[k][self._leaves(x, k)]
        return 1 / (1 + np.exp(-z))


def fit_trees(x: np.ndarray, y: np.ndarray, rounds: int = 30, depth: int = 3, rate: float = 0.3, ridge: float = 1.0) -> BoostedTrees:
    """Logistic loss; each split takes the largest gain, ties the first feature and value."""
    share = (y.sum() + 0.5) / (len(y) + 1)
    model = BoostedTrees(depth, float(np.log(share / (1 - share))))
    z = np.full(len(y), model.bias)
    inner = 2**depth - 1
    for _ in range(rounds if len(y) else 0):
        p = 1 / (1 + np.exp(-z))
        g, h = y - p, p * (1 - p)
        feature, split, node = np.zeros(inner, np.int64), np.full(inner, BINS), np.zeros(len(y), np.int64)
        for at in range(inner):
            mine = np.flatnonzero(node == at)
            best = 1e-6
            for f in range(x.shape[1] if len(mine) else 0):
                left_g = np.cumsum(np.bincount(x[mine, f], g[mine], BINS))
                left_h = np.cumsum(np.bincount(x[mine, f], h[mine], BINS))
                gain = left_g**2 / (left_h + ridge) + (left_g[-1] - left_g) ** 2 / (left_h[-1] - left_h + ridge) - left_g[-1] ** 2 / (left_h[-1] + ridge)
                if gain.max() > best:
                    best, feature[at], split[at] = gain.max(), f, int(gain.argmax())
            node[mine] = 2 * at + 1 + (x[mine, feature[at]] > split[at])
        leaf = node - inner
        value = rate * np.bincount(leaf, g, inner + 1) / (np.bincount(leaf, h, inner + 1) + ridge)
        z += value[leaf]
        model.feature.append(feature)
        model.split.append(split)
        model.leaf.append(value)
    return model
