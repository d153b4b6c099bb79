"""Gradient-boosted trees for two classes, on binned features, in numpy."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np


@dataclass
class Boosted:
    """Trees of a fixed depth as arrays: node k has children 2k + 1 and 2k + 2."""

    depth: int
    base: float
    features: list[np.ndarray] = field(default_factory=list)
    cuts: list[np.ndarray] = field(default_factory=list)
    leaves: list[np.ndarray] = field(default_factory=list)

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for feature, cut, leaf in zip(self.features, self.cuts, self.leaves, strict=True):
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[rows, feature[node]] > cut[node])
            out += leaf[node - (2**self.depth - 1)]
        return out

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -30, 30)))


def fit(x: np.ndarray, y: np.ndarray, trees: int = 40, depth: int = 4, rate: float = 0.3, bins: int = 32, ridge: float = 1.0, least: float = 2.0) -> Boosted:
    """Newton boosting of the logistic loss; ties between splits go to the first feature and cut."""
    n, d = x.shape
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(d)]
    binned = np.stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(edges)], 1)
    share = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    model = Boosted(depth, float(np.log(share / (1 - share))))
    margin = np.full(n, model.base)
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        grad, hess = p - y, np.maximum(p * (1 - p), 1e-6)
        size = 2**depth - 1
        feature, cut, node = np.zeros(size, np.int64), np.full(size, np.inf), np.zeros(n, np.int64)
        for level in range(depth):
            first, width = 2**level - 1, 2**level
            local = node - first
            best, at = np.full(width, 1e-9), np.full((width, 2), -1)
            for j in range(d):
                k = len(edges[j]) + 1
                if k == 1:
                    continue
                g, h = (np.bincount(local * k + binned[:, j], w, width * k).reshape(width, k).cumsum(1) for w in (grad, hess))
                gl, hl, gt, ht = g[:, :-1], h[:, :-1], g[:, -1:], h[:, -1:]
                gain = gl**2 / (hl + ridge) + (gt - gl) ** 2 / (ht - hl + ridge) - gt**2 / (ht + ridge)
                gain[(hl < least) | (ht - hl < least)] = 0
                top = gain.argmax(1)
                value = gain[np.arange(width), top]
                better = value > best
                best[better], at[better, 0], at[better, 1] = value[better], j, top[better]
            for i in range(width):
                if at[i, 0] >= 0:
                    feature[first + i], cut[first + i] = at[i, 0], edges[at[i, 0]][at[i, 1]]
            node = 2 * node + 1 + (x[np.arange(n), feature[node]] > cut[node])
        leaf = node - size
        g, h = (np.bincount(leaf, w, 2**depth) for w in (grad, hess))
        value = -rate * g / (h + ridge)
        margin = margin + value[leaf]
        model.features.append(feature)
        model.cuts.append(cut)
        model.leaves.append(value)
    return model
