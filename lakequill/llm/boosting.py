"""Gradient-boosted regression trees for a yes/no label, in numpy."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class Forest:
    """Trees as complete binary heaps: feature and threshold of inner places, value of leaves."""

    feature: np.ndarray
    cut: np.ndarray
    value: np.ndarray
    start: float
    depth: int

    def probability(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.start)
        rows = np.arange(len(x))
        for feature, cut, value in zip(self.feature, self.cut, self.value):
            at = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                at = 2 * at + 1 + (x[rows, feature[at]] > cut[at])
            total += value[at - (2**self.depth - 1)]
        return 1.0 / (1.0 + np.exp(-np.clip(total, -30, 30)))


def fit_trees(x: np.ndarray, y: np.ndarray, rounds: int = 60, depth: int = 4, rate: float = 0.2, bins: int = 24, ridge: float = 1.0) -> Forest:
    """Second-order boosting on histograms of quantile bins."""
    n, width = x.shape
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(width)]
    code = np.stack([np.searchsorted(e, x[:, f], "left") for f, e in enumerate(edges)], axis=1)
    share = np.clip(y.mean() if n else 0.5, 1e-3, 1 - 1e-3)
    start = float(np.log(share / (1 - share)))
    score = np.full(n, start)
    inner, leaves = 2**depth - 1, 2**depth
    features, cuts, values = [], [], []
    for _ in range(rounds):
        p = 1.0 / (1.0 + np.exp(-score))
        slope, bend = y - p, p * (1 - p)
        feature, cut = np.zeros(inner, np.int64), np.full(inner, np.inf)
        at = np.zeros(n, np.int64)
        for level in range(depth):
            for node in range(2**level - 1, 2 ** (level + 1) - 1):
                rows = np.flatnonzero(at == node)
                if len(rows) < 20:
                    continue
                g, h = slope[rows], bend[rows]
                whole, best = g.sum() ** 2 / (h.sum() + ridge), 1e-6
                for f in range(width):
                    if not len(edges[f]):
                        continue
                    gs = np.cumsum(np.bincount(code[rows, f], g, len(edges[f]) + 1))[:-1]
                    hs = np.cumsum(np.bincount(code[rows, f], h, len(edges[f]) + 1))[:-1]
                    gain = gs**2 / (hs + ridge) + (g.sum() - gs) ** 2 / (h.sum() - hs + ridge) - whole
                    k = int(np.argmax(gain))
                    if gain[k] > best:
                        best, feature[node], cut[node] = gain[k], f, edges[f][k]
            at = 2 * at + 1 + (x[np.arange(n), feature[at]] > cut[at])
        leaf = at - inner
        value = rate * np.bincount(leaf, slope, leaves) / (np.bincount(leaf, bend, leaves) + ridge)
        score += value[leaf]
        features.append(feature)
        cuts.append(cut)
        values.append(value)
    return Forest(np.array(features).reshape(-1, inner), np.array(cuts).reshape(-1, inner), np.array(values).reshape(-1, leaves), start, depth)
