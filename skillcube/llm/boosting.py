"""Histogram gradient-boosted trees for two classes, trained with numpy on the driver from a bounded sample.

Trees are complete and flat: node i has children 2i+1 (value <= threshold) and 2i+2, so a model is three arrays
and all trees are walked for all rows at once. A node that is not worth splitting has an infinite threshold.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Trees:
    feature: np.ndarray  # int32[trees, nodes]
    threshold: np.ndarray  # float64[trees, nodes]
    value: np.ndarray  # float64[trees, leaves]
    base: float
    depth: int

    def margin(self, x: np.ndarray) -> np.ndarray:
        """Log-odds of rows."""
        rows, trees = np.arange(len(x))[:, None], np.arange(len(self.feature))[None, :]
        node = np.zeros((len(x), len(self.feature)), np.int64)
        for _ in range(self.depth if len(self.feature) else 0):
            node = 2 * node + 1 + (x[rows, self.feature[trees, node]] > self.threshold[trees, node])
        return self.base + self.value[trees, node - (2**self.depth - 1)].sum(1) if len(self.feature) else np.full(len(x), self.base)

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of class 1."""
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -500, 500)))


def fit(x: np.ndarray, y: np.ndarray, trees: int = 80, depth: int = 4, rate: float = 0.15, bins: int = 64, least: float = 5.0, ridge: float = 1.0) -> Trees:
    """Log-loss boosting on quantile bins. With no rows or one class the model is the smoothed rate alone."""
    n = len(y)
    p = (y.sum() + 0.5) / (n + 1)
    base, inner, leaves = float(np.log(p / (1 - p))), 2**depth - 1, 2**depth
    if n == 0 or y.min() == y.max():
        return Trees(np.zeros((0, inner), np.int32), np.zeros((0, inner)), np.zeros((0, leaves)), base, depth)
    d = x.shape[1]
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(d)]
    code = np.stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(edges)], 1).astype(np.int64)
    width = bins
    flat = code + np.arange(d) * width
    features, thresholds, values = [], [], []
    margin = np.full(n, base)
    for _ in range(trees):
        prob = 1 / (1 + np.exp(-margin))
        g, h = y - prob, prob * (1 - prob)
        node = np.zeros(n, np.int64)
        feature, threshold = np.zeros(inner, np.int32), np.full(inner, np.inf)
        for level in range(depth):
            first, many = 2**level - 1, 2**level
            key = ((node - first)[:, None] * (d * width) + flat).ravel()
            gs = np.bincount(key, np.repeat(g, d), many * d * width).reshape(many, d, width).cumsum(2)
            hs = np.bincount(key, np.repeat(h, d), many * d * width).reshape(many, d, width).cumsum(2)
            gt, ht = gs[:, :, -1:], hs[:, :, -1:]
            gain = gs**2 / (hs + ridge) + (gt - gs) ** 2 / (ht - hs + ridge) - gt**2 / (ht + ridge)
            gain[(hs < least / 10) | (ht - hs < least / 10)] = -1
            for k in range(many):
                j, b = divmod(int(gain[k].argmax()), width)
                if gain[k, j, b] > 1e-6 and b < len(edges[j]):
                    feature[first + k], threshold[first + k] = j, edges[j][b]
            node = 2 * node + 1 + (x[np.arange(n), feature[node]] > threshold[node])
        leaf = node - inner
        value = rate * np.bincount(leaf, g, leaves) / (np.bincount(leaf, h, leaves) + ridge)
        margin = margin + value[leaf]
        features.append(feature)
        thresholds.append(threshold)
        values.append(value)
    return Trees(np.array(features), np.array(thresholds), np.array(values), base, depth)
