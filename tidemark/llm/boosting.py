"""Gradient-boosted trees for two classes on binned features."""

from __future__ import annotations

import numpy as np


class BoostedTrees:
    """Trees of fixed depth on quantile bins, grown by second-order gains of the logistic loss."""

    def __init__(self, trees: int = 80, depth: int = 3, rate: float = 0.15, bins: int = 48, shrink: float = 2.0, least: float = 1.0):
        self.trees, self.depth, self.rate, self.bins, self.shrink, self.least = trees, depth, rate, bins, shrink, least
        self.base, self.grown = 0.0, []

    def fit(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        n, width = x.shape
        self.edges = []
        for k in range(width):
            # Quantiles of the values that occur, so that a feature that is mostly zero keeps its bins.
            values = np.unique(x[:, k])
            inner = values if len(values) <= self.bins else np.unique(np.quantile(values, np.linspace(0, 1, self.bins + 1)))
            self.edges.append((inner[:-1] + inner[1:]) / 2 if len(inner) > 1 else np.empty(0))
        binned = np.stack([np.searchsorted(e, x[:, k], side="left") for k, e in enumerate(self.edges)], axis=1)
        share = (y.sum() + 0.5) / (n + 1)
        self.base = float(np.log(share / (1 - share)))
        margin, size = np.full(n, self.base), self.bins + 1
        self.grown = []
        for _ in range(self.trees):
            p = 1 / (1 + np.exp(-margin))
            gradient, hessian = p - y, np.maximum(p * (1 - p), 1e-9)
            node, splits = np.zeros(n, np.int64), []
            for level in range(self.depth):
                count = 1 << level
                feature, place = np.full(count, -1), np.zeros(count, np.int64)
                best = np.full(count, 1e-6)
                for k in range(width):
                    cell = node * size + binned[:, k]
                    g = np.cumsum(np.bincount(cell, gradient, count * size).reshape(count, size), axis=1)
                    h = np.cumsum(np.bincount(cell, hessian, count * size).reshape(count, size), axis=1)
                    all_g, all_h = g[:, -1:], h[:, -1:]
                    gain = g**2 / (h + self.shrink) + (all_g - g) ** 2 / (all_h - h + self.shrink) - all_g**2 / (all_h + self.shrink)
                    gain[(h < self.least) | (all_h - h < self.least)] = 0
                    at = gain.argmax(axis=1)
                    better = gain[np.arange(count), at] > best
                    best[better], feature[better], place[better] = gain[np.arange(count), at][better], k, at[better]
                splits.append((feature, place))
                own = feature[node]
                right = (own >= 0) & (binned[np.arange(n), np.maximum(own, 0)] > place[node])
                node = 2 * node + right
            leaves = 1 << self.depth
            value = -np.bincount(node, gradient, leaves) / (np.bincount(node, hessian, leaves) + self.shrink) * self.rate
            margin += value[node]
            self.grown.append((splits, value))
        return self

    def margin(self, x: np.ndarray) -> np.ndarray:
        binned = np.stack([np.searchsorted(e, x[:, k], side="left") for k, e in enumerate(self.edges)], axis=1)
        out, rows = np.full(len(x), self.base), np.arange(len(x))
        for splits, value in self.grown:
            node = np.zeros(len(x), np.int64)
            for feature, place in splits:
                own = feature[node]
                node = 2 * node + ((own >= 0) & (binned[rows, np.maximum(own, 0)] > place[node]))
            out += value[node]
        return out
