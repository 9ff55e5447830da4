"""Gradient-boosted regression trees on a logistic loss, for small training tables."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

BINS = 32


@dataclass
class Trees:
    """Complete binary trees of one depth: feature and threshold of each inner node, value of each leaf."""

    start: float
    feature: np.ndarray  # trees x inner nodes
    threshold: np.ndarray
    value: np.ndarray  # trees x leaves

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.start)
        rows = np.arange(len(x))
        inner = self.feature.shape[1]
        for f, t, v in zip(self.feature, self.threshold, self.value):
            node = np.zeros(len(x), np.int64)
            while inner and node[:1].size and node[0] < inner:
                node = 2 * node + 1 + (x[rows, f[node]] > t[node])
            out += v[node - inner]
        return out


def grow(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 4, rate: float = 0.2, penalty: float = 2.0, least: float = 8.0) -> Trees:
    """Fits y in {0, 1}. Splits are at quantiles of the features."""
    edges = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) for c in x.T]
    binned = np.stack([np.searchsorted(e, c, "left") for e, c in zip(edges, x.T)], axis=1)
    mean = min(max(float(y.mean()), 1e-3), 1 - 1e-3)
    start = float(np.log(mean / (1 - mean)))
    inner = (1 << depth) - 1
    feature, threshold, value = np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf), np.zeros((trees, inner + 1))
    score = np.full(len(y), start)
    for k in range(trees):
        p = 1 / (1 + np.exp(-score))
        g, h = y - p, p * (1 - p)
        node = np.zeros(len(y), np.int64)
        for level in range(depth):
            first, width = (1 << level) - 1, 1 << level
            best = np.full(width, 1e-6)
            for f, e in enumerate(edges):
                if not len(e):
                    continue
                cell = (node - first) * (BINS + 1) + binned[:, f]
                left_g = np.bincount(cell, g, width * (BINS + 1)).reshape(width, -1).cumsum(axis=1)
                left_h = np.bincount(cell, h, width * (BINS + 1)).reshape(width, -1).cumsum(axis=1)
                all_g, all_h = left_g[:, -1:], left_h[:, -1:]
                gain = left_g**2 / (left_h + penalty) + (all_g - left_g) ** 2 / (all_h - left_h + penalty) - all_g**2 / (all_h + penalty)
                gain[(left_h < least / 8) | (all_h - left_h < least / 8)] = 0
                gain = gain[:, : len(e)]
                at = gain.argmax(axis=1)
                top = gain[np.arange(width), at]
                better = top > best
                best[better] = top[better]
                feature[k, first : first + width][better] = f
                threshold[k, first : first + width][better] = e[at[better]]
            node = 2 * node + 1 + (x[np.arange(len(y)), feature[k, node]] > threshold[k, node])
        leaf = node - inner
        value[k] = rate * np.bincount(leaf, g, inner + 1) / (np.bincount(leaf, h, inner + 1) + penalty)
        score += value[k, leaf]
    return Trees(start, feature, threshold, value)
