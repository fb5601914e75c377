"""Gradient-boosted regression trees for a yes/no target, on binned features."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

BINS = 48


@dataclass
class Trees:
    """Per tree: for each inner node the feature and the bin up to which rows go left; values of the leaves."""

    edges: list[np.ndarray]
    feature: np.ndarray
    cut: np.ndarray
    value: np.ndarray
    base: float

    def binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(self.edges)], axis=1).astype(np.uint8)

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        rows, bins = np.arange(len(x)), self.binned(x)
        out = np.full(len(x), self.base)
        depth = int(np.log2(self.value.shape[1]))
        for feature, cut, value in zip(self.feature, self.cut, self.value, strict=True):
            node = np.zeros(len(x), np.int64)
            for _ in range(depth):
                node = 2 * node + 1 + (bins[rows, feature[node]] > cut[node])
            out += value[node - (len(value) - 1)]
        return out


def fit(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 4, rate: float = 0.2, penalty: float = 2.0) -> Trees:
    """Trees of equal depth, each fitted to the gradient of the logistic loss with second-order gains."""
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS)[1:-1])) for j in range(x.shape[1])]
    mean = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    model = Trees(edges, np.zeros((trees, 2**depth - 1), np.int64), np.full((trees, 2**depth - 1), 255), np.zeros((trees, 2**depth)), float(np.log(mean / (1 - mean))))
    bins, n_features = model.binned(x), x.shape[1]
    score = np.full(len(y), model.base)
    offset = np.arange(n_features) * BINS
    for t in range(trees):
        p = 1 / (1 + np.exp(-score))
        slope, curve = y - p, p * (1 - p)
        node = np.zeros(len(y), np.int64)
        for level in range(depth):
            first = 2**level - 1
            size = n_features * BINS
            at = ((node - first)[:, None] * size + offset + bins).ravel()
            g = np.bincount(at, np.repeat(slope, n_features), 2**level * size).reshape(2**level, n_features, BINS).cumsum(axis=2)
            h = np.bincount(at, np.repeat(curve, n_features), 2**level * size).reshape(2**level, n_features, BINS).cumsum(axis=2)
            gain = g**2 / (h + penalty) + (g[:, :, -1:] - g) ** 2 / (h[:, :, -1:] - h + penalty)
            best = gain.reshape(2**level, -1).argmax(axis=1)
            model.feature[t, first : first + 2**level] = best // BINS
            model.cut[t, first : first + 2**level] = best % BINS
            node = 2 * node + 1 + (bins[np.arange(len(y)), model.feature[t, node]] > model.cut[t, node])
        leaf = node - (2**depth - 1)
        model.value[t] = rate * np.bincount(leaf, slope, 2**depth) / (np.bincount(leaf, curve, 2**depth) + penalty)
        score += model.value[t][leaf]
    return model
