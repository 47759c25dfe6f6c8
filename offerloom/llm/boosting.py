"""Histogram gradient-boosted trees for two classes.

Trees are complete binary trees of a fixed depth, flattened into arrays (tree, node); node i has
children 2i + 1 and 2i + 2. A node that is not worth splitting sends every row to the left."""
from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class Trees:
    base: float
    feature: np.ndarray    # (trees, inner nodes) int16
    threshold: np.ndarray  # (trees, inner nodes) float32; greater values go to the right
    value: np.ndarray      # (trees, leaves) float32

    def margin(self, x: np.ndarray) -> np.ndarray:
        """Log odds of class 1 for the rows of x: all rows go down one level at a time."""
        x = np.ascontiguousarray(x, np.float32)
        out, rows = np.full(len(x), self.base), np.arange(len(x))
        inner = self.feature.shape[1]
        depth = (inner + 1).bit_length() - 1
        for f, t, v in zip(self.feature, self.threshold, self.value):
            at = np.zeros(len(x), np.int64)
            for _ in range(depth):
                at = 2 * at + 1 + (x[rows, f[at]] > t[at])
            out += v[at - inner]
        return out

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -30, 30)))


def _edges(column: np.ndarray, bins: int) -> np.ndarray:
    """Upper bounds of the bins, halfway between neighbouring values."""
    values = np.unique(column)
    if len(values) > bins:
        values = np.unique(np.quantile(column, np.linspace(0, 1, bins + 1), method="nearest"))
    return ((values[1:].astype(np.float64) + values[:-1]) / 2).astype(np.float32)


def fit(x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None, trees: int = 60, depth: int = 4, rate: float = 0.15,
        bins: int = 64, ridge: float = 2.0, least: float = 8.0) -> Trees:
    """Second-order boosting of the logistic loss. `least` is the smallest weight of a leaf. With
    no rows, or rows of one class, the result is the constant of that prior."""
    n, d = (len(x), x.shape[1]) if x.ndim == 2 else (0, 1)
    w = np.ones(n) if weight is None else np.asarray(weight, float)
    y = np.asarray(y, float)
    prior = (float((w * y).sum()) + 1) / (float(w.sum()) + 2)
    base, inner = float(np.log(prior / (1 - prior))), 2 ** depth - 1
    if n == 0 or y.min() == y.max():
        return Trees(base, np.zeros((0, inner), np.int16), np.zeros((0, inner), np.float32), np.zeros((0, inner + 1), np.float32))
    x = np.ascontiguousarray(x, np.float32)
    edges = [_edges(x[:, j], bins) for j in range(d)]
    binned = np.stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(edges)], axis=1)
    margin = np.full(n, base)
    feature, threshold = np.zeros((trees, inner), np.int16), np.full((trees, inner), np.inf, np.float32)
    value = np.zeros((trees, inner + 1), np.float32)
    for t in range(trees):
        p = 1 / (1 + np.exp(-margin))
        grad, hess = w * (p - y), w * p * (1 - p)
        node = np.zeros(n, np.int64)  # within its level
        for level in range(depth):
            nodes, first = 2 ** level, 2 ** level - 1
            total_g, total_h = np.bincount(node, grad, nodes), np.bincount(node, hess, nodes)
            total_w = np.bincount(node, w, nodes)
            best, where = np.full(nodes, 1e-6), np.full((nodes, 2), -1)
            for j in range(d):
                size = len(edges[j]) + 1
                if size < 2:
                    continue
                key = node * size + binned[:, j]
                g, h, c = (np.bincount(key, a, nodes * size).reshape(nodes, size).cumsum(axis=1)[:, :-1] for a in (grad, hess, w))
                rg, rh, rc = total_g[:, None] - g, total_h[:, None] - h, total_w[:, None] - c
                gain = g * g / (h + ridge) + rg * rg / (rh + ridge) - (total_g ** 2 / (total_h + ridge))[:, None]
                gain = np.where((c >= least) & (rc >= least), gain, -1)
                k = gain.argmax(axis=1)
                better = gain[np.arange(nodes), k] > best
                best = np.where(better, gain[np.arange(nodes), k], best)
                where[better] = np.stack([np.full(nodes, j), k], axis=1)[better]
            split = where[:, 0] >= 0
            f, k = np.where(split, where[:, 0], 0), np.where(split, where[:, 1], 0)
            feature[t, first:first + nodes] = f
            threshold[t, first:first + nodes] = [edges[a][b] if s else np.inf for a, b, s in zip(f, k, split)]
            right = split[node] & (binned[np.arange(n), f[node]] > k[node])
            node = 2 * node + right
        leaf_g, leaf_h = np.bincount(node, grad, inner + 1), np.bincount(node, hess, inner + 1)
        value[t] = -rate * leaf_g / (leaf_h + ridge)
        margin += value[t][node]
    return Trees(base, feature, threshold, value)
