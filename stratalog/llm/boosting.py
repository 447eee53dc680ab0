"""Gradient-boosted trees for a yes-or-no label, on binned features, in numpy."""

from __future__ import annotations

from typing import NamedTuple

import numpy as np


class Trees(NamedTuple):
    """Complete trees of one depth: feature and threshold of each inner node, value of each leaf; edge: the prior's logit."""

    feature: np.ndarray
    threshold: np.ndarray
    value: np.ndarray
    edge: float

    def logits(self, x: np.ndarray) -> np.ndarray:
        depth = int(np.log2(self.value.shape[1]))
        out = np.full(len(x), self.edge)
        rows = np.arange(len(x))
        for feature, threshold, value in zip(self.feature, self.threshold, self.value, strict=True):
            node = np.zeros(len(x), np.int64)
            for _ in range(depth):
                node = 2 * node + 1 + (x[rows, feature[node]] > threshold[node])
            out += value[node - (len(value) - 1)]
        return out


def fit(x: np.ndarray, y: np.ndarray, weight: np.ndarray, trees: int = 60, depth: int = 4, rate: float = 0.2, bins: int = 24, smooth: float = 2.0) -> Trees:
    """Trees by Newton steps on the logistic loss; each split is the best of all features' quantile edges."""
    n, f = x.shape
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(f)]
    code = np.column_stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)])
    flat = code + np.arange(f) * bins
    prior = float(np.average(y, weights=weight))
    start = float(np.log(prior / (1 - prior)))
    score = np.full(n, start)
    features, thresholds, values = [], [], []
    inner = (1 << depth) - 1
    for _ in range(trees):
        p = 1 / (1 + np.exp(-score))
        g, h = weight * (y - p), weight * p * (1 - p)
        node = np.zeros(n, np.int64)
        feature, threshold = np.zeros(inner, np.int64), np.full(inner, np.inf)
        for level in range(depth):
            first, count = (1 << level) - 1, 1 << level
            place = ((node - first)[:, None] * (f * bins) + flat).ravel()
            sums = [np.bincount(place, weights=np.repeat(v, f), minlength=count * f * bins).reshape(count, f, bins).cumsum(axis=2) for v in (g, h)]
            gl, hl = sums
            gt, ht = gl[:, :, -1:], hl[:, :, -1:]
            gain = gl**2 / (hl + smooth) + (gt - gl) ** 2 / (ht - hl + smooth) - gt**2 / (ht + smooth)
            for j, e in enumerate(edges):
                gain[:, j, len(e) :] = -1
            best = gain.reshape(count, -1).argmax(axis=1)
            j, b = best // bins, best % bins
            for k in range(count):
                if gain[k, j[k], b[k]] > 1e-6:
                    feature[first + k], threshold[first + k] = j[k], edges[j[k]][b[k]]
            node = 2 * node + 1 + (x[np.arange(n), feature[node]] > threshold[node])
        leaf = node - inner
        value = rate * np.bincount(leaf, weights=g, minlength=inner + 1) / (np.bincount(leaf, weights=h, minlength=inner + 1) + smooth)
        score += value[leaf]
        features.append(feature)
        thresholds.append(threshold)
        values.append(value)
    return Trees(np.array(features), np.array(thresholds), np.array(values), start)
