"""Histogram gradient-boosted trees for a binary label, in numpy.

Trees are complete and stored as flat arrays (feature, threshold, leaf), so a
batch of rows goes down all trees by array indexing alone.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Forest:
    base: float
    feature: np.ndarray  # trees x (2**depth - 1)
    threshold: np.ndarray
    leaf: np.ndarray  # trees x 2**depth

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1."""
        inner, rows, tree = self.feature.shape[1], np.arange(len(x)), np.arange(len(self.feature))[:, None]
        node = np.zeros((len(self.feature), len(x)), np.int64)
        for _ in range(inner.bit_length()):  # all trees go down a level at once
            node = 2 * node + 1 + (x[rows, self.feature[tree, node]] > self.threshold[tree, node])
        total = self.base + self.leaf[tree, node - inner].sum(0)
        return 1 / (1 + np.exp(-total))


def fit(x: np.ndarray, y: np.ndarray, trees: int = 80, depth: int = 4, rate: float = 0.15, bins: int = 48, ridge: float = 2.0, least: int = 8) -> Forest:
    """Newton boosting of the logistic loss; ties between splits go to the lowest feature and
    bin.  No rows or one class alone give a forest without trees that says the prior."""
    n, m = x.shape
    prior = (y.sum() + 0.5) / (n + 1)
    base = float(np.log(prior / (1 - prior)))
    if n == 0 or y.min() == y.max():
        return Forest(base, np.zeros((0, 0), np.int64), np.zeros((0, 0)), np.zeros((0, 1)))
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1], method="lower")) for j in range(m)]
    binned = np.stack([np.searchsorted(c, x[:, j], "left") for j, c in enumerate(cuts)], 1)
    raw = np.full(n, base)
    inner = (1 << depth) - 1
    feature, threshold, leaf = np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf), np.zeros((trees, 1 << depth))
    for k in range(trees):
        p = 1 / (1 + np.exp(-raw))
        g, h = y - p, p * (1 - p)
        node = np.zeros(n, np.int64)
        for d in range(depth):
            first, width = (1 << d) - 1, 1 << d
            local = node - first
            gain = np.full((width, m, bins), -np.inf)
            for j in range(m):
                at = local * bins + binned[:, j]
                left = [np.bincount(at, w, width * bins).reshape(width, bins).cumsum(1) for w in (g, h, np.ones(n))]
                all_ = [a[:, -1:] for a in left]
                right = [a - b for a, b in zip(all_, left, strict=True)]
                value = left[0] ** 2 / (left[1] + ridge) + right[0] ** 2 / (right[1] + ridge) - all_[0] ** 2 / (all_[1] + ridge)
                ok = (left[2] >= least) & (right[2] >= least) & (np.arange(bins) < len(cuts[j]))
                gain[:, j] = np.where(ok, value, -np.inf)
            best = gain.reshape(width, -1).argmax(1)
            good = gain.reshape(width, -1)[np.arange(width), best] > 1e-6
            fs, bs = best // bins, best % bins
            for w in np.flatnonzero(good):
                feature[k, first + w], threshold[k, first + w] = fs[w], cuts[fs[w]][bs[w]]
            node = 2 * node + 1 + (x[np.arange(n), feature[k, node]] > threshold[k, node])
        at = node - inner
        leaf[k] = rate * np.bincount(at, g, 1 << depth) / (np.bincount(at, h, 1 << depth) + ridge)
        raw += leaf[k, at]
    return Forest(base, feature, threshold, leaf)
