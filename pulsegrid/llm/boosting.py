"""Histogram gradient-boosted trees for a yes/no label, scored as flat arrays.

Each statistic is cut into at most 64 bins by quantiles; trees grow level by level, the gain of
every (node, statistic, bin) coming from one histogram of gradients. All trees have the same depth
and lie in arrays level by level, so scoring is ``depth`` array steps over rows x trees.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

BINS = 64


@dataclass
class Trees:
    """Node k of a tree has children 2k+1 and 2k+2; rows with value > threshold go right."""

    feature: np.ndarray    # trees x inner nodes
    threshold: np.ndarray  # trees x inner nodes
    value: np.ndarray      # trees x leaves
    start: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 for each row of statistics."""
        trees, inner = self.feature.shape
        depth = (inner + 1).bit_length() - 1
        rows = np.arange(len(x))[:, None]
        tree = np.arange(trees)[None, :]
        node = np.zeros((len(x), trees), dtype=np.int64)
        for _ in range(depth):
            right = x[rows, self.feature[tree, node]] > self.threshold[tree, node]
            node = 2 * node + 1 + right
        margin = self.start + self.value[tree, node - inner].sum(axis=1)
        return 1.0 / (1.0 + np.exp(-np.clip(margin, -40, 40)))


def fit(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 4, rate: float = 0.15,
        smooth: float = 5.0, least: float = 5.0) -> Trees:
    """Logistic boosting; ``smooth`` shrinks leaves, ``least`` is the least weight of rows in a child."""
    n, m = x.shape if x.ndim == 2 else (0, 0)
    inner, leaves = 2 ** depth - 1, 2 ** depth
    feature = np.zeros((trees, inner), dtype=np.int64)
    threshold = np.full((trees, inner), np.inf)
    value = np.zeros((trees, leaves))
    mean = (float(y.sum()) + 1.0) / (n + 2.0)
    start = float(np.log(mean / (1.0 - mean)))
    if n == 0 or mean in (0.0, 1.0):
        return Trees(feature, threshold, value, start)

    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) for f in range(m)]
    binned = np.stack([np.searchsorted(cuts[f], x[:, f], side="left") for f in range(m)], axis=1)
    flat = binned + np.arange(m) * BINS
    margin = np.full(n, start)
    for t in range(trees):
        p = 1.0 / (1.0 + np.exp(-margin))
        gradient, hessian = y - p, p * (1.0 - p)
        node = np.zeros(n, dtype=np.int64)
        for level in range(depth):
            width = 2 ** level
            at = ((node - (width - 1))[:, None] * (m * BINS) + flat).ravel()
            g = np.bincount(at, np.repeat(gradient, m), width * m * BINS).reshape(width, m, BINS)
            h = np.bincount(at, np.repeat(hessian, m), width * m * BINS).reshape(width, m, BINS)
            gl, hl = g.cumsum(axis=2), h.cumsum(axis=2)
            ga, ha = gl[:, :, -1:], hl[:, :, -1:]
            gain = gl ** 2 / (hl + smooth) + (ga - gl) ** 2 / (ha - hl + smooth) - ga ** 2 / (ha + smooth)
            gain[(hl * 4 < least) | ((ha - hl) * 4 < least)] = 0.0
            best = gain.reshape(width, -1).argmax(axis=1)
            for k in range(width):
                f, b = divmod(int(best[k]), BINS)
                if gain[k, f, b] > 1e-9 and b < len(cuts[f]):
                    feature[t, width - 1 + k], threshold[t, width - 1 + k] = f, cuts[f][b]
            node = 2 * node + 1 + (x[np.arange(n), feature[t, node]] > threshold[t, node])
        leaf = node - inner
        value[t] = rate * np.bincount(leaf, gradient, leaves) / (np.bincount(leaf, hessian, leaves) + smooth)
        margin += value[t][leaf]
    return Trees(feature, threshold, value, start)
