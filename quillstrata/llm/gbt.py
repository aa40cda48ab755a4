"""Gradient-boosted trees for two classes: histogram splits, Newton leaves, trees of a fixed depth."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Trees:
    depth: int
    bias: float
    feature: np.ndarray  # trees x (2**depth - 1), in heap order
    bound: np.ndarray  # right if the value is greater
    leaf: np.ndarray  # trees x 2**depth

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.bias)
        rows = np.arange(len(x))
        for f, b, leaf in zip(self.feature, self.bound, self.leaf, strict=True):
            at = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                at = 2 * at + 1 + (x[rows, f[at]] > b[at])
            out += leaf[at - (1 << self.depth) + 1]
        return out


def fit(x: np.ndarray, y: np.ndarray, weight: np.ndarray, trees: int = 50, depth: int = 4, rate: float = 0.25, bins: int = 32, ridge: float = 2.0) -> Trees:
    """Boosted trees on rows ``x`` with labels 0 and 1."""
    n, m = x.shape
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(m)]
    cuts = [c[c < x[:, j].max()] for j, c in enumerate(cuts)]
    sizes = np.array([len(c) + 1 for c in cuts])
    starts = np.concatenate(([0], np.cumsum(sizes)[:-1]))  # the bins of all features lie side by side
    wide = int(sizes.sum())
    binned = np.stack([np.searchsorted(c, x[:, j], "left") for j, c in enumerate(cuts)], axis=1) + starts
    bound_of = np.concatenate([np.append(c, np.inf) for c in cuts])
    feature_of = np.repeat(np.arange(m), sizes)
    ends = starts + sizes - 1
    p = float((weight * y).sum() / weight.sum())
    bias = float(np.log(p / (1 - p)))
    score = np.full(n, bias)
    nodes = (1 << depth) - 1
    features, bounds, leaves = [], [], []
    for _ in range(trees):
        q = 1 / (1 + np.exp(-score))
        g, h = weight * (q - y), weight * q * (1 - q)
        f, b = np.zeros(nodes, np.int64), np.full(nodes, np.inf)
        at = np.zeros(n, np.int64)
        for level in range(depth):
            first, width = (1 << level) - 1, 1 << level
            key = ((at - first)[:, None] * wide + binned).ravel()
            hg = np.bincount(key, np.repeat(g, m), width * wide).reshape(width, wide)
            hh = np.bincount(key, np.repeat(h, m), width * wide).reshape(width, wide)
            lg, lh = hg.cumsum(1), hh.cumsum(1)
            tg, th = (c[:, ends[0]][:, None] for c in (lg, lh))  # any one feature's bins hold all rows
            lg -= np.repeat(np.concatenate((np.zeros((width, 1)), lg[:, ends[:-1]]), axis=1), sizes, axis=1)
            lh -= np.repeat(np.concatenate((np.zeros((width, 1)), lh[:, ends[:-1]]), axis=1), sizes, axis=1)
            gain = lg**2 / (lh + ridge) + (tg - lg) ** 2 / (th - lh + ridge) - tg**2 / (th + ridge)
            gain = np.where((lh > 1) & (th - lh > 1), gain, 0)
            gain[:, ends] = 0
            k = gain.argmax(1)
            better = gain[np.arange(width), k] > 1e-9
            f[first : first + width][better] = feature_of[k[better]]
            b[first : first + width][better] = bound_of[k[better]]
            at = 2 * at + 1 + (x[np.arange(n), f[at]] > b[at])
        end = at - nodes
        leaf = -rate * np.bincount(end, g, 1 << depth) / (np.bincount(end, h, 1 << depth) + ridge)
        score += leaf[end]
        features.append(f)
        bounds.append(b)
        leaves.append(leaf)
    return Trees(depth, bias, np.array(features), np.array(bounds), np.array(leaves))
