"""Gradient-boosted trees for two classes, on numpy: histograms, complete trees of one depth, logistic loss."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Model:
    """feature, threshold: trees x inner nodes (a row goes right if its value is above); leaf: trees x leaves."""

    feature: np.ndarray
    threshold: np.ndarray
    leaf: np.ndarray
    base: float

    def margin(self, x: np.ndarray) -> np.ndarray:
        """Log-odds of the second class."""
        trees, depth = len(self.feature), int(np.log2(self.leaf.shape[1]))
        out = np.full(len(x), self.base)
        columns = np.arange(trees)[None]
        for at in range(0, len(x), 8192):
            part = x[at : at + 8192]
            rows = np.arange(len(part))[:, None]
            node = np.zeros((len(part), trees), np.int64)
            for _ in range(depth):
                right = part[rows, self.feature[columns, node]] > self.threshold[columns, node]
                node = 2 * node + 1 + right
            out[at : at + 8192] += self.leaf[columns, node - (2**depth - 1)].sum(1)
        return out


def fit(x: np.ndarray, y: np.ndarray, weight: np.ndarray, trees: int = 90, depth: int = 5, rate: float = 0.2, bins: int = 32, l2: float = 2.0, columns: float = 0.4, seed: int = 3) -> Model:
    """Newton boosting; splits by gain on at most ``bins`` quantile bins of a feature; a tree sees a share of the columns."""
    n, features = x.shape
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(features)]
    binned = np.stack([np.searchsorted(c, x[:, f], side="left") for f, c in enumerate(cuts)], axis=1)
    p = np.clip((weight * y).sum() / weight.sum(), 1e-6, 1 - 1e-6)
    base = float(np.log(p / (1 - p)))
    margin = np.full(n, base)
    inner = 2**depth - 1
    feature, threshold, leaf = np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf), np.zeros((trees, 2**depth))
    rng = np.random.default_rng(seed)
    for t in range(trees):
        seen = rng.choice(features, max(1, round(columns * features)), replace=False)
        prob = 1 / (1 + np.exp(-margin))
        g, h = weight * (y - prob), weight * prob * (1 - prob)
        node = np.zeros(n, np.int64)
        for level in range(depth):
            first, width = 2**level - 1, 2**level
            own = node - first
            best = np.zeros(width)
            where = np.zeros((width, 2), np.int64) - 1
            for f in seen:
                k = len(cuts[f]) + 1
                if k < 2:
                    continue
                key = own * k + binned[:, f]
                gs = np.bincount(key, g, width * k).reshape(width, k).cumsum(1)
                hs = np.bincount(key, h, width * k).reshape(width, k).cumsum(1)
                gl, hl, ga, ha = gs[:, :-1], hs[:, :-1], gs[:, -1:], hs[:, -1:]
                gain = gl**2 / (hl + l2) + (ga - gl) ** 2 / (ha - hl + l2) - ga**2 / (ha + l2)
                at = gain.argmax(1)
                value = gain[np.arange(width), at]
                better = value > best + 1e-9
                best[better], where[better, 0], where[better, 1] = value[better], f, at[better]
            right = np.zeros(n, bool)
            for w in range(width):
                f, cut = where[w]
                if f >= 0:
                    feature[t, first + w], threshold[t, first + w] = f, cuts[f][cut]
                    rows = own == w
                    right[rows] = binned[rows, f] > cut
            node = 2 * node + 1 + right
        own = node - inner
        gs, hs = np.bincount(own, g, 2**depth), np.bincount(own, h, 2**depth)
        leaf[t] = rate * gs / (hs + l2)
        margin += leaf[t][own]
    return Model(feature, threshold, leaf, base)
