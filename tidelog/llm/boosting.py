"""Gradient-boosted trees with logistic loss over binned dense features, and isotonic calibration.

Small and deterministic: it fits a bounded sample on the driver and scores Arrow batches on executors.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np


@dataclass
class BoostedTrees:
    """Trees of fixed depth as arrays: node k has children 2k + 1 and 2k + 2; a row goes right above the threshold."""

    trees: int = 60
    depth: int = 3
    rate: float = 0.2
    bins: int = 48
    ridge: float = 1.0
    base: float = 0.0
    feature: list[np.ndarray] = field(default_factory=list)
    threshold: list[np.ndarray] = field(default_factory=list)
    value: list[np.ndarray] = field(default_factory=list)

    def fit(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None) -> BoostedTrees:
        w = np.ones(len(y)) if weight is None else weight
        cuts = [np.unique(np.quantile(c, np.linspace(0, 1, self.bins + 1)[1:-1])) for c in x.T]
        binned = np.stack([np.searchsorted(c, v, side="left") for c, v in zip(cuts, x.T, strict=True)], axis=1)
        share = np.clip(np.average(y, weights=w), 1e-3, 1 - 1e-3)
        self.base = float(np.log(share / (1 - share)))
        margin = np.full(len(y), self.base)
        inner, leaves = 2**self.depth - 1, 2**self.depth
        for _ in range(self.trees):
            p = 1 / (1 + np.exp(-margin))
            grad, hess = w * (y - p), w * p * (1 - p)
            node = np.zeros(len(y), dtype=np.int64)
            feature, threshold = np.zeros(inner, dtype=np.int64), np.full(inner, np.inf)
            for level in range(self.depth):
                first, many = 2**level - 1, 2**level
                best = np.full(many, 1e-6)
                where = np.full(many, -1)
                cut_at = np.zeros(many, dtype=np.int64)
                for f, c in enumerate(cuts):
                    if not len(c):
                        continue
                    width = len(c) + 1
                    slot = (node - first) * width + binned[:, f]
                    g = np.bincount(slot, grad, many * width).reshape(many, width).cumsum(1)
                    h = np.bincount(slot, hess, many * width).reshape(many, width).cumsum(1)
                    score = lambda a, b: a * a / (b + self.ridge)
                    gain = score(g, h)[:, :-1] + score(g[:, -1:] - g, h[:, -1:] - h)[:, :-1] - score(g, h)[:, -1:]
                    at = gain.argmax(axis=1)
                    top = gain[np.arange(many), at]
                    better = top > best
                    best[better], where[better], cut_at[better] = top[better], f, at[better]
                for k in np.flatnonzero(where >= 0):
                    feature[first + k], threshold[first + k] = where[k], cuts[where[k]][cut_at[k]]
                node = self._down(x, node, feature, threshold)
            slot = node - inner
            value = self.rate * np.bincount(slot, grad, leaves) / (np.bincount(slot, hess, leaves) + self.ridge)
            margin += value[slot]
            self.feature.append(feature)
            self.threshold.append(threshold)
            self.value.append(value)
        return self

    @staticmethod
    def _down(x, node, feature, threshold):
        return 2 * node + 1 + (x[np.arange(len(x)), feature[node]] > threshold[node])

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        inner = 2**self.depth - 1
        for feature, threshold, value in zip(self.feature, self.threshold, self.value, strict=True):
            node = np.zeros(len(x), dtype=np.int64)
            for _ in range(self.depth):
                node = self._down(x, node, feature, threshold)
            out += value[node - inner]
        return out


def isotonic(margin: np.ndarray, y: np.ndarray, row_weight: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Knots (margin, probability) of the non-decreasing least-squares fit, by pooling adjacent violators."""
    points, inverse = np.unique(margin, return_inverse=True)
    w = np.ones(len(y)) if row_weight is None else row_weight
    weight = np.bincount(inverse, w)
    mean = np.bincount(inverse, w * y) / weight
    blocks: list[list[float]] = []  # mean, weight, first point, last point
    for m, w, p in zip(mean, weight, points, strict=True):
        blocks.append([m, w, p, p])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            m2, w2, _, hi = blocks.pop()
            m1, w1, lo, _ = blocks.pop()
            blocks.append([(m1 * w1 + m2 * w2) / (w1 + w2), w1 + w2, lo, hi])
    return np.array([b[i] for b in blocks for i in (2, 3)]), np.array([b[0] for b in blocks for _ in (2, 3)])
