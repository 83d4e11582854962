"""Gradient-boosted trees on histograms, kept as flat arrays and walked by numpy for all rows and trees at once."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class Forest:
    """Complete trees of one depth: node ``i`` has children ``2i + 1`` and ``2i + 2``; unused nodes send all rows left."""

    feature: np.ndarray  # trees x (2^depth - 1)
    threshold: np.ndarray  # the same shape; larger values go right
    leaf: np.ndarray  # trees x 2^depth
    start: float

    def raw_score(self, x: np.ndarray) -> np.ndarray:
        trees, inner = self.feature.shape
        if not trees or not len(x):
            return np.full(len(x), self.start)
        node = np.zeros((len(x), trees), np.int64)
        row, tree = np.arange(len(x))[:, None], np.arange(trees)[None, :]
        while node[0, 0] < inner:
            node = 2 * node + 1 + (x[row, self.feature[tree, node]] > self.threshold[tree, node])
        return self.start + self.leaf[tree, node - inner].sum(axis=1)

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw_score(x), -40, 40)))


def _cuts(column: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(column, np.linspace(0, 1, bins + 1)[1:-1], method="lower"))


def fit(x: np.ndarray, y: np.ndarray, trees: int = 80, depth: int = 4, rate: float = 0.15, bins: int = 64, l2: float = 2.0, least: float = 3.0, monotone: dict[int, int] | None = None) -> Forest:
    """Boost logistic loss. ``monotone`` maps a feature to +1 (score may only rise with it) or -1 (only fall).

    A split that breaks its direction is refused; below a constrained split the children's leaf values stay on their side of
    the middle value, so the whole tree is monotonic. No rows, or one class only, give a constant.
    """
    n, width = x.shape
    inner = 2**depth - 1
    mean = float(np.clip(y.mean(), 1e-3, 1 - 1e-3)) if n else 0.5
    start = float(np.log(mean / (1 - mean)))
    if n < 2 * least or y.min() == y.max():
        return Forest(np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, inner + 1)), start)
    cuts = [_cuts(x[:, j], bins) for j in range(width)]
    binned = np.stack([np.searchsorted(cuts[j], x[:, j], side="left") for j in range(width)], axis=1)
    cells = binned + np.arange(width) * bins
    sign = np.zeros(width)
    for j, direction in (monotone or {}).items():
        sign[j] = direction
    score = np.full(n, start)
    all_features, all_thresholds, all_leaves = [], [], []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-score))
        grad, hess = p - y, p * (1 - p)
        feature, threshold, leaf = np.zeros(inner, np.int64), np.full(inner, np.inf), np.zeros(inner + 1)
        node = np.zeros(n, np.int64)
        bounds = {0: (-np.inf, np.inf)}
        for at in range(inner):
            rows = np.flatnonzero(node == at)
            low, high = bounds[at]
            bounds[2 * at + 1] = bounds[2 * at + 2] = (low, high)
            goes_right = np.zeros(len(rows), bool)
            if len(rows) >= 2 * least:
                flat, g, h = cells[rows].ravel(), grad[rows], hess[rows]
                gs, hs, ns = (np.bincount(flat, np.repeat(v, width), minlength=width * bins).reshape(width, bins).cumsum(1) for v in (g, h, np.ones(len(rows))))
                gt, ht, nt = g.sum(), h.sum(), len(rows)
                value = lambda a, b: np.clip(-a / (b + l2), low, high)
                gain_of = lambda a, b, w: -(2 * a * w + (b + l2) * w * w)
                left, right = value(gs, hs), value(gt - gs, ht - hs)
                gain = gain_of(gs, hs, left) + gain_of(gt - gs, ht - hs, right) - gain_of(gt, ht, value(gt, ht))
                gain[(ns < least) | (nt - ns < least) | (sign[:, None] * (right - left) < 0)] = -np.inf
                best = int(gain.argmax())
                j, b = divmod(best, bins)
                if gain[j, b] > 1e-6 and b < len(cuts[j]):
                    feature[at], threshold[at] = j, cuts[j][b]
                    goes_right = binned[rows, j] > b
                    if sign[j]:
                        middle = (left[j, b] + right[j, b]) / 2
                        below, above = (low, middle), (middle, high)
                        bounds[2 * at + 1], bounds[2 * at + 2] = (below, above) if sign[j] > 0 else (above, below)
            node[rows] = 2 * at + 1 + goes_right
        place = node - inner
        g, h = np.bincount(place, grad, inner + 1), np.bincount(place, hess, inner + 1)
        limits = np.array([bounds[inner + k] for k in range(inner + 1)])
        leaf = rate * np.clip(-g / (h + l2), limits[:, 0], limits[:, 1])
        leaf[np.bincount(place, minlength=inner + 1) == 0] = 0.0
        score += leaf[place]
        all_features.append(feature)
        all_thresholds.append(threshold)
        all_leaves.append(leaf)
    return Forest(np.array(all_features), np.array(all_thresholds), np.array(all_leaves), start)
