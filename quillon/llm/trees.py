"""Gradient-boosted trees on binned dense features, and isotonic calibration, in numpy."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


@dataclass
class BoostedTrees:
    """Logistic boosting with complete trees of a fixed depth. A node sends a row right where its feature exceeds the threshold."""

    trees: int = 60
    depth: int = 3
    rate: float = 0.15
    bins: int = 48
    ridge: float = 1.0
    least: float = 8.0
    base: float = 0.0
    splits: list[tuple[np.ndarray, np.ndarray]] = field(default_factory=list)
    leaves: list[np.ndarray] = field(default_factory=list)

    def fit(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> BoostedTrees:
        rate = float((y * weight).sum() / weight.sum())
        self.base = float(np.log(max(rate, 1e-6) / max(1 - rate, 1e-6)))
        cuts = [np.unique(np.quantile(c, np.linspace(0, 1, self.bins)[1:-1])) for c in x.T]
        cuts = [np.unique(np.append(c, 0.0)) for c in cuts]  # most features are 0 in most texts
        binned = np.stack([np.searchsorted(c, col, "left") for c, col in zip(cuts, x.T, strict=True)])
        raw = np.full(len(y), self.base)
        wide = self.bins + 2
        for _ in range(self.trees):
            p = sigmoid(raw)
            grad, hess = weight * (p - y), weight * np.maximum(p * (1 - p), 1e-6)
            node = np.zeros(len(y), np.int64)
            features, thresholds = np.zeros(2**self.depth - 1, np.int64), np.full(2**self.depth - 1, np.inf)
            for level in range(self.depth):
                n = 2**level
                best = np.full(n, 1e-9)
                chosen = np.zeros((n, 2), np.int64) - 1
                for f, b in enumerate(binned):
                    at = node * wide + b
                    g = np.bincount(at, grad, n * wide).reshape(n, wide).cumsum(1)
                    h = np.bincount(at, hess, n * wide).reshape(n, wide).cumsum(1)
                    gr, hr = g[:, -1:] - g, h[:, -1:] - h
                    c = np.bincount(at, minlength=n * wide).reshape(n, wide).cumsum(1)
                    gain = g**2 / (h + self.ridge) + gr**2 / (hr + self.ridge) - g[:, -1:] ** 2 / (h[:, -1:] + self.ridge)
                    gain[(c < self.least) | (c[:, -1:] - c < self.least)] = 0
                    gain[:, len(cuts[f]) :] = 0
                    k = gain.argmax(1)
                    better = gain[np.arange(n), k] > best
                    best[better] = gain[np.arange(n), k][better]
                    chosen[better] = np.stack([np.full(n, f), k], 1)[better]
                right = np.zeros(len(y), bool)
                for i, (f, k) in enumerate(chosen):
                    if f >= 0:
                        features[n - 1 + i], thresholds[n - 1 + i] = f, cuts[f][k]
                        mine = node == i
                        right[mine] = binned[f][mine] > k
                node = 2 * node + right
            g, h = np.bincount(node, grad, 2**self.depth), np.bincount(node, hess, 2**self.depth)
            leaf = -self.rate * g / (h + self.ridge)
            self.splits.append((features, thresholds))
            self.leaves.append(leaf)
            raw = raw + leaf[node]
        return self

    def raw(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for (features, thresholds), leaf in zip(self.splits, self.leaves, strict=True):
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[rows, features[node]] > thresholds[node])
            out += leaf[node - (2**self.depth - 1)]
        return out


def isotonic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots of the non-decreasing step fit of ``y`` on ``x`` by pooling adjacent violators; between knots one interpolates."""
    order = np.argsort(x, kind="stable")
    blocks: list[list[float]] = []
    for a, v, w in zip(x[order].tolist(), y[order].tolist(), weight[order].tolist(), strict=True):
        if blocks and blocks[-1][1] == a:
            b = blocks[-1]
            b[2], b[3] = (b[2] * b[3] + v * w) / (b[3] + w), b[3] + w
        else:
            blocks.append([a, a, v, w])
        while len(blocks) > 1 and blocks[-2][2] >= blocks[-1][2]:
            last = blocks.pop()
            b = blocks[-1]
            b[2] = (b[2] * b[3] + last[2] * last[3]) / (b[3] + last[3])
            b[1], b[3] = last[1], b[3] + last[3]
    return np.array([e for b in blocks for e in (b[0], b[1])]), np.array([b[2] for b in blocks for _ in (0, 1)])
