"""Gradient-boosted trees with logistic loss, and isotonic calibration, for small dense samples in numpy."""

from __future__ import annotations

import numpy as np


class BoostedTrees:
    """Complete trees of fixed depth over histogram bins; fit() takes a bounded sample, raw() scores any matrix."""

    def __init__(self, trees: int = 60, depth: int = 3, rate: float = 0.15, bins: int = 32, ridge: float = 1.0):
        self.trees, self.depth, self.rate, self.bins, self.ridge = trees, depth, rate, bins, ridge
        self.base, self.nodes = 0.0, []

    def fit(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        n, width = x.shape
        if not n:
            return self
        mean = np.clip(y.mean(), 1e-3, 1 - 1e-3)
        self.base = float(np.log(mean / (1 - mean)))
        edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, self.bins + 1)[1:-1])) for j in range(width)]
        code = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], axis=1)
        raw = np.full(n, self.base)
        for _ in range(self.trees):
            p = 1 / (1 + np.exp(-raw))
            grad, hess = y - p, p * (1 - p)
            node = np.zeros(n, np.int64)
            feature, cut = np.zeros(2**self.depth - 1, np.int64), np.full(2**self.depth - 1, np.inf)
            first = 0
            for level in range(self.depth):
                wide = 2**level
                best = np.full(wide, 1e-9)
                local = node - first
                split_code = np.full(wide, self.bins)
                for j in range(width):
                    if not len(edges[j]):
                        continue
                    cell = local * (self.bins + 1) + code[:, j]
                    g = np.bincount(cell, grad, wide * (self.bins + 1)).reshape(wide, -1).cumsum(axis=1)
                    h = np.bincount(cell, hess, wide * (self.bins + 1)).reshape(wide, -1).cumsum(axis=1)
                    gr, hr = g[:, -1:] - g, h[:, -1:] - h
                    gain = g**2 / (h + self.ridge) + gr**2 / (hr + self.ridge) - g[:, -1:] ** 2 / (h[:, -1:] + self.ridge)
                    gain[:, len(edges[j]) :] = -1
                    at = gain.argmax(axis=1)
                    most = gain[np.arange(wide), at]
                    better = most > best
                    best[better], split_code[better] = most[better], at[better]
                    feature[first : first + wide][better] = j
                    cut[first : first + wide][better] = edges[j][np.minimum(at[better], len(edges[j]) - 1)]
                node = 2 * node + 1 + (code[np.arange(n), feature[node]] > split_code[local])
                first += wide
            leaf = node - first
            g, h = np.bincount(leaf, grad, 2**self.depth), np.bincount(leaf, hess, 2**self.depth)
            value = self.rate * g / (h + self.ridge)
            raw += value[leaf]
            self.nodes.append((feature, cut, value))
        return self

    def raw(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for feature, cut, value in self.nodes:
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[rows, feature[node]] > cut[node])
            out += value[node - len(cut)]
        return out


class Isotonic:
    """A non-decreasing map from raw scores to probabilities, by pooling adjacent violators; linear between the pools."""

    def fit(self, raw: np.ndarray, y: np.ndarray) -> Isotonic:
        if not len(raw):
            self.x, self.y = np.zeros(1), np.full(1, 0.5)
            return self
        order = np.argsort(raw, kind="stable")
        pools: list[list[float]] = []
        for r, v in zip(raw[order], y[order], strict=True):
            pools.append([float(v), 1.0, float(r)])
            while len(pools) > 1 and (pools[-2][2] == pools[-1][2] or pools[-2][0] / pools[-2][1] >= pools[-1][0] / pools[-1][1]):
                last = pools.pop()
                there = pools[-1]
                there[2] = (there[2] * there[1] + last[2] * last[1]) / (there[1] + last[1])
                there[0] += last[0]
                there[1] += last[1]
        self.x = np.array([p[2] for p in pools])
        self.y = np.array([(p[0] + 0.25) / (p[1] + 0.5) for p in pools])
        self.y = np.maximum.accumulate(self.y)
        return self

    def __call__(self, raw: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(raw, self.x, self.y), 0.0, 1.0)
