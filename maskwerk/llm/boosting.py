"""Gradient-boosted trees for two classes, on binned features, in numpy."""

from __future__ import annotations

import numpy as np


class Boosted:
    """Log-odds by a sum of shallow trees of fixed depth; splits compare a feature with a threshold."""

    def __init__(self, trees: int = 40, depth: int = 4, rate: float = 0.3, bins: int = 32, penalty: float = 1.0):
        self.trees, self.depth, self.rate, self.bins, self.penalty = trees, depth, rate, bins, penalty

    def fit(self, x: np.ndarray, y: np.ndarray) -> Boosted:
        n, width = x.shape
        cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, self.bins + 1)[1:-1])) for f in range(width)]
        binned = np.stack([np.searchsorted(cuts[f], x[:, f], "left") for f in range(width)], 1)
        mean = float(np.clip(y.mean(), 1e-3, 1 - 1e-3))
        self.start = float(np.log(mean / (1 - mean)))
        self.feature = np.zeros((self.trees, (1 << self.depth) - 1), np.int64)
        self.cut = np.full((self.trees, (1 << self.depth) - 1), np.inf)
        self.leaf = np.zeros((self.trees, 1 << self.depth))
        odds = np.full(n, self.start)
        for t in range(self.trees):
            p = 1 / (1 + np.exp(-odds))
            g, h = y - p, np.maximum(p * (1 - p), 1e-6)
            node = np.zeros(n, np.int64)
            for level in range(self.depth):
                count, first = 1 << level, (1 << level) - 1
                best = np.zeros(count)
                split = np.full((count, 2), -1, np.int64)
                total = np.bincount(node, g, count), np.bincount(node, h, count)
                whole = total[0] ** 2 / (total[1] + self.penalty)
                for f in range(width):
                    k = len(cuts[f]) + 1
                    if k == 1:
                        continue
                    cell = node * k + binned[:, f]
                    left = [np.cumsum(np.bincount(cell, w, count * k).reshape(count, k), 1)[:, :-1] for w in (g, h)]
                    right = [total[i][:, None] - left[i] for i in (0, 1)]
                    gain = left[0] ** 2 / (left[1] + self.penalty) + right[0] ** 2 / (right[1] + self.penalty) - whole[:, None]
                    at = gain.argmax(1)
                    top = gain[np.arange(count), at]
                    better = top > best + 1e-9
                    best[better] = top[better]
                    split[better] = np.stack([np.full(count, f), at], 1)[better]
                go = np.zeros(n, np.int64)
                for j in range(count):
                    f, b = split[j]
                    if f >= 0:
                        self.feature[t, first + j], self.cut[t, first + j] = f, cuts[f][b]
                        go[node == j] = binned[node == j, f] > b
                node = node * 2 + go
            size = 1 << self.depth
            self.leaf[t] = self.rate * np.bincount(node, g, size) / (np.bincount(node, h, size) + self.penalty)
            odds += self.leaf[t][node]
        return self

    def odds(self, x: np.ndarray) -> np.ndarray:
        """Log-odds of each row."""
        rows, out = np.arange(len(x)), np.full(len(x), self.start)
        for t in range(self.trees):
            node = np.zeros(len(x), np.int64)
            for level in range(self.depth):
                at = (1 << level) - 1 + node
                node = node * 2 + (x[rows, self.feature[t, at]] > self.cut[t, at])
            out += self.leaf[t][node]
        return out
