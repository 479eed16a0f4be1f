"""Gradient-boosted regression trees on binned features, fitted on the driver to a bounded sample."""

from __future__ import annotations

import numpy as np

BINS = 32


class BoostedTrees:
    """Squared-error boosting of trees of fixed depth over quantile bins."""

    def __init__(self, trees: int = 120, depth: int = 3, rate: float = 0.1, least: int = 8, seed: int = 7) -> None:
        self.trees, self.depth, self.rate, self.least, self.seed = trees, depth, rate, least, seed

    def _bin(self, rows: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(self.edges[f], rows[:, f], side="right") for f in range(rows.shape[1])], axis=1)

    def fit(self, rows: np.ndarray, target: np.ndarray) -> BoostedTrees:
        n, width = rows.shape
        self.edges = [np.unique(np.quantile(rows[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) for f in range(width)]
        bins = self._bin(rows)
        self.base = float(target.mean())
        guess, rng, self.nodes = np.full(n, self.base), np.random.default_rng(self.seed), []
        spread = np.arange(width) * BINS
        for _ in range(self.trees):
            chosen = rng.random(n) < 0.8
            part, rest = bins[chosen], (target - guess)[chosen]
            count = 2 ** (self.depth + 1) - 1
            feature, cut, value = np.zeros(count, np.int32), np.full(count, BINS, np.int32), np.zeros(count)
            where = np.zeros(len(part), np.int64)
            for level in range(self.depth):
                first, nodes = 2**level - 1, 2**level
                slot = ((where - first)[:, None] * (width * BINS) + spread + part).ravel()
                total = np.bincount(slot, minlength=nodes * width * BINS).reshape(nodes, width, BINS)
                summed = np.bincount(slot, np.repeat(rest, width), nodes * width * BINS).reshape(nodes, width, BINS)
                left, mass = total.cumsum(axis=2), summed.cumsum(axis=2)
                right, other = left[:, :, -1:] - left, mass[:, :, -1:] - mass
                gain = mass**2 / np.maximum(left, 1) + other**2 / np.maximum(right, 1)
                gain[(left < self.least) | (right < self.least)] = -1
                best = gain.reshape(nodes, -1).argmax(axis=1)
                ok = gain.reshape(nodes, -1)[np.arange(nodes), best] >= 0
                feature[first : first + nodes] = np.where(ok, best // BINS, 0)
                cut[first : first + nodes] = np.where(ok, best % BINS, BINS)
                where = 2 * where + 1 + (part[np.arange(len(part)), feature[where]] > cut[where])
            size, mass = np.bincount(where, minlength=count), np.bincount(where, rest, count)
            value = self.rate * mass / (size + 1.0)
            self.nodes.append((feature, cut, value))
            guess += self._step(bins, self.nodes[-1])
        return self

    def _step(self, bins: np.ndarray, node: tuple) -> np.ndarray:
        feature, cut, value = node
        where, line = np.zeros(len(bins), np.int64), np.arange(len(bins))
        for _ in range(self.depth):
            where = 2 * where + 1 + (bins[line, feature[where]] > cut[where])
        return value[where]

    def predict(self, rows: np.ndarray) -> np.ndarray:
        bins, total = self._bin(rows), np.full(len(rows), self.base)
        for node in self.nodes:
            total += self._step(bins, node)
        return total
