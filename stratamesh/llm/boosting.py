"""Boosted trees over sets of named binary features, fitted in memory on a bounded sample."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable

import numpy as np


class BoostedTrees:
    """Logistic boosting of depth-limited trees. A row is a set of feature names; names seen in fewer than
    ``min_count`` training rows are not used. Splits minimise the second-order loss with shrinkage, as usual."""

    def __init__(self, trees: int = 60, depth: int = 4, rate: float = 0.3, l2: float = 1.0, min_count: int = 8) -> None:
        self.trees, self.depth, self.rate, self.l2, self.min_count = trees, depth, rate, l2, min_count
        self.vocabulary: dict[str, int] = {}
        self.base, self.nodes = 0.0, np.empty((0, 0, 2))
        self.threshold = 0.5

    def matrix(self, rows: list[Iterable[str]]) -> np.ndarray:
        x = np.zeros((len(rows), len(self.vocabulary)), np.uint8)
        known = [[j for j in map(self.vocabulary.get, row) if j is not None] for row in rows]
        x[np.repeat(np.arange(len(rows)), [len(k) for k in known]), [j for k in known for j in k]] = 1
        return x

    def fit(self, rows: list[Iterable[str]], y: np.ndarray) -> BoostedTrees:
        seen = Counter(f for row in rows for f in set(row))
        self.vocabulary = {f: j for j, f in enumerate(sorted(f for f, n in seen.items() if n >= self.min_count))}
        rows = [sorted({self.vocabulary[f] for f in row if f in self.vocabulary}) for row in rows]
        width, y = len(self.vocabulary), y.astype(np.float64)
        col = np.array([j for row in rows for j in row], np.int64)
        row_of = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
        p = float(np.clip(y.mean(), 1e-3, 1 - 1e-3)) if len(y) else 0.5
        self.base = float(np.log(p / (1 - p)))
        score, grown = np.full(len(y), self.base), []
        for _ in range(self.trees if len(y) and width else 0):
            q = 1 / (1 + np.exp(-score))
            g, h = q - y, q * (1 - q)
            # node k has children 2k+1 and 2k+2; (feature or -1, value)
            nodes, at = np.full((2 ** (self.depth + 1) - 1, 2), [-1.0, 0.0]), np.zeros(len(y), np.int64)
            for level in range(self.depth + 1):
                first, n = 2**level - 1, 2**level
                mine = at >= first
                k = at[mine] - first
                gs, hs = np.bincount(k, g[mine], n), np.bincount(k, h[mine], n)
                nodes[first : first + n, 1] = -self.rate * gs / (hs + self.l2)
                if level == self.depth:
                    break
                use = mine[row_of]
                where = (at[row_of[use]] - first) * width + col[use]
                g1 = np.bincount(where, g[row_of[use]], n * width).reshape(n, width)
                h1 = np.bincount(where, h[row_of[use]], n * width).reshape(n, width)
                gain = g1**2 / (h1 + self.l2) + (gs[:, None] - g1) ** 2 / (hs[:, None] - h1 + self.l2) - (gs**2 / (hs + self.l2))[:, None]
                best = gain.argmax(1)
                split = gain[np.arange(n), best] > 1e-3
                nodes[first : first + n, 0] = np.where(split, best, -1)
                has = np.zeros(len(y), bool)
                hit = use.copy()
                hit[use] = col[use] == best[at[row_of[use]] - first]
                has[row_of[hit]] = True
                go = mine.copy()
                go[mine] = split[k]
                at[go] = 2 * at[go] + 1 + has[go]
            score += nodes[at, 1]
            grown.append(nodes)
        self.nodes = np.array(grown)
        return self

    def predict(self, rows: list[Iterable[str]]) -> np.ndarray:
        """Probabilities."""
        x, every = self.matrix(rows), np.arange(len(rows))
        score = np.full(len(rows), self.base)
        for nodes in self.nodes:
            at = np.zeros(len(rows), np.int64)
            for _ in range(self.depth):
                f = nodes[at, 0].astype(np.int64)
                at = np.where(f >= 0, 2 * at + 1 + (x[every, np.maximum(f, 0)] if x.shape[1] else 0), at)
            score += nodes[at, 1]
        return 1 / (1 + np.exp(-score))

    def calibrate(self, rows: list[Iterable[str]], y: np.ndarray, beta: float = 1.0) -> BoostedTrees:
        """Sets the threshold with the best F score on held-out rows, within 0.2 to 0.7 (the middle of the best range);
        ``beta`` over 1 weighs what is missed more than what is found wrongly."""
        if not len(rows):
            return self
        p, cuts, b = self.predict(rows), np.linspace(0.2, 0.7, 101), beta * beta
        hits = np.array([np.sum((p >= c) & (y == 1)) for c in cuts])
        f = (1 + b) * hits / np.maximum(1, np.array([np.sum(p >= c) for c in cuts]) + b * np.sum(y == 1))
        best = np.flatnonzero(f >= f.max() - 1e-12)
        self.threshold = float(cuts[best[len(best) // 2]])
        return self
