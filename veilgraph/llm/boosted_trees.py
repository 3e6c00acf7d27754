"""Gradient-boosted trees for a yes-or-no target, on binned features in numpy."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

BINS = 32


@dataclass(frozen=True)
class Tree:
    """A full binary tree: node i has the children 2i + 1 and 2i + 2; a split sends codes above ``bin`` right."""

    feature: np.ndarray
    bin: np.ndarray
    value: np.ndarray


@dataclass(frozen=True)
class Boosted:
    edges: list[np.ndarray]  # of each feature
    trees: list[Tree]
    start: float
    depth: int

    def codes(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(self.edges)], 1).astype(np.uint8)

    def margin(self, x: np.ndarray) -> np.ndarray:
        """Log odds of each row."""
        codes, rows = self.codes(x), np.arange(len(x))
        total = np.full(len(x), self.start)
        for tree in self.trees:
            at = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                at = 2 * at + 1 + (codes[rows, tree.feature[at]] > tree.bin[at])
            total += tree.value[at]
        return total


def _edges(column: np.ndarray) -> np.ndarray:
    values = np.unique(column)
    if len(values) > BINS:
        values = np.unique(np.quantile(column, np.linspace(0, 1, BINS + 1)[1:-1]))
        return values
    return (values[1:] + values[:-1]) / 2


def fit(
    x: np.ndarray, y: np.ndarray, weight: np.ndarray, n_trees: int = 80, depth: int = 5, rate: float = 0.3
) -> Boosted:
    """Newton boosting of the logistic loss; each level is split on sums of gradients by (node, feature, bin)."""
    edges = [_edges(x[:, f]) for f in range(x.shape[1])]
    model = Boosted(edges, [], float(np.log((weight @ y + 1) / (weight @ (1 - y) + 1))), depth)
    codes = model.codes(x).astype(np.int64)
    n, width = codes.shape
    places = codes + np.arange(width) * BINS
    margin = np.full(n, model.start)
    size = 2 ** (depth + 1) - 1
    for _ in range(n_trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = weight * (p - y), weight * p * (1 - p)
        feature, cut, value = np.zeros(size, np.int64), np.full(size, BINS, np.int64), np.zeros(size)
        at = np.zeros(n, np.int64)
        for level in range(depth):
            first, nodes = 2**level - 1, 2**level
            slot = ((at - first) * (width * BINS))[:, None] + places
            sums = [
                np.bincount(slot.ravel(), np.repeat(v, width), nodes * width * BINS).reshape(nodes, width, BINS)
                for v in (g, h)
            ]
            left = [s.cumsum(axis=2) for s in sums]
            total = [s[:, :, -1:] for s in left]
            right = [t - s for t, s in zip(total, left)]

            def gain(pair: list[np.ndarray]) -> np.ndarray:
                return pair[0] ** 2 / (pair[1] + 1.0)

            score = (gain(left) + gain(right) - gain(total)).reshape(nodes, -1)
            best = score.argmax(axis=1)
            useful = score[np.arange(nodes), best] > 1e-6
            here = np.arange(first, first + nodes)
            feature[here] = np.where(useful, best // BINS, 0)
            cut[here] = np.where(useful, best % BINS, BINS)
            at = 2 * at + 1 + (codes[np.arange(n), feature[at]] > cut[at])
        leaves = slice(2**depth - 1, size)
        gs, hs = (np.bincount(at, v, size) for v in (g, h))
        value[leaves] = (-rate * gs / (hs + 1.0))[leaves]
        margin += value[at]
        model.trees.append(Tree(feature, cut, value))
    return model
