"""Gradient-boosted trees over a small table of features, and a calibrated threshold."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from lectern.llm.linear import fit_platt, sigmoid

DEPTH, TREES, RATE, LEAF, DAMPING, CUTS = 3, 40, 0.3, 8, 1.0, 24


@dataclass
class Tree:
    """A full binary tree: node i has the children 2i + 1 and 2i + 2, and goes right above its cut."""

    feature: np.ndarray
    cut: np.ndarray
    value: np.ndarray

    def predict(self, x: np.ndarray) -> np.ndarray:
        node = np.zeros(len(x), dtype=np.intp)
        for _ in range(DEPTH):
            node = 2 * node + 1 + (x[np.arange(len(x)), self.feature[node]] > self.cut[node])
        return self.value[node]


def grow(x: np.ndarray, cuts: list[np.ndarray], gradient: np.ndarray, curve: np.ndarray) -> Tree:
    """The tree whose leaves lower the loss most, each split by the best of the given cuts."""
    inner = 2**DEPTH - 1
    tree = Tree(np.zeros(inner, dtype=np.intp), np.full(inner, np.inf), np.zeros(2 * inner + 1))
    rows = {0: np.arange(len(x))}
    for node in range(2 * inner + 1):
        mine = rows.get(node, np.zeros(0, dtype=np.intp))
        g, h = gradient[mine].sum(), curve[mine].sum()
        tree.value[node] = -RATE * g / (h + DAMPING)
        if node >= inner:
            continue
        best = 1e-6
        for f, points in enumerate(cuts):
            if len(mine) < 2 * LEAF or not len(points):
                continue
            place = np.searchsorted(points, x[mine, f], side="left")
            n, gs, hs = (np.bincount(place, weights=w, minlength=len(points) + 1).cumsum()[:-1] for w in (None, gradient[mine], curve[mine]))
            gain = gs**2 / (hs + DAMPING) + (g - gs) ** 2 / (h - hs + DAMPING) - g**2 / (h + DAMPING)
            gain[(n < LEAF) | (len(mine) - n < LEAF)] = 0
            if gain.max() > best:
                best, at = gain.max(), int(gain.argmax())
                tree.feature[node], tree.cut[node] = f, points[at]
        right = x[mine, tree.feature[node]] > tree.cut[node]
        rows[2 * node + 1], rows[2 * node + 2] = mine[~right], mine[right]
    return tree


@dataclass
class Boosted:
    """Trees, and the slope and offset that make their sum a probability."""

    trees: list[Tree]
    slope: float
    offset: float

    def probability(self, x: np.ndarray) -> np.ndarray:
        return sigmoid(self.slope * _total(self.trees, x) + self.offset)


def _total(trees: list[Tree], x: np.ndarray) -> np.ndarray:
    return sum((t.predict(x) for t in trees), np.zeros(len(x)))


def fit(x: np.ndarray, y: np.ndarray) -> Boosted | None:
    """Trained on three of four rows, calibrated on the others; None without enough rows of both classes."""
    held = np.arange(len(y)) % 4 == 3
    if min(y[~held].sum(), (~y[~held]).sum()) < LEAF or not y[held].any() or y[held].all():
        return None
    a, b = x[~held], y[~held]
    cuts = [np.unique(np.quantile(column, np.linspace(0, 1, CUTS), method="lower"))[:-1] for column in a.T]
    total, trees = np.zeros(len(b)), []
    for _ in range(TREES):
        p = sigmoid(total)
        trees.append(grow(a, cuts, p - b, p * (1 - p)))
        total = total + trees[-1].predict(a)
    return Boosted(trees, *fit_platt(_total(trees, x[held]), y[held]))
