"""Gradient boosted trees of depth two for a small table of numbers, fitted with numpy.

Only training runs here, on a bounded sample; scoring is a Spark expression (:meth:`Trees.score`).
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Split:
    feature: int
    threshold: float
    low: "Split | float"
    high: "Split | float"


def _leaf(g: np.ndarray, h: np.ndarray, rate: float) -> float:
    return float(-rate * g.sum() / (h.sum() + 1.0))


def _best(x: np.ndarray, g: np.ndarray, h: np.ndarray):
    """The split that gains most over the whole: ``gain, feature, threshold``."""
    best = (1e-9, -1, 0.0)
    whole = g.sum() ** 2 / (h.sum() + 1)
    for f in range(x.shape[1]):
        values = np.unique(x[:, f])
        for t in (values[1:] + values[:-1]) / 2 if len(values) < 64 else np.quantile(x[:, f], np.linspace(0.02, 0.98, 48)):
            low = x[:, f] <= t
            gl, hl = g[low].sum(), h[low].sum()
            gr, hr = g.sum() - gl, h.sum() - hl
            gain = gl**2 / (hl + 1) + gr**2 / (hr + 1) - whole
            if gain > best[0]:
                best = (gain, f, float(t))
    return best


def _grow(x, g, h, depth: int, rate: float) -> "Split | float":
    if depth == 0 or len(g) < 4:
        return _leaf(g, h, rate)
    _, feature, threshold = _best(x, g, h)
    if feature < 0:
        return _leaf(g, h, rate)
    low = x[:, feature] <= threshold
    return Split(
        feature,
        threshold,
        _grow(x[low], g[low], h[low], depth - 1, rate),
        _grow(x[~low], g[~low], h[~low], depth - 1, rate),
    )


def _value(tree: "Split | float", row: np.ndarray) -> float:
    while isinstance(tree, Split):
        tree = tree.low if row[tree.feature] <= tree.threshold else tree.high
    return tree


@dataclass(frozen=True)
class Trees:
    start: float
    trees: tuple

    def margins(self, x: np.ndarray) -> np.ndarray:
        return np.array([self.start + sum(_value(t, row) for t in self.trees) for row in x])

    def score(self, feature: Callable[[int], Column]) -> Column:
        """The margin as an expression over the feature columns."""

        def column(tree) -> Column:
            if not isinstance(tree, Split):
                return F.lit(tree)
            test = feature(tree.feature) <= F.lit(tree.threshold)
            return F.when(test, column(tree.low)).otherwise(column(tree.high))

        total = F.lit(self.start)
        for tree in self.trees:
            total = total + column(tree)
        return total


def fit_trees(x: np.ndarray, y: np.ndarray, rounds: int = 20, rate: float = 0.4) -> Trees:
    """Boosted trees for the log loss."""
    share = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    start = float(np.log(share / (1 - share)))
    margin, trees = np.full(len(y), start), []
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-margin))
        tree = _grow(x, p - y, p * (1 - p), 2, rate)
        trees.append(tree)
        margin += np.array([_value(tree, row) for row in x])
    return Trees(start, tuple(trees))
