"""Gradient-boosted trees over counted cells of small whole-number features.

The cells are collected sums (one row per distinct feature vector), so the fit works on a bounded
table whatever the size of the corpus; the trees come back as Spark expressions.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def _logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -500, 500)))


@dataclass
class Node:
    value: float = 0.0
    feature: int = -1
    bound: int = 0
    low: Node | None = None
    high: Node | None = None

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.low is None or self.high is None:
            return np.full(len(x), self.value)
        return np.where(x[:, self.feature] <= self.bound, self.low.score(x), self.high.score(x))

    def expression(self, x: Sequence[Column]) -> Column:
        if self.low is None or self.high is None:
            return F.lit(self.value)
        inside = x[self.feature] <= self.bound
        return F.when(inside, self.low.expression(x)).otherwise(self.high.expression(x))


def _grow(x, gradient, weight, depth: int, shrink: float, ridge: float) -> Node:
    total_g, total_h = gradient.sum(), weight.sum()
    leaf = Node(value=float(shrink * total_g / (total_h + ridge)))
    if depth == 0 or len(x) < 2:
        return leaf
    best, best_gain = None, 1e-9
    for f in range(x.shape[1]):
        bounds, at = np.unique(x[:, f], return_inverse=True)
        if len(bounds) < 2:
            continue
        g = np.cumsum(np.bincount(at, gradient))[:-1]
        h = np.cumsum(np.bincount(at, weight))[:-1]
        gain = g**2 / (h + ridge) + (total_g - g) ** 2 / (total_h - h + ridge) - total_g**2 / (total_h + ridge)
        k = int(np.argmax(gain))
        if gain[k] > best_gain:
            best, best_gain = (f, int(bounds[k])), float(gain[k])
    if best is None:
        return leaf
    inside = x[:, best[0]] <= best[1]
    grow = lambda m: _grow(x[m], gradient[m], weight[m], depth - 1, shrink, ridge)
    return Node(leaf.value, best[0], best[1], grow(inside), grow(~inside))


@dataclass
class Boosted:
    """A fitted model: log-odds ``slope * (base + sum of trees) + shift``."""

    base: float = 0.0
    trees: list[Node] = field(default_factory=list)
    slope: float = 1.0
    shift: float = 0.0

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.base + sum((t.score(x) for t in self.trees), np.zeros(len(x)))

    def probability(self, x: np.ndarray) -> np.ndarray:
        return _logistic(self.slope * self.raw(x) + self.shift)

    def expression(self, x: Sequence[Column]) -> Column:
        total = F.lit(self.base)
        for tree in self.trees:
            total = total + tree.expression(x)
        return 1 / (1 + F.exp(-(F.lit(self.slope) * total + F.lit(self.shift))))


def fit_boosted(
    x: np.ndarray, label: np.ndarray, count: np.ndarray, trees: int = 24, depth: int = 3,
    shrink: float = 0.4, ridge: float = 1.0,
) -> Boosted:
    """Logistic boosting of weighted cells; counts enter by their logarithm, as copies abound."""
    weight = 1.0 + np.log(count.astype(float))
    share = float(np.clip((weight * label).sum() / weight.sum(), 0.01, 0.99))
    model = Boosted(base=float(np.log(share / (1 - share))))
    score = np.full(len(x), model.base)
    for _ in range(trees):
        p = _logistic(score)
        tree = _grow(x, weight * (label - p), weight * p * (1 - p), depth, shrink, ridge)
        model.trees.append(tree)
        score += tree.score(x)
    return model


def calibrate(model: Boosted, x: np.ndarray, label: np.ndarray, count: np.ndarray) -> None:
    """Platt scaling on cells that the trees have not seen."""
    if not len(x) or label.min() == label.max():
        return
    weight, raw = 1.0 + np.log(count.astype(float)), model.raw(x)
    positive, negative = (weight * label).sum(), (weight * (1 - label)).sum()
    target = np.where(label > 0, (positive + 1) / (positive + 2), 1 / (negative + 2))
    a, b = 1.0, 0.0
    for _ in range(50):
        p = _logistic(a * raw + b)
        d, h = weight * (target - p), weight * p * (1 - p)
        g = np.array([(d * raw).sum(), d.sum()])
        m = np.array([[(h * raw * raw).sum() + 1e-3, (h * raw).sum()], [(h * raw).sum(), h.sum() + 1e-3]])
        step = np.linalg.solve(m, g)
        a, b = a + step[0], b + step[1]
        if np.abs(step).max() < 1e-9:
            break
    if np.isfinite(a) and a > 0 and np.isfinite(b):
        model.slope, model.shift = float(a), float(b)


def threshold_for(probability: np.ndarray, label: np.ndarray, count: np.ndarray, precision: float) -> float:
    """Smallest threshold from which on the precision is reached; 0.5 at least, above 1 if none is."""
    order = np.argsort(-probability, kind="stable")
    right = np.cumsum((count * label)[order])
    ratio = right / np.cumsum(count[order])
    last = np.append(np.diff(probability[order]) != 0, True) if len(order) else np.array([], bool)
    good = np.flatnonzero((ratio >= precision) & last)
    return max(0.5, float(probability[order][good[-1]])) if len(good) else 1.1
