"""Gradient-boosted trees for two classes: fitted and applied in numpy, or compiled into a column expression."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class GbtConfig:
    trees: int = 40
    depth: int = 3
    rate: float = 0.3
    bins: int = 32
    ridge: float = 1.0
    least: float = 1.0  # curvature that a leaf needs


@dataclass
class Tree:
    """Nodes in breadth-first order; a leaf has feature -1. Values under or at the threshold go left."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    value: np.ndarray

    def apply(self, x: np.ndarray) -> np.ndarray:
        at = np.zeros(len(x), dtype=np.int64)
        rows = np.arange(len(x))
        while True:
            f = self.feature[at]
            inner = f >= 0
            if not inner.any():
                return self.value[at]
            right = x[rows, np.maximum(f, 0)] > self.threshold[at]
            at = np.where(inner, self.left[at] + right, at)


@dataclass
class Gbt:
    base: float
    trees: list[Tree]

    def margin(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.base)
        for t in self.trees:
            z += t.apply(x)
        return z

    def compiled(self, feature) -> Column:
        """The margin as an expression; ``feature(j)`` is the column of feature j."""

        def node(t: Tree, k: int) -> Column:
            if t.feature[k] < 0:
                return F.lit(float(t.value[k]))
            go = feature(int(t.feature[k])) <= float(t.threshold[k])
            return F.when(go, node(t, int(t.left[k]))).otherwise(node(t, int(t.left[k]) + 1))

        return reduce(lambda a, b: a + b, (node(t, 0) for t in self.trees), F.lit(self.base))


def fit(x: np.ndarray, y: np.ndarray, cfg: GbtConfig = GbtConfig()) -> Gbt:
    """Logistic boosting with second-order leaves on binned features; ties go to the first feature and bin."""
    share = (y.sum() + 1) / (len(y) + 2)
    z = np.full(len(y), np.log(share / (1 - share)))
    model = Gbt(float(z[0]) if len(z) else 0.0, [])
    cuts = []
    for j in range(x.shape[1]):
        u = np.unique(x[:, j])
        mids = (u[1:] + u[:-1]) / 2
        cuts.append(mids if len(mids) < cfg.bins else np.unique(np.quantile(x[:, j], np.linspace(0, 1, cfg.bins + 1)[1:-1])))
    bins = np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)], axis=1)
    width = max((len(c) for c in cuts), default=0) + 1
    for _ in range(cfg.trees):
        p = 1 / (1 + np.exp(-z))
        g, h = y - p, p * (1 - p)
        feature, threshold, left, value = [-1], [0.0], [0], [0.0]
        level = [(0, np.arange(len(y)))]
        for depth in range(cfg.depth + 1):
            after = []
            for k, rows in level:
                sg, sh = g[rows].sum(), h[rows].sum()
                value[k] = float(cfg.rate * sg / (sh + cfg.ridge))
                if depth == cfg.depth or len(rows) < 2:
                    continue
                flat = bins[rows] + np.arange(x.shape[1]) * width
                gs = np.bincount(flat.ravel(), np.repeat(g[rows], x.shape[1]), x.shape[1] * width).reshape(-1, width).cumsum(1)
                hs = np.bincount(flat.ravel(), np.repeat(h[rows], x.shape[1]), x.shape[1] * width).reshape(-1, width).cumsum(1)
                won = gs**2 / (hs + cfg.ridge) + (sg - gs) ** 2 / (sh - hs + cfg.ridge) - sg**2 / (sh + cfg.ridge)
                won[(hs < cfg.least) | (sh - hs < cfg.least)] = -1
                j, b = np.unravel_index(int(won.argmax()), won.shape)
                if won[j, b] <= 1e-6 or b >= len(cuts[j]):
                    continue
                feature[k], threshold[k], left[k] = int(j), float(cuts[j][b]), len(feature)
                goes = bins[rows, j] > b
                for side in (rows[~goes], rows[goes]):
                    after.append((len(feature), side))
                    feature.append(-1)
                    threshold.append(0.0)
                    left.append(0)
                    value.append(0.0)
            level = after
        t = Tree(np.array(feature), np.array(threshold), np.array(left), np.array(value))
        model.trees.append(t)
        z += t.apply(x)
    return model
