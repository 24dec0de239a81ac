"""Gradient boosting of small trees, fitted in numpy on the driver and scored as a Spark expression."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
#: A node is a leaf's value, or (feature, cut, node if the feature is at most cut, other node).
Node = float | tuple


@dataclass(frozen=True)
class BoostedTrees:
    start: float
    trees: tuple[Node, ...]

    def logit(self, x: np.ndarray) -> np.ndarray:
        def at(node: Node, rows: np.ndarray) -> np.ndarray:
            if not isinstance(node, tuple):
                return np.full(len(rows), node)
            feature, cut, low, high = node
            return np.where(rows[:, feature] <= cut, at(low, rows), at(high, rows))

        return self.start + sum((at(tree, x) for tree in self.trees), np.zeros(len(x)))

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.logit(x)))

    def logit_sql(self, features: list[str]) -> str:
        """The logit of a row's score in SQL, over the SQL of its features."""

        def at(node: Node) -> str:
            if not isinstance(node, tuple):
                return f"{float(node)!r}D"
            feature, cut, low, high = node
            return f"if({features[feature]} <= {float(cut)!r}D, {at(low)}, {at(high)})"

        return "(" + " + ".join([f"{float(self.start)!r}D", *map(at, self.trees)]) + ")"


def fit_trees(x: np.ndarray, y: np.ndarray, rounds: int = 40, depth: int = 3, rate: float = 0.3, cuts: int = 32, least: int = 10) -> BoostedTrees:
    """Logistic boosting with Newton leaves; cuts lie between quantiles of each feature and are compared by histograms."""
    grids = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, cuts + 1)[:-1])) for j in range(x.shape[1])]
    # a value's bin is at most c where the value is at most grid[c]
    bins = np.column_stack([np.searchsorted(grid, x[:, j]) + j * (cuts + 1) for j, grid in enumerate(grids)])
    mean = y.mean()
    start = float(np.log(mean / (1 - mean)))
    f, trees = np.full(len(y), start), []

    def below(rows: np.ndarray, weights: np.ndarray) -> np.ndarray:
        sums = np.bincount(bins[rows].ravel(), np.repeat(weights, x.shape[1]), x.shape[1] * (cuts + 1))
        return sums.reshape(x.shape[1], cuts + 1).cumsum(1)

    def grow(rows: np.ndarray, g: np.ndarray, h: np.ndarray, depth: int) -> Node:
        leaf = float(rate * g[rows].sum() / (h[rows].sum() + 1.0))
        if not depth or len(rows) < 2 * least:
            return leaf
        n, g_low, h_low = (below(rows, w) for w in (np.ones(len(rows)), g[rows], h[rows]))
        gain = lambda g, h: g * g / (h + 1.0)
        won = gain(g_low, h_low) + gain(g_low[:, -1:] - g_low, h_low[:, -1:] - h_low) - gain(g[rows].sum(), h[rows].sum())
        won = np.where((n >= least) & (n <= len(rows) - least), won, 0.0)
        j, cut = divmod(int(won.argmax()), cuts + 1)
        if won[j, cut] <= 1e-6:
            return leaf
        low = bins[rows, j] <= cut + j * (cuts + 1)
        return (j, float(grids[j][cut]), grow(rows[low], g, h, depth - 1), grow(rows[~low], g, h, depth - 1))

    for _ in range(rounds):
        p = 1 / (1 + np.exp(-f))
        tree = grow(np.arange(len(y)), y - p, p * (1 - p), depth)
        if not isinstance(tree, tuple):
            break
        trees.append(tree)
        f = BoostedTrees(start, tuple(trees)).logit(x)
    return BoostedTrees(start, tuple(trees))


def calibrated_threshold(scores: np.ndarray, y: np.ndarray, precision: float) -> float:
    """The lowest score from which up at least that share is positive; infinity if there is none."""
    order = np.argsort(-scores, kind="stable")
    share = np.cumsum(y[order]) / np.arange(1, len(y) + 1)
    good = np.flatnonzero((share >= precision) & np.append(scores[order][1:] < scores[order][:-1], True))
    return float(scores[order][good[-1]]) if len(good) else float("inf")
