"""Gradient-boosted trees for a 0/1 label: fitted on a bounded sample with numpy
histograms, kept as flat node arrays so a matrix is scored without a Python loop
over rows.  Chosen features can be held monotonic."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class Trees:
    """Nodes of all trees in one array; a leaf points to itself."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    bias: float
    depth: int

    def raw(self, x: np.ndarray) -> np.ndarray:
        out, rows = np.full(len(x), self.bias), np.arange(len(x))
        for root in self.roots.tolist():
            at = np.full(len(x), root)
            for _ in range(self.depth):
                at = np.where(x[rows, self.feature[at]] <= self.threshold[at], self.left[at], self.right[at])
            out += self.value[at]
        return out

    def predict(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.raw(x)))


def fit(x: np.ndarray, y: np.ndarray, monotone: dict[int, int] | None = None, trees: int = 60, depth: int = 4, rate: float = 0.15, bins: int = 64, least: int = 10, ridge: float = 1.0) -> Trees:
    """Logistic loss, second-order gains.  ``monotone`` maps a feature to +1 (score
    may only rise with it) or -1.  A split that breaks its constraint is refused and
    the halves' values are held on their sides of the middle further down."""
    monotone = monotone or {}
    n, features = x.shape
    share = float(np.clip(y.mean() if n else 1.0, 1e-3, 1 - 1e-3))
    bias = float(np.log(share / (1 - share)))
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) if n else np.empty(0) for f in range(features)]
    binned = np.column_stack([np.searchsorted(edges[f], x[:, f], side="left") for f in range(features)]) if n else np.empty((0, features), int)
    width = bins + 1
    node: list[list[float]] = []  # feature, threshold, left, right, value
    roots, score = [], np.full(n, bias)

    def grow(rows: np.ndarray, g: np.ndarray, h: np.ndarray, level: int, low: float, high: float) -> int:
        gs, hs = g[rows].sum(), h[rows].sum()
        value = float(np.clip(-gs / (hs + ridge), low, high))
        at = len(node)
        node.append([0, np.inf, at, at, rate * value])
        if level == depth or len(rows) < 2 * least:
            return at
        best, cut = 1e-6, None
        for f in range(features):
            if not len(edges[f]):
                continue
            b = binned[rows, f]
            cg, ch, cn = (np.cumsum(np.bincount(b, weights=w, minlength=width))[:len(edges[f])] for w in (g[rows], h[rows], np.ones(len(rows))))
            lv, rv = np.clip(-cg / (ch + ridge), low, high), np.clip(-(gs - cg) / (hs - ch + ridge), low, high)
            gain = cg**2 / (ch + ridge) + (gs - cg) ** 2 / (hs - ch + ridge) - gs**2 / (hs + ridge)
            ok = (cn >= least) & (len(rows) - cn >= least) & ((rv - lv) * monotone.get(f, 0) >= 0)
            gain = np.where(ok, gain, -1)
            k = int(np.argmax(gain))
            if gain[k] > best:
                best, cut = gain[k], (f, k, float(lv[k]), float(rv[k]))
        if cut is None:
            return at
        f, k, lv, rv = cut
        go = binned[rows, f] <= k
        middle, way = (lv + rv) / 2, monotone.get(f, 0)
        l_bounds = (low, min(high, middle)) if way > 0 else (max(low, middle), high) if way < 0 else (low, high)
        r_bounds = (max(low, middle), high) if way > 0 else (low, min(high, middle)) if way < 0 else (low, high)
        left = grow(rows[go], g, h, level + 1, *l_bounds)
        right = grow(rows[~go], g, h, level + 1, *r_bounds)
        node[at][:4] = [f, float(edges[f][k]), left, right]
        return at

    def leaf_values(root: int) -> np.ndarray:
        at, table = np.full(n, root), np.array(node)
        for _ in range(depth):
            f = table[at, 0].astype(int)
            at = np.where(x[np.arange(n), f] <= table[at, 1], table[at, 2], table[at, 3]).astype(int)
        return table[at, 4]

    for _ in range(trees if n and 0 < y.sum() < n else 0):
        p = 1 / (1 + np.exp(-score))
        roots.append(grow(np.arange(n), p - y, np.maximum(p * (1 - p), 1e-6), 0, -8.0, 8.0))
        score += leaf_values(roots[-1])
    table = np.array(node or [[0, np.inf, 0, 0, 0.0]])
    return Trees(table[:, 0].astype(int), table[:, 1], table[:, 2].astype(int), table[:, 3].astype(int), table[:, 4], np.array(roots, int), bias, depth)
