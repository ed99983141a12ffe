"""Gradient-boosted trees on dense features, and isotonic calibration, in numpy.

Training takes a bounded sample on the driver; scoring is vectorised over Arrow batches
on the executors.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class Boost:
    """``trees`` of ``depth`` levels on features cut into ``bins`` quantile bins;
    ``rate``: shrinkage; ``l2``: penalty of leaf values; ``least``: least sum of
    hessians in a leaf."""

    trees: int = 80
    depth: int = 3
    bins: int = 48
    rate: float = 0.15
    l2: float = 1.0
    least: float = 1.0


class Model:
    """Complete binary trees: ``feature`` and ``edge`` of the inner nodes level by level
    (values of at most ``edge`` go left), and the ``leaf`` values."""

    def __init__(self, base: float, feature: np.ndarray, edge: np.ndarray, leaf: np.ndarray):
        self.base, self.feature, self.edge, self.leaf = base, feature, edge, leaf
        self.x: np.ndarray | None = None
        self.y: np.ndarray | None = None

    def margin(self, X: np.ndarray) -> np.ndarray:
        """Log odds before calibration."""
        out, rows = np.full(len(X), self.base), np.arange(len(X))
        depth = int(np.log2(self.leaf.shape[1])) if len(self.leaf) else 0
        for f, e, v in zip(self.feature, self.edge, self.leaf):
            at = np.zeros(len(X), np.int64)
            for _ in range(depth):
                at = 2 * at + 1 + (X[rows, f[at]] > e[at])
            out += v[at - (len(v) - 1)]
        return out

    def probability(self, X: np.ndarray) -> np.ndarray:
        """Calibrated probability; interpolated between the steps of the calibration."""
        m = self.margin(X)
        return 1 / (1 + np.exp(-m)) if self.x is None else np.interp(m, self.x, self.y)


def fit(X: np.ndarray, y: np.ndarray, p: Boost = Boost()) -> Model:
    """Logistic-loss boosting. With a single class the model is constant."""
    n, d = X.shape
    share = (y.sum() + 0.5) / (n + 1)
    base = float(np.log(share / (1 - share)))
    inner, leaves = (1 << p.depth) - 1, 1 << p.depth
    if n == 0 or y.min() == y.max():
        return Model(base, np.zeros((0, inner), int), np.zeros((0, inner)), np.zeros((0, leaves)))
    edges = [np.unique(np.quantile(X[:, j], np.linspace(0, 1, p.bins + 1)[1:-1])) for j in range(d)]
    B = np.stack([np.searchsorted(e, X[:, j], side="left") for j, e in enumerate(edges)], axis=1)
    width = p.bins
    F, E, V = [], [], []
    margin = np.full(n, base)
    for _ in range(p.trees):
        q = 1 / (1 + np.exp(-margin))
        g, h = q - y, np.maximum(q * (1 - q), 1e-6)
        at = np.zeros(n, np.int64)
        feature, edge = np.zeros(inner, np.int64), np.full(inner, np.inf)
        for level in range(p.depth):
            first, count = (1 << level) - 1, 1 << level
            best = np.full(count, 1e-9)
            own = at - first
            for j in range(d):
                if not len(edges[j]):
                    continue
                key = own * width + B[:, j]
                G = np.bincount(key, g, count * width).reshape(count, width).cumsum(axis=1)
                H = np.bincount(key, h, count * width).reshape(count, width).cumsum(axis=1)
                gt, ht = G[:, -1:], H[:, -1:]
                k = len(edges[j])
                gl, hl = G[:, :k], H[:, :k]
                gain = gl**2 / (hl + p.l2) + (gt - gl) ** 2 / (ht - hl + p.l2) - gt**2 / (ht + p.l2)
                gain[(hl < p.least) | (ht - hl < p.least)] = -1
                cut = gain.argmax(axis=1)
                top = gain[np.arange(count), cut]
                for i in np.flatnonzero(top > best):
                    best[i] = top[i]
                    feature[first + i], edge[first + i] = j, edges[j][cut[i]]
            at = 2 * at + 1 + (X[np.arange(n), feature[at]] > edge[at])
        leaf = at - inner
        value = -p.rate * np.bincount(leaf, g, leaves) / (np.bincount(leaf, h, leaves) + p.l2)
        margin += value[leaf]
        F.append(feature), E.append(edge), V.append(value)
    return Model(base, np.stack(F), np.stack(E), np.stack(V))


def isotonic(score: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: ``(scores, values)`` of a rising step function."""
    o = np.argsort(score, kind="stable")
    x, first = np.unique(score[o], return_index=True)
    w = np.diff(np.append(first, len(o))).astype(float)
    v = np.add.reduceat(y[o].astype(float), first) / w
    blocks: list[list[float]] = []
    for a, b, c in zip(v, w, range(len(v))):
        blocks.append([a, b, c, c])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            m, n, _, e = blocks.pop()
            k = blocks[-1]
            k[0], k[1], k[3] = (k[0] * k[1] + m * n) / (k[1] + n), k[1] + n, e
    xs, ys = [], []
    for m, _, a, e in blocks:
        xs += [x[int(a)], x[int(e)]]
        ys += [m, m]
    return np.array(xs), np.array(ys)


def calibrate(model: Model, X: np.ndarray, y: np.ndarray) -> Model:
    """Set the model's calibration from rows that it was not fitted to."""
    if len(y) and y.min() != y.max() and len(model.leaf):
        model.x, model.y = isotonic(model.margin(X), y)
    return model
