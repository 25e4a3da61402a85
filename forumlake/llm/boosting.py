"""Gradient-boosted trees for two classes, on small samples held in memory (numpy).

Trees are grown level by level on binned features with the logistic loss's gradients; a
fitted model is a few arrays, so it is cheap to send to tasks and to apply to a batch.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Trees:
    """Complete binary trees of one depth. A node without a split sends all rows left."""

    feature: np.ndarray  # (trees, inner nodes)
    threshold: np.ndarray
    leaf: np.ndarray  # (trees, leaves)
    base: float
    scale: tuple[float, float] = (1.0, 0.0)  # calibration: p = sigmoid(a * score + b)

    def score(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        depth = int(np.log2(self.leaf.shape[1]))
        rows = np.arange(len(x))
        for f, t, v in zip(self.feature, self.threshold, self.leaf, strict=True):
            node = np.zeros(len(x), dtype=np.int64)
            for _ in range(depth):
                node = 2 * node + 1 + (x[rows, f[node]] > t[node])
            out += v[node - (self.leaf.shape[1] - 1)]
        return out

    def probability(self, x: np.ndarray) -> np.ndarray:
        a, b = self.scale
        return 1 / (1 + np.exp(-np.clip(a * self.score(x) + b, -40, 40)))


def fit(x: np.ndarray, y: np.ndarray, trees: int = 80, depth: int = 4, rate: float = 0.15, bins: int = 32, least: float = 2.0, ridge: float = 1.0) -> Trees:
    """Boosted trees for labels 0 and 1. least: the least sum of hessians times 4 (rows, about) on either side of a split."""
    n, k = x.shape
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(k)]
    # between two neighbouring values, so that a threshold lies in the gap and not on a row
    for j in range(k):
        v = np.unique(x[:, j])
        at = np.searchsorted(v, edges[j], side="right")
        edges[j] = np.unique(np.where(at < len(v), (edges[j] + v[np.minimum(at, len(v) - 1)]) / 2, edges[j]))
    width = max((len(e) for e in edges), default=0) + 1
    # every feature has its own range of `width` bins
    binned = np.stack([np.searchsorted(e, x[:, j], side="left") + j * width for j, e in enumerate(edges)], axis=1)
    real = np.zeros((k, width), dtype=bool)
    for j, e in enumerate(edges):
        real[j, : len(e)] = True
    p = (y.sum() + 1) / (n + 2)
    base = float(np.log(p / (1 - p)))
    f, rows = np.full(n, base), np.arange(n)
    inner, leaves = 2**depth - 1, 2**depth
    model = Trees(np.zeros((trees, inner), dtype=np.int64), np.full((trees, inner), np.inf), np.zeros((trees, leaves)), base)
    for m in range(trees):
        prob = 1 / (1 + np.exp(-f))
        g, h = y - prob, prob * (1 - prob)
        node = np.zeros(n, dtype=np.int64)
        for level in range(depth):
            first, many = 2**level - 1, 2**level
            flat = ((node - first)[:, None] * (k * width) + binned).ravel()
            gl = np.cumsum(np.bincount(flat, np.repeat(g, k), many * k * width).reshape(many, k, width), axis=2)
            hl = np.cumsum(np.bincount(flat, np.repeat(h, k), many * k * width).reshape(many, k, width), axis=2)
            G, H = gl[:, :1, -1:], hl[:, :1, -1:]
            ok = real & (hl * 4 >= least) & ((H - hl) * 4 >= least)
            gain = np.where(ok, gl**2 / (hl + ridge) + (G - gl) ** 2 / (H - hl + ridge) - G**2 / (H + ridge), -1).reshape(many, -1)
            best = np.argmax(gain, axis=1)
            for q in np.nonzero(gain[np.arange(many), best] > 1e-9)[0]:
                j, i = divmod(int(best[q]), width)
                model.feature[m, first + q], model.threshold[m, first + q] = j, edges[j][i]
            node = 2 * node + 1 + (x[rows, model.feature[m, node]] > model.threshold[m, node])
        leaf = node - inner
        value = rate * np.bincount(leaf, g, leaves) / (np.bincount(leaf, h, leaves) + ridge)
        model.leaf[m] = value
        f += value[leaf]
    return model


def calibrate(model: Trees, x: np.ndarray, y: np.ndarray, steps: int = 100) -> Trees:
    """Platt's scaling on held-out rows: p = sigmoid(a * score + b), with his smoothed targets, by Newton's method."""
    s = model.score(x)
    pos, neg = y.sum(), len(y) - y.sum()
    t = np.where(y > 0, (pos + 1) / (pos + 2), 1 / (neg + 2))
    w = np.array([1.0, 0.0])
    z = np.stack([s, np.ones(len(s))], axis=1)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -40, 40)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + 1e-4 * np.eye(2), z.T @ (t - p))
        w = w + np.clip(step, -1, 1)
        if np.abs(step).max() < 1e-9:
            break
    model.scale = (float(max(w[0], 1e-3)), float(w[1]))
    return model
