"""Gradient-boosted trees for two classes, flattened into numpy node arrays.

Second-order boosting on quantile bins. ``monotone`` gives -1, 0 or 1 for each
feature: a split whose leaf values go against it is not taken, and both sides
keep their values on their side of the split's middle, so the score is monotone
in that feature over the whole ensemble.

Training is a numpy loop over a bounded sample; scoring walks all rows down all
trees at once.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

BINS = 64


@dataclass
class Forest:
    """Nodes of all trees end to end. A leaf has feature -1; rows with x <= threshold go left."""
    bias: float
    roots: np.ndarray
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    depth: int

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 for every row."""
        total = np.full(len(x), self.bias)
        rows = np.arange(len(x))
        for root in self.roots:
            at = np.full(len(x), root)
            for _ in range(self.depth):
                f = self.feature[at]
                inner = f >= 0
                low = x[rows, np.maximum(f, 0)] <= self.threshold[at]
                at = np.where(inner, np.where(low, self.left[at], self.right[at]), at)
            total += self.value[at]
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def edges_of(x: np.ndarray, bins: int = BINS) -> list[np.ndarray]:
    """Cut points of every feature: midpoints between neighbouring quantiles."""
    out = []
    for j in range(x.shape[1]):
        v = np.unique(x[:, j])
        if len(v) > bins:
            v = np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins), method="lower"))
        out.append((v[1:] + v[:-1]) / 2)
    return out


def fit(x: np.ndarray, y: np.ndarray, weight: np.ndarray, monotone=None, trees: int = 60, depth: int = 3,
        rate: float = 0.2, ridge: float = 1.0, min_rows: float = 8, subsample: float = 1.0, seed: int = 5) -> Forest:
    n_features = x.shape[1]
    monotone = monotone or (0,) * n_features
    base = float(np.average(y, weights=weight)) if len(y) else 0.5
    base = min(max(base, 1e-3), 1 - 1e-3)
    bias = float(np.log(base / (1 - base)))
    nodes: list[list] = []                            # feature, threshold, left, right, value
    roots = []
    if len(y) and 0 < y.sum() < len(y):
        rng = np.random.default_rng(seed)
        cuts = edges_of(x)
        binned = np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)], axis=1)
        z = np.full(len(y), bias)
        for _ in range(trees):
            p = 1 / (1 + np.exp(-z))
            g, h = weight * (p - y), weight * np.maximum(p * (1 - p), 1e-6)
            rows = np.arange(len(y)) if subsample >= 1 else np.flatnonzero(rng.random(len(y)) < subsample)
            roots.append(_tree(nodes, binned, cuts, g, h, rows, monotone, depth, ridge, min_rows, rate))
            z += _walk(nodes, roots[-1], x, depth)
    cols = list(zip(*nodes)) if nodes else [()] * 5
    return Forest(bias, np.array(roots, np.int64), np.array(cols[0], np.int64), np.array(cols[1], float),
                  np.array(cols[2], np.int64), np.array(cols[3], np.int64), np.array(cols[4], float), depth)


def _walk(nodes, root, x, depth):
    out = np.zeros(len(x))
    todo = [(root, np.arange(len(x)))]
    while todo:
        at, rows = todo.pop()
        f, t, left, right, value = nodes[at]
        if f < 0:
            out[rows] = value
        else:
            low = x[rows, f] <= t
            todo += [(left, rows[low]), (right, rows[~low])]
    return out


def _tree(nodes, binned, cuts, g, h, rows, monotone, depth, ridge, min_rows, rate) -> int:
    def leaf(rows, lo, hi):
        return float(np.clip(-g[rows].sum() / (h[rows].sum() + ridge), lo, hi))

    def build(rows, level, lo, hi) -> int:
        at = len(nodes)
        nodes.append([-1, 0.0, -1, -1, rate * leaf(rows, lo, hi)])
        if level == depth or len(rows) < 2 * min_rows:
            return at
        best = (1e-6, None, None, None)
        gs, hs = g[rows], h[rows]
        total_g, total_h = gs.sum(), hs.sum()
        for j, c in enumerate(cuts):
            if not len(c):
                continue
            b = binned[rows, j]
            gl = np.cumsum(np.bincount(b, gs, len(c) + 1))[:-1]
            hl = np.cumsum(np.bincount(b, hs, len(c) + 1))[:-1]
            nl = np.cumsum(np.bincount(b, minlength=len(c) + 1))[:-1]
            vl = np.clip(-gl / (hl + ridge), lo, hi)
            vr = np.clip(-(total_g - gl) / (total_h - hl + ridge), lo, hi)
            gain = gl ** 2 / (hl + ridge) + (total_g - gl) ** 2 / (total_h - hl + ridge) - total_g ** 2 / (total_h + ridge)
            ok = (nl >= min_rows) & (len(rows) - nl >= min_rows) & (monotone[j] * (vr - vl) >= 0)
            if ok.any():
                gain = np.where(ok, gain, -1)
                k = int(gain.argmax())
                if gain[k] > best[0]:
                    best = (float(gain[k]), j, k, (vl[k] + vr[k]) / 2)
        if best[1] is None:
            return at
        _, j, k, middle = best
        low = binned[rows, j] <= k
        left_range = (lo, middle) if monotone[j] > 0 else (middle, hi) if monotone[j] < 0 else (lo, hi)
        right_range = (middle, hi) if monotone[j] > 0 else (lo, middle) if monotone[j] < 0 else (lo, hi)
        left = build(rows[low], level + 1, *left_range)
        right = build(rows[~low], level + 1, *right_range)
        nodes[at] = [j, float(cuts[j][k]), left, right, nodes[at][4]]
        return at

    return build(rows, 0, -np.inf, np.inf)
