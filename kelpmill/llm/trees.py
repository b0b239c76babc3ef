"""Gradient-boosted trees for two classes, in numpy: histogram splits, logistic loss, JSON models."""

from __future__ import annotations

import numpy as np


def fit(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 4, rate: float = 0.25, bins: int = 32, l2: float = 1.0, least: int = 10) -> dict:
    """x: (rows, features), y: 0 or 1. The model is a dict of plain lists."""
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])]
    for j in range(x.shape[1]):  # few values: cut between each
        values = np.unique(x[:, j])
        if len(values) <= bins:
            cuts[j] = (values[1:] + values[:-1]) / 2
    binned = np.stack([np.searchsorted(c, x[:, j], "left") for j, c in enumerate(cuts)], 1)
    base = float(np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6)))
    f, model = np.full(len(y), base), []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-f))
        g, h = y - p, p * (1 - p) + 1e-9
        size = 2 ** (depth + 1) - 1
        feature, cut, value = [-1] * size, [0.0] * size, [0.0] * size
        node = np.zeros(len(y), int)
        for k in range(2**depth - 1):
            rows = np.flatnonzero(node == k)
            if len(rows) < 2 * least:
                continue
            best = (1e-6, -1, 0)
            total_g, total_h = g[rows].sum(), h[rows].sum()
            for j, c in enumerate(cuts):
                if not len(c):
                    continue
                b = binned[rows, j]
                gl, hl, nl = (np.cumsum(np.bincount(b, w, len(c) + 1))[:-1] for w in (g[rows], h[rows], np.ones(len(rows))))
                gain = gl**2 / (hl + l2) + (total_g - gl) ** 2 / (total_h - hl + l2) - total_g**2 / (total_h + l2)
                gain[(nl < least) | (len(rows) - nl < least)] = -1
                i = int(gain.argmax())
                if gain[i] > best[0]:
                    best = (float(gain[i]), j, i)
            if best[1] >= 0:
                _, j, i = best
                feature[k], cut[k] = j, float(cuts[j][i])
                node[rows] = 2 * k + 1 + (binned[rows, j] > i)
        for k in np.unique(node):
            rows = node == k
            value[k] = float(rate * g[rows].sum() / (h[rows].sum() + l2))
            f[rows] += value[k]
        model.append({"feature": feature, "cut": cut, "value": value})
    return {"base": base, "trees": model}


def score(model: dict, x: np.ndarray) -> np.ndarray:
    """Probability of class 1."""
    f = np.full(len(x), model["base"])
    for t in model["trees"]:
        feature, cut, value = np.array(t["feature"]), np.array(t["cut"]), np.array(t["value"])
        node = np.zeros(len(x), int)
        while True:
            j = feature[node]
            inner = j >= 0
            if not inner.any():
                break
            step = 2 * node + 1 + (x[np.arange(len(x)), np.maximum(j, 0)] > cut[node])
            node = np.where(inner, step, node)
        f += value[node]
    return 1 / (1 + np.exp(-f))
