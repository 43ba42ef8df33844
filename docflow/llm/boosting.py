"""Gradient-boosted trees for a binary label, in numpy: histogram splits, logistic loss, complete trees of fixed depth."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class Trees:
    """Level-order complete trees: a row goes right where its feature exceeds the threshold."""

    feature: np.ndarray  # (trees, 2**depth - 1)
    threshold: np.ndarray
    leaf: np.ndarray  # (trees, 2**depth)
    start: float

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.start)
        rows = np.arange(len(x))
        depth = int(np.log2(self.leaf.shape[1]))
        for feature, threshold, leaf in zip(self.feature, self.threshold, self.leaf):
            at = np.zeros(len(x), np.int64)
            for _ in range(depth):
                at = 2 * at + 1 + (x[rows, feature[at]] > threshold[at])
            total += leaf[at - (len(leaf) - 1)]
        return total


def boost(x: np.ndarray, y: np.ndarray, weight: np.ndarray, trees: int = 80, depth: int = 5, rate: float = 0.3, bins: int = 24, ridge: float = 1.0) -> Trees:
    n, f = x.shape
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(f)]
    binary = np.flatnonzero([(x[:, j] == 0).sum() + (x[:, j] == 1).sum() == n for j in range(f)])
    flag = np.isin(np.arange(f), binary)
    other = np.setdiff1d(np.arange(f), binary)
    ones = np.ascontiguousarray(x[:, binary], np.float32)
    code = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], axis=1)
    mean = float(np.average(y, weights=weight))
    start = float(np.log(mean / (1 - mean)))
    score = np.full(n, start)
    shape = (trees, 2**depth - 1)
    feature, threshold, leaf = np.zeros(shape, np.int64), np.full(shape, np.inf), np.zeros((trees, 2**depth))
    for t in range(trees):
        p = 1 / (1 + np.exp(-score))
        g, h = weight * (y - p), weight * p * (1 - p)
        at = np.zeros(n, np.int64)
        for level in range(depth):
            first, width = 2**level - 1, 2**level
            local = at - first
            gain, cut, which = np.zeros(width), np.full(width, -1), np.zeros(width, np.int64)
            if len(binary):  # the left side of a flag's only split: its zeros
                member = (local == np.arange(width)[:, None]).astype(np.float32)
                gt, ht = member @ g, member @ h
                gs, hs = (t[:, None] - (member * v.astype(np.float32)) @ ones for t, v in ((gt, g), (ht, h)))
                gt, ht = gt[:, None], ht[:, None]
                won = gs**2 / (hs + ridge) + (gt - gs) ** 2 / (ht - hs + ridge) - gt**2 / (ht + ridge)
                won = np.where((hs > 0.5) & (ht - hs > 0.5), won, 0)
                best = won.argmax(axis=1)
                gain = won[np.arange(width), best]
                cut[gain > 0], which = 0, binary[best]
            for j in other:
                if len(edges[j]) == 0:
                    continue
                key = local * bins + code[:, j]
                gs = np.bincount(key, g, width * bins).reshape(width, bins).cumsum(axis=1)
                hs = np.bincount(key, h, width * bins).reshape(width, bins).cumsum(axis=1)
                gt, ht = gs[:, -1:], hs[:, -1:]
                won = gs**2 / (hs + ridge) + (gt - gs) ** 2 / (ht - hs + ridge) - gt**2 / (ht + ridge)
                won = np.where((hs > 0.5) & (ht - hs > 0.5), won, 0)[:, : len(edges[j])]
                best = won.argmax(axis=1)
                value = won[np.arange(width), best]
                better = value > gain + 1e-9
                gain[better], cut[better], which[better] = value[better], best[better], j
            for k in np.flatnonzero(cut >= 0):
                feature[t, first + k], threshold[t, first + k] = which[k], 0.5 if flag[which[k]] else edges[which[k]][cut[k]]
            at = 2 * at + 1 + (x[np.arange(n), feature[t][at]] > threshold[t][at])
        local = at - (2**depth - 1)
        leaf[t] = rate * np.bincount(local, g, 2**depth) / (np.bincount(local, h, 2**depth) + ridge)
        score += leaf[t][local]
    return Trees(feature, threshold, leaf, start)
