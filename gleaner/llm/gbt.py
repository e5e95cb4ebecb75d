"""Gradient-boosted trees on a few dense features, and isotonic calibration."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

BINS = 48


@dataclass
class Trees:
    edges: list[np.ndarray]
    feature: np.ndarray  # trees x inner nodes
    cut: np.ndarray
    leaf: np.ndarray  # trees x leaves
    base: float

    def margin(self, x: np.ndarray) -> np.ndarray:
        b = binned(x, self.edges)
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        depth = int(np.log2(self.leaf.shape[1]))
        for f, c, leaf in zip(self.feature, self.cut, self.leaf):
            at = np.zeros(len(x), np.int64)
            for _ in range(depth):
                at = 2 * at + 1 + (b[rows, f[at]] > c[at])
            out += leaf[at - (len(leaf) - 1)]
        return out


def binned(x: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    return np.stack([np.searchsorted(e, x[:, k]) for k, e in enumerate(edges)], axis=1) if len(x) else np.zeros((0, len(edges)), np.int64)


def sigmoid(m: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(m, -30, 30)))


def fit_trees(x: np.ndarray, y: np.ndarray, rounds: int = 120, depth: int = 3, rate: float = 0.1, l2: float = 2.0, least: float = 2.0) -> Trees:
    """Logistic loss, second-order splits on quantile bins; deterministic."""
    edges = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, BINS + 1)[1:-1])) for k in range(x.shape[1])]
    b = binned(x, edges)
    p = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    base = float(np.log(p / (1 - p)))
    margin = np.full(len(y), base)
    inner, n_leaf, width = (1 << depth) - 1, 1 << depth, BINS + 1
    trees = []
    flat = b + np.arange(b.shape[1]) * width
    for _ in range(rounds):
        q = sigmoid(margin)
        g, h = q - y, np.maximum(q * (1 - q), 1e-6)
        feature, cut, at = np.zeros(inner, np.int64), np.full(inner, BINS + 1), np.zeros(len(y), np.int64)
        for level in range(depth):
            first, n = (1 << level) - 1, 1 << level
            place = (at - first)[:, None] * (b.shape[1] * width) + flat
            size = n * b.shape[1] * width
            gs = np.bincount(place.ravel(), np.repeat(g, b.shape[1]), size).reshape(n, b.shape[1], width).cumsum(2)
            hs = np.bincount(place.ravel(), np.repeat(h, b.shape[1]), size).reshape(n, b.shape[1], width).cumsum(2)
            gt, ht = gs[:, :, -1:], hs[:, :, -1:]
            gain = gs**2 / (hs + l2) + (gt - gs) ** 2 / (ht - hs + l2) - gt**2 / (ht + l2)
            gain[(hs < least) | (ht - hs < least)] = 0
            best = gain.reshape(n, -1).argmax(1)
            good = gain.reshape(n, -1).max(1) > 1e-6
            feature[first : first + n] = np.where(good, best // width, 0)
            cut[first : first + n] = np.where(good, best % width, BINS + 1)
            at = 2 * at + 1 + (b[np.arange(len(y)), feature[at]] > cut[at])
        at -= inner
        leaf = -rate * np.bincount(at, g, n_leaf) / (np.bincount(at, h, n_leaf) + l2)
        margin += leaf[at]
        trees.append((feature, cut, leaf))
    return Trees(edges, *(np.stack(z) for z in zip(*trees)), base)


@dataclass
class Isotonic:
    at: np.ndarray
    value: np.ndarray

    def __call__(self, m: np.ndarray) -> np.ndarray:
        """Calibrated probability; a trace of the margin keeps the order within a step."""
        return np.clip(0.999 * np.interp(m, self.at, self.value) + 0.001 * sigmoid(m), 0, 1)


def fit_isotonic(margin: np.ndarray, y: np.ndarray) -> Isotonic:
    """Pool adjacent violators; block means are drawn a little towards the overall mean."""
    order = np.argsort(margin, kind="stable")
    blocks: list[list[float]] = []  # sum, weight, first, last
    for m, v in zip(margin[order], y[order]):
        blocks.append([float(v), 1.0, m, m])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            s, w, _, last = blocks.pop()
            blocks[-1][0] += s
            blocks[-1][1] += w
            blocks[-1][3] = last
    mean = float(y.mean())
    at = [x for b in blocks for x in (b[2], b[3])]
    value = [(b[0] + mean) / (b[1] + 1) for b in blocks for _ in range(2)]
    return Isotonic(np.array(at), np.maximum.accumulate(value))


def cross_margins(x: np.ndarray, y: np.ndarray, folds: int = 3, **kw) -> np.ndarray:
    """Margins of rows by trees that have not seen them."""
    out = np.zeros(len(y))
    fold = np.arange(len(y)) % folds
    for k in range(folds):
        out[fold == k] = fit_trees(x[fold != k], y[fold != k], **kw).margin(x[fold == k])
    return out
