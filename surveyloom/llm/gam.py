"""Generalised additive model with pairwise interactions, boosted from shallow trees on binned features."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

BINS, PAIR_BINS = 32, 8
ROUNDS, PAIR_ROUNDS, PAIRS = 120, 60, 6
RATE, LEAF_ROWS = 0.1, 20


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


@dataclass
class Model:
    """Lookup tables: a score is the intercept plus one entry per feature and per pair of features."""

    intercept: float
    edges: list[np.ndarray]
    tables: list[np.ndarray]
    pair_edges: list[np.ndarray]
    pairs: list[tuple[int, int]]
    pair_tables: list[np.ndarray]

    def raw(self, features: np.ndarray) -> np.ndarray:
        """Log-odds of rows of features, by additions over whole columns."""
        out = np.full(len(features), self.intercept)
        for j, table in enumerate(self.tables):
            out += table[np.searchsorted(self.edges[j], features[:, j], side="right")]
        coarse = {}
        for (i, j), table in zip(self.pairs, self.pair_tables, strict=True):
            for f in (i, j):
                if f not in coarse:
                    coarse[f] = np.searchsorted(self.pair_edges[f], features[:, f], side="right")
            out += table[coarse[i], coarse[j]]
        return out

    def score(self, features: np.ndarray) -> np.ndarray:
        return _sigmoid(self.raw(features))


def _edges(column: np.ndarray, bins: int) -> np.ndarray:
    """Cuts between distinct values, near the quantiles."""
    cuts = np.unique(np.quantile(column, np.linspace(0, 1, bins + 1)[1:-1], method="inverted_cdf"))
    return cuts[cuts > column.min()]


def _sums(place: np.ndarray, size: int, gradient: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, ...]:
    return (np.bincount(place, gradient, size), np.bincount(place, weight, size),
            np.bincount(place, minlength=size).astype(np.float64))


def _cut(g: np.ndarray, h: np.ndarray, n: np.ndarray) -> tuple[float, int]:
    """Gain and place of the best cut of bins in a row into left and right; gain 0 without one."""
    if len(g) < 2:
        return 0.0, 0
    gl, hl, nl = np.cumsum(g)[:-1], np.cumsum(h)[:-1], np.cumsum(n)[:-1]
    gt, ht, nt = g.sum(), h.sum(), n.sum()
    gain = gl ** 2 / (hl + 1) + (gt - gl) ** 2 / (ht - hl + 1) - gt ** 2 / (ht + 1)
    gain[(nl < LEAF_ROWS) | (nt - nl < LEAF_ROWS)] = 0
    best = int(np.argmax(gain))
    return float(gain[best]), best + 1


def _tree(g: np.ndarray, h: np.ndarray, n: np.ndarray, depth: int = 2) -> np.ndarray:
    """Leaf value of every bin for a tree of at most ``depth`` cuts on one feature."""
    gain, place = _cut(g, h, n) if depth else (0.0, 0)
    if gain <= 1e-9:
        return np.full(len(g), g.sum() / (h.sum() + 1))
    return np.concatenate([_tree(g[:place], h[:place], n[:place], depth - 1),
                           _tree(g[place:], h[place:], n[place:], depth - 1)])


def _quadrants(g: np.ndarray, h: np.ndarray, n: np.ndarray) -> tuple[float, np.ndarray]:
    """Gain and leaf values of the best tree that cuts one feature and then each side by the other."""
    best, values = 0.0, np.zeros_like(g)
    for turned in (False, True):
        gg, hh, nn = (x.T if turned else x for x in (g, h, n))
        for cut in range(1, len(gg)):
            gain, out = 0.0, np.zeros_like(gg)
            for rows in (slice(0, cut), slice(cut, None)):
                a, b, c = gg[rows].sum(0), hh[rows].sum(0), nn[rows].sum(0)
                out[rows] = _tree(a, b, c, 1)[None, :]
                gain += float((a * out[rows][0]).sum())
            gain -= float(g.sum() ** 2 / (h.sum() + 1))
            if gain > best:
                best, values = gain, out.T if turned else out
    return best, values


def fit(features: np.ndarray, labels: np.ndarray) -> Model:
    """Fit by cyclic boosting: every round passes over the features in turn, and each
    gets a small tree on its bins, added to its table at a low rate.  The pairs that
    explain most of what is left then get tables in the same way.

    Ties fall in one bin; a constant feature has one bin.  Without rows, or with
    one label only, the model is a constant.
    """
    count, width = features.shape
    mean = (labels.sum() + 0.5) / (count + 1)
    intercept = float(np.log(mean / (1 - mean)))
    empty = [np.zeros(0) for _ in range(width)]
    if count == 0 or labels.min() == labels.max():
        return Model(intercept, empty, [np.zeros(1) for _ in range(width)], empty, [], [])
    edges = [_edges(features[:, j], BINS) for j in range(width)]
    coarse_edges = [_edges(features[:, j], PAIR_BINS) for j in range(width)]
    bins = [np.searchsorted(e, features[:, j], side="right") for j, e in enumerate(edges)]
    coarse = [np.searchsorted(e, features[:, j], side="right") for j, e in enumerate(coarse_edges)]
    tables = [np.zeros(len(e) + 1) for e in edges]
    raw = np.full(count, intercept)

    def slopes() -> tuple[np.ndarray, np.ndarray]:
        p = _sigmoid(raw)
        return labels - p, p * (1 - p)

    for _ in range(ROUNDS):
        for j in range(width):
            step = RATE * _tree(*_sums(bins[j], len(tables[j]), *slopes()))
            tables[j] += step
            raw += step[bins[j]]

    def grid(i: int, j: int, gradient: np.ndarray, weight: np.ndarray) -> list[np.ndarray]:
        shape = (len(coarse_edges[i]) + 1, len(coarse_edges[j]) + 1)
        return [s.reshape(shape) for s in _sums(coarse[i] * shape[1] + coarse[j], shape[0] * shape[1], gradient, weight)]

    left = slopes()
    gains = sorted(((_quadrants(*grid(i, j, *left))[0], i, j) for i in range(width) for j in range(i + 1, width)),
                   reverse=True)
    pairs = [(i, j) for gain, i, j in gains[:PAIRS] if gain > 0]
    pair_tables = [np.zeros((len(coarse_edges[i]) + 1, len(coarse_edges[j]) + 1)) for i, j in pairs]
    for _ in range(PAIR_ROUNDS):
        for k, (i, j) in enumerate(pairs):
            step = RATE * _quadrants(*grid(i, j, *slopes()))[1]
            pair_tables[k] += step
            raw += step[coarse[i], coarse[j]]
    return Model(intercept, edges, tables, coarse_edges, pairs, pair_tables)
