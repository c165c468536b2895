"""Forests of classes on few binned predictors: rows with the same bins and class are one cell with a number of rows.

A tree sees bins only, so cells lose nothing: a bag that draws each row a Poisson number of times (mean 1) draws a cell of n rows a
Poisson number of mean n. What a forest learns from is bounded by the bins, whatever the number of rows. Settings are MLlib's defaults
for forests of classes: gini, 32 bins, depth 5, the root of the predictors tried at a node, shares of leaves added up.
"""

from __future__ import annotations

import math

import numpy as np

#: Bins of a predictor, bits of their number, and levels of a tree.
BINS, BITS, DEPTH = 32, 5, 5


def pack(bins: list[np.ndarray], label: np.ndarray, train: np.ndarray) -> np.ndarray:
    """A number for each row's bins, label (0 to 3) and whether it is learned from."""
    out = label.astype(np.int64) * 2 + train
    for b in bins:
        out = out << BITS | b
    return out


def unpack(codes: np.ndarray, predictors: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bins (predictors by rows), labels and whether rows are learned from."""
    bins = np.stack([codes >> BITS * (predictors - 1 - p) & (BINS - 1) for p in range(predictors)])
    rest = codes >> BITS * predictors
    return bins, rest >> 1, (rest & 1).astype(bool)


def _gini(counts: np.ndarray) -> np.ndarray:
    """Impurity times rows, of counts by class."""
    n = counts.sum(-1)
    return n - (counts**2).sum(-1) / np.maximum(n, 1e-300)


def _best(counts: np.ndarray) -> tuple[float, int, int]:
    """Gain, place among the predictors and bin of the best split (rows up to the bin go left) of counts by predictor, bin and class."""
    left = counts.cumsum(1)
    right = left[:, -1:] - left
    gain = _gini(left[:, -1:]) - _gini(left) - _gini(right)
    gain[(left.sum(-1) < 1) | (right.sum(-1) < 1)] = -1.0
    at = int(np.argmax(np.round(gain, 9)))
    return float(gain.ravel()[at]), *divmod(at, counts.shape[1])


def _tree(bins: np.ndarray, label: np.ndarray, times: np.ndarray, classes: int, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Predictor (-1: a leaf) and bin of each node, children of n being 2 n + 1 and 2 n + 2, and counts by node and class."""
    nodes = (1 << DEPTH + 1) - 1
    predictor, at, counts = np.full(nodes, -1), np.zeros(nodes, np.int64), np.zeros((nodes, classes))
    node, tried = np.zeros(len(label), np.int64), math.ceil(math.sqrt(len(bins)))
    for depth in range(DEPTH + 1):
        first, width = (1 << depth) - 1, 1 << depth
        there = np.flatnonzero(node >= first)  # others have ended in a leaf above
        place, weight = node[there] - first, times[there]
        counts[first : first + width] = np.bincount(place * classes + label[there], weight, width * classes).reshape(width, classes)
        if depth == DEPTH:
            break
        sums = [np.bincount((place * BINS + b[there]) * classes + label[there], weight, width * BINS * classes).reshape(width, BINS, classes) for b in bins]
        for k in range(width):
            some = np.sort(rng.permutation(len(bins))[:tried])
            gain, p, b = _best(np.stack([sums[q][k] for q in some]))
            if gain > 1e-9:
                predictor[first + k], at[first + k] = some[p], b
        split = predictor[node[there]]
        on = there[split >= 0]
        node[on] = 2 * node[on] + 1 + (bins[predictor[node[on]], on] > at[node[on]])
    return predictor, at, counts


def kappa(codes: np.ndarray, n: np.ndarray, predictors: int, trees: int, seed: int) -> float:
    """Agreement beyond chance of a forest, learned from the cells that are, with the classes of the others."""
    order = np.argsort(codes)
    bins, label, train = unpack(codes[order], predictors)
    n = n[order]
    frequent = np.argsort(-np.bincount(label[train], n[train], 4), kind="stable")  # of equal votes the more frequent class is called
    label = np.argsort(frequent)[label]
    learned, judged = np.flatnonzero(train), np.flatnonzero(~train)
    votes = np.zeros((len(judged), 4))
    for k in range(trees):
        rng = np.random.default_rng([seed, k])
        times = rng.poisson(n[learned]).astype(float)
        drawn = learned[times > 0]
        predictor, at, counts = _tree(bins[:, drawn], label[drawn], times[times > 0], 4, rng)
        node = np.zeros(len(judged), np.int64)
        for _ in range(DEPTH):
            on = np.flatnonzero(predictor[node] >= 0)
            node[on] = 2 * node[on] + 1 + (bins[predictor[node[on]], judged[on]] > at[node[on]])
        votes += (counts / np.maximum(counts.sum(1, keepdims=True), 1e-300))[node]
    called, total = votes.argmax(1), n[judged].sum()
    if not total:
        return 0.0
    table = np.bincount(label[judged] * 4 + called, n[judged], 16).reshape(4, 4) / total
    chance = float(table.sum(0) @ table.sum(1))
    return (float(np.trace(table)) - chance) / (1 - chance) if chance < 1 else 0.0
