"""Boosted trees over one or two numbers a row, for the few rows of one column of an audit."""

from __future__ import annotations

import numpy as np

ROUNDS, DEPTH, RATE, RIDGE, LEAST = 40, 3, 0.15, 1.0, 10.0
BINS = 32


def _places(values: np.ndarray, taught: np.ndarray) -> np.ndarray:
    """The bin of each value, by quantiles of those taught; missing values are a bin of their own, below all others."""
    known = taught[~np.isnan(taught)]
    cuts = np.unique(np.quantile(known, np.arange(1, BINS) / BINS)) if len(known) else np.zeros(0)
    return np.where(np.isnan(values), 0, 1 + np.searchsorted(cuts, np.nan_to_num(values), "right"))


def _grow(places: np.ndarray, taught: np.ndarray, gradient: np.ndarray, curvature: np.ndarray) -> np.ndarray:
    """The step that one tree takes for each row; splits and leaves come from the taught rows alone."""
    node, width = np.zeros(len(gradient), int), BINS + 2
    for _ in range(DEPTH):
        nodes = node.max() + 1
        best, split = np.full(nodes, 1e-9), np.full((nodes, 2), -1)
        for f, place in enumerate(places):
            cell = node[taught] * width + place[taught]
            g, h = (np.bincount(cell, x[taught], nodes * width).reshape(nodes, width).cumsum(1) for x in (gradient, curvature))
            n = np.bincount(cell, minlength=nodes * width).reshape(nodes, width).cumsum(1)
            rest_g, rest_h, rest_n = (x[:, -1:] - x for x in (g, h, n))
            gain = g**2 / (h + RIDGE) + rest_g**2 / (rest_h + RIDGE) - g[:, -1:] ** 2 / (h[:, -1:] + RIDGE)
            gain[(n < LEAST) | (rest_n < LEAST)] = 0
            at = gain.argmax(1)
            better = gain[np.arange(nodes), at] > best
            best[better], split[better] = gain[np.arange(nodes), at][better], np.stack([np.full(nodes, f), at], 1)[better]
        value = np.stack(places)[np.maximum(split[node, 0], 0), np.arange(len(node))]
        node = 2 * node + ((split[node, 0] >= 0) & (value > split[node, 1]))
    g, h = (np.bincount(node[taught], x[taught], node.max() + 1) for x in (gradient, curvature))
    return (-g / (h + RIDGE))[node]


def boosted_scores(columns: list[np.ndarray], y: np.ndarray, taught: np.ndarray) -> np.ndarray:
    """Log-odds of all rows, learnt from the taught ones."""
    share = np.clip(y[taught].mean(), 1e-3, 1 - 1e-3)
    places, score = [_places(c, c[taught]) for c in columns], np.full(len(y), np.log(share / (1 - share)))
    for _ in range(ROUNDS):
        p = 1 / (1 + np.exp(-score))
        score = score + RATE * _grow(places, taught, p - y, p * (1 - p))
    return score


def area(score: np.ndarray, y: np.ndarray) -> float:
    """The ROC area; ties count half."""
    _, place, count = np.unique(score, return_inverse=True, return_counts=True)
    rank = (np.cumsum(count) - (count - 1) / 2)[place]
    positive = y.sum()
    return float((rank[y == 1].sum() - positive * (positive + 1) / 2) / (positive * (len(y) - positive)))


def boosted_area(columns: list[np.ndarray], y: np.ndarray, fold: np.ndarray) -> float | None:
    """The area, at least 1/2, of scores of each fold learnt from the other; None with one class only, or an empty fold."""
    if len(np.unique(y)) < 2 or len(np.unique(fold)) < 2:
        return None
    score = np.zeros(len(y))
    for k in (0, 1):
        score[fold == k] = boosted_scores(columns, y, fold != k)[fold == k]
    found = area(score, y)
    return max(found, 1 - found)
