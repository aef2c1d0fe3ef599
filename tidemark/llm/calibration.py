"""Isotonic calibration of scores from binned counts."""

from __future__ import annotations

import numpy as np


def isotonic(scores: np.ndarray, positives: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots (score, share of positives) of the best non-decreasing fit: neighbours that violate the order are pooled.

    Each score comes with its number of rows and of positive rows. Shares are
    drawn in by one pseudo-row of the overall share, so that they stay inside (0, 1).
    """
    order = np.argsort(scores, kind="stable")
    scores, positives, weights = scores[order], positives[order].astype(float), weights[order].astype(float)
    if not len(scores) or weights.sum() == 0:
        return np.array([0.0]), np.array([0.5])
    prior = (positives.sum() + 0.5) / (weights.sum() + 1)
    sums: list[list[float]] = []  # positives, rows, first and last score
    for s, p, w in zip(scores.tolist(), positives.tolist(), weights.tolist(), strict=True):
        if w == 0:
            continue
        sums.append([p, w, s, s])
        while len(sums) > 1 and sums[-2][0] * sums[-1][1] >= sums[-1][0] * sums[-2][1]:
            p1, w1, _, last = sums.pop()
            sums[-1][0] += p1
            sums[-1][1] += w1
            sums[-1][3] = last
    x, y = [], []
    for p, w, first, last in sums:
        share = (p + prior) / (w + 1)
        x += [first] if first == last else [first, last]
        y += [share] if first == last else [share, share]
    return np.array(x), np.maximum.accumulate(np.array(y))


def calibrated(raw: np.ndarray, knots: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Shares at ``raw``, on straight lines between the knots; with a faint slope so that order is kept within a pool."""
    level = np.interp(raw, knots[0], knots[1])
    return np.clip(level + 1e-6 * np.tanh(raw), 0.0, 1.0)
