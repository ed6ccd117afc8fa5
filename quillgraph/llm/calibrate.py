"""Isotonic calibration of raw scores from partition-summed histograms."""

from __future__ import annotations

import numpy as np

BINS = 2048


def bin_of(score: np.ndarray, low: float, high: float) -> np.ndarray:
    return np.clip(((score - low) / (high - low) * BINS).astype(np.int64), 0, BINS - 1)


def isotonic(total: np.ndarray, positive: np.ndarray, low: float, high: float) -> tuple[np.ndarray, np.ndarray]:
    """Knots (x, y) of a non-decreasing map of scores to frequencies, by pooling adjacent violators over bins.

    Linear between the centres of pooled blocks. Each block is smoothed by half a row of either label, which keeps y
    inside (0, 1). Without rows it maps all to 0.5.
    """
    blocks: list[list[float]] = []  # rows, positives, sum of weighted centres
    centre = low + (np.arange(BINS) + 0.5) * (high - low) / BINS
    for n, p, c in zip(total, positive, centre):
        if n > 0:
            blocks.append([n, p, c * n])
            while len(blocks) > 1 and blocks[-2][1] * blocks[-1][0] >= blocks[-1][1] * blocks[-2][0]:
                last = blocks.pop()
                blocks[-1] = [a + b for a, b in zip(blocks[-1], last)]
    if not blocks:
        return np.array([low, high]), np.array([0.5, 0.5])
    b = np.array(blocks)
    y = np.maximum.accumulate((b[:, 1] + 0.5) / (b[:, 0] + 1))
    return b[:, 2] / b[:, 0], y


def apply(score: np.ndarray, knots: tuple[np.ndarray, np.ndarray], low: float, high: float) -> np.ndarray:
    """Calibrated scores. Ties inside flat blocks keep the raw order through a share of 1e-6."""
    return np.clip(np.interp(score, *knots) * (1 - 1e-6) + 1e-6 * np.clip((score - low) / (high - low), 0, 1), 0, 1)
