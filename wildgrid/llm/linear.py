"""Small linear models, fitted on bounded samples."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -35.0, 35.0)))


def descend(size: int, gradient: Callable[[np.ndarray], np.ndarray], steps: int, rate: float = 0.05) -> np.ndarray:
    """Weights after ``steps`` of Adam from zero."""
    w, m, v = np.zeros(size), np.zeros(size), np.zeros(size)
    for k in range(1, steps + 1):
        g = gradient(w)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= rate * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.999**k)) + 1e-8)
    return w


def with_bias(x: np.ndarray) -> np.ndarray:
    return np.hstack([x, np.ones((len(x), 1))])


def fit_logistic(
    x: np.ndarray, target: np.ndarray, decay: float = 1e-4, steps: int = 400, weights: np.ndarray | None = None
) -> np.ndarray:
    """Weights, bias last, of a logistic regression on soft labels of weighted rows."""
    x = with_bias(x)
    if not len(x):
        return np.zeros(x.shape[1])
    row = np.ones(len(x)) if weights is None else weights
    row = row / row.sum()
    held = np.append(np.full(x.shape[1] - 1, decay), 0.0)
    return descend(x.shape[1], lambda w: x.T @ (row * (sigmoid(x @ w) - target)) + held * w, steps)


def calibrate(scores: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """Slope and intercept that turn raw scores into log odds; targets are smoothed."""
    positive, negative = int((labels == 1).sum()), int((labels == 0).sum())
    if not positive or not negative:
        return 1.0, 0.0
    target = np.where(labels == 1, (positive + 1) / (positive + 2), 1 / (negative + 2))
    scale = float(np.std(scores)) or 1.0
    slope, intercept = fit_logistic((scores / scale)[:, None], target, 0.0, 1500)
    return max(float(slope) / scale, 1e-6), float(intercept)
