"""Sparse logistic regression and probability calibration, trained on a bounded sample."""

from __future__ import annotations

import numpy as np


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def fit_logistic(
    rows: np.ndarray, columns: np.ndarray, values: np.ndarray, y: np.ndarray, size: int, steps: int = 80, penalty: float = 1e-5
) -> tuple[np.ndarray, float]:
    """Weights and offset by accelerated gradient steps over entries sorted by row; both classes weigh the same.

    Rows are taken to have length 1, which bounds the step.
    """
    n, ones = len(y), max(int(y.sum()), 1)
    share = np.where(y, 0.5 / ones, 0.5 / max(n - ones, 1))
    weights = momentum = np.zeros(size + 1)
    step_size = 1 / (0.5 + penalty)
    for step in range(1, steps + 1):
        score = np.bincount(rows, weights=values * momentum[columns], minlength=n) + momentum[-1]
        error = share * (sigmoid(score) - y)
        gradient = penalty * momentum
        gradient[:-1] += np.bincount(columns, weights=values * error[rows], minlength=size)
        gradient[-1] += error.sum()
        new = momentum - step_size * gradient
        momentum = new + step / (step + 3) * (new - weights)
        weights = new
    return weights[:-1], float(weights[-1])


def fit_platt(scores: np.ndarray, y: np.ndarray, steps: int = 60) -> tuple[float, float]:
    """Slope and offset that turn scores into probabilities, by damped Newton steps; targets are kept off 0 and 1."""
    ones = int(y.sum())
    target = np.where(y, (ones + 1) / (ones + 2), 1 / (len(y) - ones + 2))
    x = np.stack([scores, np.ones(len(scores))], axis=1)
    theta = np.array([1.0, 0.0])
    for _ in range(steps):
        p = sigmoid(x @ theta)
        gradient = x.T @ (p - target) / len(y) + 1e-6 * theta
        curve = (x * (p * (1 - p))[:, None]).T @ x / len(y) + 1e-6 * np.eye(2)
        step = np.linalg.solve(curve, gradient)
        theta = theta - step / max(1.0, float(np.abs(step).max()) / 4)
    return float(theta[0]), float(theta[1])
