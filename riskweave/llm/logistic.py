"""Logistic regression of a bounded sample, on the driver."""

from __future__ import annotations

import numpy as np


def fit_logistic(x: np.ndarray, y: np.ndarray, *, ridge: float = 1.0, steps: int = 50) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Means and deviations of the columns and the weights (intercept first), by damped Newton steps."""
    mean, scale = x.mean(axis=0), x.std(axis=0)
    scale[scale == 0] = 1
    a = np.column_stack([np.ones(len(x)), (x - mean) / scale])
    penalty = np.full(a.shape[1], ridge)
    penalty[0] = 1e-6
    w = np.zeros(a.shape[1])

    def loss(w):
        z = a @ w
        return np.logaddexp(0, z).sum() - (y * z).sum() + 0.5 * (penalty * w * w).sum()

    now = loss(w)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        gradient = a.T @ (p - y) + penalty * w
        hessian = (a * (p * (1 - p))[:, None]).T @ a + np.diag(penalty)
        step = np.linalg.solve(hessian, gradient)
        size = 1.0
        while (following := loss(w - size * step)) > now and size > 1e-4:
            size /= 2
        w = w - size * step
        if now - following < 1e-7 * max(1.0, abs(now)):
            break
        now = following
    return mean, scale, w
