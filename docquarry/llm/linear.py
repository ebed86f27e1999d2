"""Linear models over sparse rows, trained on the driver from bounded samples."""

from __future__ import annotations

import numpy as np

Rows = list[tuple[np.ndarray, np.ndarray]]


def hinge_dual(rows: Rows, y: np.ndarray, size: int, cost: np.ndarray, rounds: int = 20, seed: int = 0) -> tuple[np.ndarray, float]:
    """L2-regularised hinge loss by dual coordinate descent. y is +1 or -1; cost bounds each dual.

    Returns the weights and the bias (the weight of a feature that is always 1).
    """
    w, bias = np.zeros(size), 0.0
    duals = np.zeros(len(rows))
    norms = np.array([float(v @ v) + 1.0 for _, v in rows])
    order = np.random.default_rng(seed)
    for _ in range(rounds):
        moved = 0.0
        for i in order.permutation(len(rows)):
            at, v = rows[i]
            slope = y[i] * (float(w[at] @ v) + bias) - 1.0
            new = min(max(duals[i] - slope / norms[i], 0.0), cost[i])
            step = (new - duals[i]) * y[i]
            if step:
                w[at] += step * v
                bias += step
                moved += abs(step)
                duals[i] = new
        if moved < 1e-4 * max(1.0, duals.sum()):
            break
    return w, bias


def sigmoid_fit(margins: np.ndarray, y: np.ndarray, rounds: int = 50) -> tuple[float, float]:
    """Platt's sigmoid: P(y = 1) = 1 / (1 + exp(-(a * margin + b))), by damped Newton steps."""
    pos, neg = (y > 0).sum(), (y <= 0).sum()
    goal = np.where(y > 0, (pos + 1) / (pos + 2), 1 / (neg + 2))
    a, b = 1.0, 0.0
    x = np.stack([margins, np.ones(len(margins))], axis=1)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a * margins + b, -30, 30)))
        grad = x.T @ (p - goal)
        hess = (x * (p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2)
        step = np.linalg.solve(hess, grad)
        step *= min(1.0, 2.0 / (np.abs(step).max() + 1e-12))
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-6:
            break
    return max(a, 1e-3), b
