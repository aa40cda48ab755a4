"""Linear support vector machines by dual coordinate descent (Hsieh et al., ICML 2008), on rows of sparse features."""

from __future__ import annotations

import numpy as np


def fit_hinge(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, width: int, cost: np.ndarray | float = 1.0, passes: int = 20, seed: int = 7, tol: float = 1e-3) -> np.ndarray:
    """Weights (the last one is the bias) that minimise |w|²/2 + sum of cost * max(0, 1 - y w.x).

    ``rows``: (distinct indices, values) of each example; ``labels``: +1 or -1; ``cost``: one number or one per row.
    Coordinates are visited in a seeded random order, so a fit depends on nothing but its input. Without rows, zeros.
    """
    w = np.zeros(width + 1)
    n = len(rows)
    costs = np.broadcast_to(np.asarray(cost, float), (n,))
    alpha = np.zeros(n)
    square = np.array([float(v @ v) + 1.0 for _, v in rows])
    rng = np.random.default_rng(seed)
    for _ in range(passes):
        most = 0.0
        for i in rng.permutation(n):
            index, value = rows[i]
            y = labels[i]
            slope = y * (float(w[index] @ value) + w[width]) - 1.0
            new = min(max(alpha[i] - slope / square[i], 0.0), costs[i])
            step = (new - alpha[i]) * y
            if step:
                w[index] += step * value
                w[width] += step
                alpha[i] = new
                most = max(most, abs(step) * square[i])
        if most < tol:
            break
    return w


def margins(rows: list[tuple[np.ndarray, np.ndarray]], w: np.ndarray) -> np.ndarray:
    return np.array([float(w[index] @ value) + w[-1] for index, value in rows])


def fit_sigmoid(margin: np.ndarray, positive: np.ndarray, rounds: int = 100) -> tuple[float, float]:
    """(a, b) of Platt's 1 / (1 + exp(-(a m + b))), with his smoothed targets, by damped Newton steps."""
    up, down = float(positive.sum()), float((~positive).sum())
    target = np.where(positive, (up + 1) / (up + 2), 1 / (down + 2))
    a, b = 1.0, float(np.log((up + 1) / (down + 1)))
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a * margin + b, -35, 35)))
        d, h = p - target, np.maximum(p * (1 - p), 1e-9)
        grad = np.array([float(d @ margin) + 1e-3 * a, float(d.sum())])
        hess = np.array([[float(h @ margin**2) + 1e-3, float(h @ margin)], [float(h @ margin), float(h.sum()) + 1e-6]])
        step = np.clip(np.linalg.solve(hess, grad), -1, 1)
        a, b = a - float(step[0]), b - float(step[1])
        if np.abs(step).max() < 1e-6:
            break
    return a, b
