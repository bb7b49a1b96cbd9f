"""Numeric helpers for one series: arrays in, arrays out."""

from __future__ import annotations

import numpy as np


def least_squares(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Coefficients of the smallest norm."""
    return np.linalg.lstsq(x, y, rcond=None)[0]


def elastic_net(x: np.ndarray, y: np.ndarray, penalty: float, mixture: float) -> np.ndarray:
    """The exact optimum on standardised columns; the first column is the intercept and stays free.

    Works on the products of columns. Coefficients join one at a time, the one that pulls most first; those in use are
    solved for their signs, and a step ends where it lowers the penalised error most, at a zero or at the solution.
    Each step lowers the error, so it ends without a number of rounds; ``mixture`` is below 1.
    """
    mean, spread = x.mean(axis=0), x.std(axis=0)
    usable = spread > 1e-12
    spread = np.where(usable, spread, 1.0)
    z, centre = (x - mean) / spread, y.mean()
    curve = z.T @ z / len(y) + penalty * (1 - mixture) * np.eye(x.shape[1])
    moment, sparse = z.T @ (y - centre) / len(y), penalty * mixture
    still = 1e-9 * (np.abs(moment).max(initial=0.0) + sparse)

    def error(b: np.ndarray) -> float:
        return b @ curve @ b / 2 - moment @ b + sparse * np.abs(b).sum()

    beta = np.zeros(x.shape[1])
    while True:
        pull = moment - curve @ beta
        waiting = np.where(usable & (beta == 0), np.abs(pull) - sparse, 0.0)
        joins = int(waiting.argmax())
        if waiting[joins] <= still:
            break
        signs = np.sign(beta)
        signs[joins] = np.sign(pull[joins])
        before = error(beta)
        while True:
            used = np.flatnonzero(signs)
            goal = np.zeros_like(beta)
            goal[used] = np.linalg.solve(curve[np.ix_(used, used)], moment[used] - sparse * signs[used])
            crossing = used[beta[used] * goal[used] < 0]
            steps = [(beta + beta[c] / (beta[c] - goal[c]) * (goal - beta), c) for c in crossing]
            for point, c in steps:
                point[c] = 0.0
            beta = min([point for point, _ in steps] + [goal], key=error)
            if (np.sign(beta) == signs).all() or not len(crossing):
                break
            signs = np.sign(beta)
        if error(beta) >= before:
            break
    coefficients = beta / spread
    coefficients[0] = centre - coefficients[1:] @ mean[1:]
    return coefficients
