"""Logistic calibration of one number, fitted on a bounded sample."""

from __future__ import annotations

import numpy as np


def platt(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3, steps: int = 50) -> tuple[float, float]:
    """(scale, offset) so that the logistic function of scale * x + offset fits labels y of 0 and 1, softened by their counts."""
    if len(x) == 0 or len(np.unique(y)) < 2:
        share = (y.sum() + 1) / (len(y) + 2)
        return 0.0, float(np.log(share / (1 - share)))
    n1, n0 = y.sum(), len(y) - y.sum()
    t = np.where(y > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    middle, wide = x.mean(), x.std() or 1.0
    a = np.stack(((x - middle) / wide, np.ones(len(x))), axis=1)
    w = np.array([0.0, np.log((n1 + 1) / (n0 + 1))])
    penalty = np.diag([ridge * len(x), 0.0])

    def loss(w: np.ndarray) -> float:
        m = a @ w
        return float((np.logaddexp(0, m) - t * m).sum() + 0.5 * w @ penalty @ w)

    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -35, 35)))
        step = np.linalg.solve(a.T @ (a * (p * (1 - p))[:, None]) + penalty + 1e-9 * np.eye(2), a.T @ (p - t) + penalty @ w)
        size = 1.0
        while size > 1e-6 and loss(w - size * step) > loss(w):
            size /= 2
        w = w - size * step
        if np.abs(size * step).max() < 1e-8:
            break
    return float(w[0] / wide), float(w[1] - w[0] * middle / wide)


def rising(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots of a rising curve through labels y of 0 and 1, by pooling neighbours that fall; interpolate between them."""
    if not len(x):
        return np.array([0.0]), np.array([0.5])
    order = np.argsort(x, kind="stable")
    mean = float(y.mean())
    blocks: list[list[float]] = []  # labels' sum, count, first and last x
    for at, label in zip(x[order].tolist(), y[order].tolist()):
        blocks.append([label, 1.0, at, at])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            label_sum, count, _, last = blocks.pop()
            blocks[-1] = [blocks[-1][0] + label_sum, blocks[-1][1] + count, blocks[-1][2], last]
    knots = np.array([(first + last) / 2 for _, _, first, last in blocks])
    return knots, np.maximum.accumulate(np.array([(s + mean) / (n + 1) for s, n, _, _ in blocks]))
