"""Linear support vector machines with squared hinge loss, for models that fit on the driver."""

from __future__ import annotations

import numpy as np


def fit_linear_svm(x: np.ndarray, y: np.ndarray, c: float = 10.0, steps: int = 300, weight: np.ndarray | None = None) -> np.ndarray:
    """Weights and a last bias for labels of +1 and -1.

    Minimises |w|^2 / 2 + c * mean(weight * max(0, 1 - y f)^2) by accelerated
    gradient descent with restarts; the bias is not penalised.
    """
    n, d = x.shape
    x, y = np.ascontiguousarray(x, np.float32), y.astype(np.float32)
    weight = np.ones(n, np.float32) if weight is None else (weight / weight.mean()).astype(np.float32)
    rough = np.ones(d + 1, np.float32) / np.float32(np.sqrt(d + 1))
    for _ in range(15):  # the largest curvature, by power iteration
        rough = np.append(x.T @ (u := weight * (x @ rough[:-1] + rough[-1])), u.sum())
        rough /= max(1e-12, np.linalg.norm(rough))
    top = float((weight * (x @ rough[:-1] + rough[-1]) ** 2).sum())
    rate = 1.0 / (1.0 + 2.2 * c * top / n)
    w, v, t, last = np.zeros(d + 1, np.float32), np.zeros(d + 1, np.float32), 1.0, np.inf
    for _ in range(steps):
        slack = np.maximum(0.0, 1.0 - y * (x @ v[:-1] + v[-1]))
        pull = (-2.0 * c / n) * weight * slack * y
        new = v - np.float32(rate) * (np.append(x.T @ pull, pull.sum()) + np.append(v[:-1], np.float32(0)))
        value = 0.5 * v[:-1] @ v[:-1] + c / n * (weight * slack**2).sum()
        if value > last:
            t = 1.0
        elif last - value < 1e-5 * value:
            break
        nt = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, w, t, last = new + np.float32((t - 1) / nt) * (new - w), new, nt, value
    return w


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(z, -500, 500)))
