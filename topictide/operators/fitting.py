"""Fits of one fold in one task: a model, the sigmoids that calibrate it, and its scores."""

from __future__ import annotations

import sys

import numpy as np
from pyspark import cloudpickle

from topictide.operators import trees

cloudpickle.register_pickle_by_value(sys.modules[__name__])

CLASSES = 3


def balanced_weights(y: np.ndarray) -> np.ndarray:
    n = np.bincount(y, minlength=CLASSES)
    return len(y) / (np.count_nonzero(n) * np.maximum(n, 1))[y]


def logistic(x: np.ndarray, y: np.ndarray, w: np.ndarray, penalty: float, rounds: int = 50):
    """Multinomial logistic regression on scaled columns, by Newton's method; returns the
    function from rows to probabilities. Intercepts have no penalty; a class without rows gets 0."""
    mean, spread = x.mean(axis=0), x.std(axis=0, ddof=1) if len(x) > 1 else np.ones(x.shape[1])
    spread = np.where(spread > 0, spread, np.inf)  # a constant column says nothing
    design = lambda z: np.column_stack([(z - mean) / spread, np.ones(len(z))])
    a, seen = design(x), np.unique(y)
    hot, d, k = (y[:, None] == seen).astype(float), x.shape[1] + 1, len(seen)
    ridge = np.append(np.full(d - 1, penalty), 1e-8)
    beta = np.zeros((k, d))

    def loss(b):
        s = a @ b.T
        top = s.max(axis=1)
        return float(w @ (top + np.log(np.exp(s - top[:, None]).sum(axis=1)) - (s * hot).sum(axis=1)) + 0.5 * (ridge * b * b).sum())

    for _ in range(rounds):
        p = trees.softmax(a @ beta.T)
        g = ((p - hot) * w[:, None]).T @ a + ridge * beta
        h = np.zeros((k, d, k, d))
        for i in range(k):
            for j in range(k):
                h[i, :, j, :] = (a * (w * p[:, i] * ((i == j) - p[:, j]))[:, None]).T @ a
            h[i, :, i, :] += np.diag(ridge)
        step = np.linalg.lstsq(h.reshape(k * d, k * d), g.ravel(), rcond=1e-12)[0].reshape(k, d)
        size, now = 1.0, loss(beta)
        while size > 1e-4 and loss(beta - size * step) > now:
            size /= 2
        beta = beta - size * step
        if np.abs(step).max() < 1e-7:
            break

    def predict(z: np.ndarray) -> np.ndarray:
        out = np.zeros((len(z), CLASSES))
        out[:, seen] = trees.softmax(design(z) @ beta.T)
        return out

    return predict


def log_odds(p: np.ndarray) -> np.ndarray:
    q = np.clip(p, 1e-6, 1 - 1e-6)
    return np.log(q / (1 - q))


def sigmoid(z: np.ndarray, y: np.ndarray, rounds: int = 25) -> tuple[float, float]:
    """Slope and intercept of the logistic curve through (z, y), by Newton's method."""
    a, b = 1.0, 0.0
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a * z + b, -500, 500)))
        off, s = p - y, p * (1 - p)
        h = np.array([[(s * z * z).sum(), (s * z).sum()], [(s * z).sum(), s.sum()]]) + 1e-9 * np.eye(2)
        step = np.clip(np.linalg.solve(h, [(off * z).sum(), off.sum()]), -5, 5)
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-6 or max(abs(a), abs(b)) > 50:
            break
    return (float(a), float(np.clip(b, -50, 50))) if np.isfinite(a) and abs(a) <= 50 else (1.0, 0.0)


def fitted(params: trees.Params | None, ids: np.ndarray, x: np.ndarray, y: np.ndarray, w: np.ndarray, penalty: float):
    if params is None:
        return logistic(x, y, w, penalty)
    return trees.fit_in_task(params, ids, x, y, np.ones(len(y)) if params.kind == "boosting" else w).probabilities


def shares(p: np.ndarray) -> np.ndarray:
    whole = p.sum(axis=1, keepdims=True)
    return np.where(whole > 0, p / np.where(whole > 0, whole, 1.0), p)


def fold_scores(params: trees.Params | None, ids: np.ndarray, x: np.ndarray, y: np.ndarray, held: np.ndarray, calibrate: bool) -> np.ndarray:
    """Probabilities of the held rows by a model of the others; classes not seen get 0."""
    w, n = balanced_weights(y), np.bincount(y, minlength=CLASSES)
    p = fitted(params, ids, x, y, w, 1.0)(held)
    folds = min(3, int(n[n > 0].min()))
    if calibrate and folds >= 2:
        part, own = np.mod(ids, folds), np.zeros((len(y), CLASSES))
        for i in range(folds):
            rest = part != i
            if rest.any() and not rest.all():
                own[~rest] = fitted(params, ids[rest], x[rest], y[rest], w[rest], rest.sum() / len(y))(x[~rest])
        curves = [sigmoid(log_odds(own[:, c]), (y == c).astype(float)) for c in range(CLASSES)]
        p = shares(np.column_stack([1 / (1 + np.exp(-(a * log_odds(p[:, c]) + b))) for c, (a, b) in enumerate(curves)]))
    return shares(p * (n > 0))
