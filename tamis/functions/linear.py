"""Small p x p algebra on the driver; the sums it works on come from Spark aggregates."""

from __future__ import annotations

import numpy as np


def pinv(a: np.ndarray) -> np.ndarray:
    return np.linalg.pinv(a)


def bayesian_ridge(n, x_mean, xx, y_mean, xy, yy, rounds: int = 300, tol: float = 1e-3):
    """Evidence-maximizing ridge (MacKay 1992; Tipping 2001) from centred sums of products.

    ``xx``, ``xy``, ``yy`` are sums over rows of centred products. Returns weights and intercept.
    """
    p = len(x_mean)
    if n < 1 or p == 0:
        return np.zeros(p), float(y_mean)
    tiny = 1e-6
    values, vectors = np.linalg.eigh(xx)
    values = np.maximum(values, 0.0)
    projected = vectors.T @ xy
    noise = 1.0 / (yy / n + np.finfo(float).eps)
    scale = 1.0
    weights = np.zeros(p)
    for turn in range(rounds):
        updated = vectors @ (projected / (values + scale / noise))
        error = max(float(yy - 2 * updated @ xy + updated @ xx @ updated), 0.0)
        effective = float(np.sum(noise * values / (scale + noise * values)))
        scale = (effective + 2 * tiny) / (float(updated @ updated) + 2 * tiny)
        noise = (n - effective + 2 * tiny) / (error + 2 * tiny)
        moved = float(np.sum(np.abs(weights - updated)))
        weights = updated
        if turn and moved < tol:
            break
    weights = vectors @ (projected / (values + scale / noise))
    return weights, float(y_mean - x_mean @ weights)


def principal_axes(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues (largest first) and eigenvectors as rows; the largest loading is positive."""
    values, vectors = np.linalg.eigh(matrix)
    order = np.argsort(-values, kind="stable")
    rows = vectors.T[order]
    for row in rows:
        top = int(np.argmax(np.round(np.abs(row), 9)))
        if row[top] < 0:
            row *= -1
    return np.maximum(values[order], 0.0), rows
