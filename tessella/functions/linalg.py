"""Dense algebra on d x d matrices on the driver; d is the number of features, never the number of rows."""

from __future__ import annotations

import numpy as np

from ..errors import SingularMatrixError


def _factor(a: np.ndarray) -> np.ndarray:
    a = np.asarray(a, dtype=float)
    scale = np.sqrt(np.abs(np.diag(a)))
    if not np.isfinite(a).all() or (scale == 0).any():
        raise SingularMatrixError("a diagonal element is zero or not finite")
    try:
        low = np.linalg.cholesky(a / np.outer(scale, scale))
    except np.linalg.LinAlgError as e:
        raise SingularMatrixError(str(e)) from e
    if np.diag(low).min() < 1e-7:
        raise SingularMatrixError("columns are linearly dependent")
    return low * scale[:, None]


def cholesky_solve(a, b) -> np.ndarray:
    """Solves ``a @ t = b`` for a symmetric positive definite ``a``."""
    low = _factor(a)
    return np.linalg.solve(low.T, np.linalg.solve(low, np.asarray(b, dtype=float)))


def whitener(a) -> tuple[np.ndarray, float]:
    """``w`` with ``w.T @ w`` the inverse of ``a``, and the logarithm of its determinant."""
    low = _factor(a)
    return np.linalg.inv(low), 2.0 * float(np.log(np.diag(low)).sum())


def inverse_logdet(a) -> tuple[np.ndarray, float]:
    half, logdet = whitener(a)
    return half.T @ half, logdet
