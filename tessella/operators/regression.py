"""Ordinary and ridge regression from one grouped aggregate; the solve is d x d, on the driver."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.expr import Feature, col, total
from ..functions.linalg import cholesky_solve
from .gram import Gram, gram, merge
from .sampling import priority, sample_bound

SCALINGS = (None, "z-score", "max-min")


@dataclass(frozen=True)
class LinearModel:
    """``theta`` by feature; ``intercept`` is None for a model without a constant."""

    theta: np.ndarray
    intercept: float | None
    observations: int

    @property
    def coefficients(self) -> list[float]:
        """The constant, if any, comes last."""
        return [*map(float, self.theta), *([] if self.intercept is None else [float(self.intercept)])]

    def predict(self, x: Sequence[Feature]) -> Column:
        return total([F.lit(float(t)) * col(c) for t, c in zip(self.theta, x, strict=True)]) + F.lit(self.intercept or 0.0)

    def to_df(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(i, c) for i, c in enumerate(self.coefficients)], "i int, coefficient double")


def ols(df: DataFrame, x: Sequence[Feature], y: Feature, bias: bool = True) -> LinearModel:
    """Least squares by the normal equations, centred if there is a constant."""
    g = gram(df, x, y).get(None)
    if g is None:
        raise ValueError("no rows")
    d = len(x)
    if not bias:
        return LinearModel(cholesky_solve(g.raw[:d, :d], g.raw[:d, d]), None, int(g.n))
    theta = cholesky_solve(g.centred[:d, :d], g.centred[:d, d])
    return LinearModel(theta, float(g.mean[d] - theta @ g.mean[:d]), int(g.n))


@dataclass(frozen=True)
class RidgeModel:
    """Acts on centred features times ``scale``; ``bias_term`` is the mean of y."""

    theta: np.ndarray
    bias_term: float
    centre: np.ndarray
    scale: np.ndarray
    penalty: float
    errors: dict[float, float] | None = None

    def predict(self, x: Sequence[Feature]) -> Column:
        return F.lit(self.bias_term) + total([F.lit(float(t * s)) * (col(c) - F.lit(float(m))) for t, s, m, c in zip(self.theta, self.scale, self.centre, x, strict=True)])

    def to_dict(self) -> dict:
        return {"bias_term": self.bias_term, "theta": [float(t) for t in self.theta]}


def _scale(g: Gram, d: int, scaling: str | None) -> np.ndarray:
    if scaling not in SCALINGS:
        raise ValueError(f"scaling must be one of {SCALINGS}")
    if scaling is None:
        return np.ones(d)
    width = np.sqrt(np.diag(g.covariance)[:d]) if scaling == "z-score" else (g.high - g.low)[:d]
    if (width <= 0).any():
        raise ValueError("a feature is constant and cannot be scaled")
    return 1.0 / width


def _solve(g: Gram, d: int, penalty: float, scaling: str | None) -> RidgeModel:
    s = _scale(g, d, scaling)
    theta = cholesky_solve(g.centred[:d, :d] * np.outer(s, s) + penalty * np.eye(d), g.centred[:d, d] * s)
    return RidgeModel(theta, float(g.mean[d]), g.mean[:d], s, penalty)


def ridge(df: DataFrame, x: Sequence[Feature], y: Feature, penalty: float, scaling: str | None = None) -> RidgeModel:
    """(S X'X S + penalty I) theta = S X'y on centred columns; S holds 1, 1/sigma or 1/(max - min)."""
    g = gram(df, x, y).get(None)
    if g is None:
        raise ValueError("no rows")
    return _solve(g, len(x), penalty, scaling)


def hold_out_error(model: RidgeModel, held: Gram) -> float:
    """Mean squared error on the hold-out, from its moments alone."""
    d = len(model.theta)
    t = model.theta * model.scale
    gap = held.mean[d] - model.bias_term - t @ (held.mean[:d] - model.centre)
    return float((held.centred[d, d] - 2 * t @ held.centred[:d, d] + t @ held.centred[:d, :d] @ t) / held.n + gap * gap)


def ridge_select(df: DataFrame, x: Sequence[Feature], y: Feature, penalties: Sequence[float], key: str, hold_out: int = 1000, scaling: str | None = None, seed: int = 0) -> RidgeModel:
    """Fits every penalty on the rows outside a keyed hold-out sample, takes the smallest error there
    (the first on ties) and refits on all rows. Two passes, whatever the number of penalties."""
    if not penalties:
        raise ValueError("no penalties given")
    bound = sample_bound(df, hold_out, seed, key)
    if bound is None:
        raise ValueError("the hold-out is empty")
    parts = gram(df, x, y, by=priority(key, seed) <= F.lit(bound))
    if set(parts) != {True, False}:
        raise ValueError("the hold-out takes all rows")
    d = len(x)
    errors = {p: hold_out_error(_solve(parts[False], d, p, scaling), parts[True]) for p in penalties}
    best = min(penalties, key=errors.get)
    final = _solve(merge(parts[False], parts[True]), d, best, scaling)
    return RidgeModel(final.theta, final.bias_term, final.centre, final.scale, best, errors)
