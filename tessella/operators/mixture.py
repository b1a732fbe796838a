"""Gaussian mixtures fitted by expectation-maximisation: one pass per step. A null feature stops the job."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import DimensionMismatchError
from ..functions.expr import Feature, features, gaussian_log_density, log_sum_exp, softmax, softmax_array
from ..functions.linalg import whitener
from . import kmeans
from .gram import gram
from .sampling import kept, sample_n


@dataclass(frozen=True)
class Mixture:
    mixing: np.ndarray
    mu: np.ndarray
    covariance: np.ndarray

    def to_dict(self) -> dict:
        return {"mixing": self.mixing.tolist(), "mu": self.mu.tolist(), "covariance": self.covariance.tolist()}

    @classmethod
    def from_dict(cls, d: dict) -> Mixture:
        return cls(np.array(d["mixing"], float), np.array(d["mu"], float), np.array(d["covariance"], float))

    def to_json(self) -> str:
        return json.dumps(self.to_dict())

    @classmethod
    def from_json(cls, text: str) -> Mixture:
        return cls.from_dict(json.loads(text))


def log_terms(model: Mixture, x: Sequence[Feature]) -> list[Column]:
    if len(x) != model.mu.shape[1]:
        raise DimensionMismatchError(model.mu.shape[1], len(x))
    columns = features(x)
    return [F.lit(float(np.log(p))) + gaussian_log_density(columns, m, c) for p, m, c in zip(model.mixing, model.mu, model.covariance, strict=True)]


def responsibilities(model: Mixture, x: Sequence[Feature]) -> list[Column]:
    """Share of each component in each row, a column per component; sums to one even where all densities underflow. For a handful of components."""
    return softmax(log_terms(model, x))


def with_responsibilities(df: DataFrame, model: Mixture, x: Sequence[Feature], into: str = "responsibilities") -> DataFrame:
    """Adds all shares as one array; every density is computed once, whatever the number of components."""
    return df.withColumn(into, softmax_array(log_terms(model, x)))


def log_likelihood(df: DataFrame, model: Mixture, x: Sequence[Feature]) -> float:
    return df.agg(F.sum(log_sum_exp(log_terms(model, x)))).first()[0]


#: Up to this many sums a step is aggregate expressions, beyond that Arrow blocks; the results are the same.
EXPRESSION_SUMS = 48


def _sums(named: DataFrame, model: Mixture) -> tuple[float, np.ndarray, np.ndarray, np.ndarray]:
    """Rows, and by component the sums of shares, of shares times gaps to the old mean, and of shares times products of gaps."""
    k, d = model.mu.shape
    halves, offsets = [], []
    for p, c in zip(model.mixing, model.covariance, strict=True):
        half, logdet = whitener(c)
        halves.append(half)
        offsets.append(np.log(p) - 0.5 * (d * np.log(2 * np.pi) + logdet))
    mu = model.mu

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, w, a, b = 0, np.zeros(k), np.zeros((k, d)), np.zeros((k, d, d))
        for batch in batches:
            x = np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.columns])
            logs = np.stack([o - 0.5 * np.square((x - m) @ h.T).sum(1) for o, m, h in zip(offsets, mu, halves, strict=True)])
            r = np.exp(logs - logs.max(0))
            r /= r.sum(0)
            n += len(x)
            w += r.sum(1)
            for j in range(k):
                gap = x - mu[j]
                shared = gap * r[j][:, None]
                a[j] += shared.sum(0)
                b[j] += shared.T @ gap
        s = np.concatenate([[n], w, a.ravel(), b.ravel()])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(s)), pa.int32()), pa.array(s)], names=["i", "s"])

    s = np.zeros(1 + k + k * d + k * d * d)
    for r in named.mapInArrow(blocks, "i int, s double").groupBy("i").agg(F.sum("s").alias("s")).collect():
        s[r["i"]] = r["s"]
    return s[0], s[1 : 1 + k], s[1 + k : 1 + k + k * d].reshape(k, d), s[1 + k + k * d :].reshape(k, d, d)


def _sums_by_expressions(named: DataFrame, model: Mixture) -> tuple[float, np.ndarray, np.ndarray, np.ndarray]:
    k, d = model.mu.shape
    shares = named.select("*", *[r.alias(f"r{j}") for j, r in enumerate(responsibilities(model, named.columns))])
    aggs = [F.count(F.lit(1)).alias("n")]
    for j in range(k):
        gap = [F.col(f"x{i}") - F.lit(float(model.mu[j, i])) for i in range(d)]
        r = F.col(f"r{j}")
        aggs += [F.sum(r).alias(f"w{j}"), *[F.sum(r * gap[i]).alias(f"a{j}_{i}") for i in range(d)]]
        aggs += [F.sum(r * gap[i] * gap[m]).alias(f"b{j}_{i}_{m}") for i in range(d) for m in range(i, d)]
    row = shares.agg(*aggs).first()
    if not row["n"]:
        return 0.0, np.zeros(k), np.zeros((k, d)), np.zeros((k, d, d))
    return float(row["n"]), np.array([row[f"w{j}"] for j in range(k)]), np.array([[row[f"a{j}_{i}"] for i in range(d)] for j in range(k)]), np.array([[[row[f"b{j}_{min(i, m)}_{max(i, m)}"] for m in range(d)] for i in range(d)] for j in range(k)])


def em_step(df: DataFrame, model: Mixture, x: Sequence[Feature]) -> Mixture:
    """One E and M step. Products are summed about the old means, so large means do not cancel."""
    k, d = model.mu.shape
    if len(x) != d:
        raise DimensionMismatchError(d, len(x))
    named = df.select(*[c.alias(f"x{i}") for i, c in enumerate(features(x))])
    few = k * (d + 1) * (d + 2) // 2 <= EXPRESSION_SUMS
    n, w, a, b = (_sums_by_expressions if few else _sums)(named, model)
    if not n:
        raise ValueError("no rows")
    if not np.isfinite(w).all():
        raise ValueError("a feature is not finite")
    if (w <= 0).any():
        raise ValueError(f"component {int(np.argmin(w))} has no weight left")
    gap = a / w[:, None]
    return Mixture(w / n, model.mu + gap, b / w[:, None, None] - gap[:, :, None] * gap[:, None, :])


def means_moved(a: Mixture, b: Mixture) -> float:
    return float(np.linalg.norm(a.mu - b.mu, axis=1).sum())


def fit(df: DataFrame, model: Mixture, x: Sequence[Feature], iteration_limit: int = 10, tolerance: float = 0.01, on_step: Callable[[int, Mixture], None] | None = None) -> tuple[Mixture, int]:
    """Steps until the means move by no more than ``tolerance`` in all, at most ``iteration_limit - 1`` of them.

    The input is read once and kept. ``on_step`` sees every state, for example to store it.
    """
    with kept(df.select(*[c.alias(f"x{i}") for i, c in enumerate(features(x))])) as held:
        names, steps, moved = held.columns, 0, np.inf
        while moved > tolerance and steps + 1 < iteration_limit:
            new = em_step(held, model, names)
            moved, model, steps = means_moved(model, new), new, steps + 1
            if on_step:
                on_step(steps, model)
    return model, steps


def from_clusters(df: DataFrame, x: Sequence[Feature], centroids) -> Mixture:
    """Shares, means and population covariances of the clusters around fixed centroids."""
    k, d = np.asarray(centroids).shape
    named = df.select(*[c.alias(f"x{i}") for i, c in enumerate(features(x))])
    names = [f"x{i}" for i in range(d)]
    groups = gram(kmeans.assign(named, names, centroids), names, by="cluster")
    if len(groups) < k:
        raise ValueError("a cluster is empty")
    found = [groups[j] for j in range(k)]
    n = np.array([g.n for g in found])
    return Mixture(n / n.sum(), np.array([g.mean for g in found]), np.array([g.covariance for g in found]))


def init(df: DataFrame, x: Sequence[Feature], k: int, sample_size: int, reruns: int = 10, iteration_limit: int = 100, tolerance: float = 0.01, seed: int = 0, key: str | None = None) -> Mixture:
    """Sample, cluster, then the moments of the clusters."""
    with kept(sample_n(df, sample_size, seed, key)) as sample:
        return from_clusters(sample, x, kmeans.best_of(sample, x, k, reruns, iteration_limit, tolerance, seed, key).centroids)
