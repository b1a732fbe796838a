"""Lloyd's algorithm: assignments are expressions, one aggregate per step. A null feature stops the job."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.expr import Feature, features, nearest
from .sampling import kept, sample_n


@dataclass(frozen=True)
class Clusters:
    centroids: np.ndarray
    loss: float
    steps: int


def assign(df: DataFrame, x: Sequence[Feature], centroids, into: str = "cluster") -> DataFrame:
    """Adds the index of the nearest centroid; the first wins ties."""
    return df.withColumn(into, nearest(features(x), np.asarray(centroids, float))[0])


def loss(df: DataFrame, x: Sequence[Feature], centroids) -> DataFrame:
    """One row ``loss``: the sum of squared distances to the nearest centroid."""
    return df.agg(F.sum(nearest(features(x), np.asarray(centroids, float))[1]).alias("loss"))


def step(df: DataFrame, x: Sequence[Feature], centroids) -> tuple[np.ndarray, np.ndarray, float]:
    """New centroids, cluster sizes and the loss of the assignment. An empty cluster keeps its centroid."""
    old = np.asarray(centroids, float)
    columns = features(x)
    index, least = nearest(columns, old)
    named = df.select(*[c.alias(f"x{i}") for i, c in enumerate(columns)], index.alias("k"), least.alias("l"))
    new, sizes, lost = old.copy(), np.zeros(len(old), int), 0.0
    for r in named.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.sum("l").alias("l"), *[F.avg(f"x{i}").alias(f"m{i}") for i in range(len(columns))]).collect():
        new[r["k"]] = [r[f"m{i}"] for i in range(len(columns))]
        sizes[r["k"]] = r["n"]
        lost += r["l"]
    return new, sizes, lost


def lloyd(df: DataFrame, x: Sequence[Feature], centroids, iteration_limit: int = 100, tolerance: float = 0.01) -> Clusters:
    """Stops when the loss falls by no more than ``tolerance``, or at the limit."""
    now, last, steps = np.asarray(centroids, float), np.inf, 0
    while steps < iteration_limit:
        new, _, lost = step(df, x, now)
        steps += 1
        if last - lost <= tolerance:
            return Clusters(now, lost, steps)
        now, last = new, lost
    return Clusters(now, step(df, x, now)[2], steps)


def initial_centroids(df: DataFrame, x: Sequence[Feature], k: int, seed: int = 0, key: str | None = None) -> np.ndarray:
    rows = sample_n(df, k, seed, key).select(*[c.alias(f"x{i}") for i, c in enumerate(features(x))]).collect()
    if len(rows) < k:
        raise ValueError(f"{k} clusters need as many rows; there are {len(rows)}")
    return np.array([list(r) for r in rows])


def best_of(df: DataFrame, x: Sequence[Feature], k: int, reruns: int = 10, iteration_limit: int = 100, tolerance: float = 0.01, seed: int = 0, key: str | None = None) -> Clusters:
    """The run with the smallest loss; ``df`` is read once and kept for all runs. A frame that the caller keeps stays kept."""
    if reruns < 1:
        raise ValueError("reruns must be positive")
    with kept(df) as held:
        runs = [lloyd(held, x, initial_centroids(held, x, k, seed + r, key), iteration_limit, tolerance) for r in range(reruns)]
    return min(runs, key=lambda r: r.loss)
