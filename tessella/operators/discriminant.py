"""Linear and quadratic Gaussian discriminant analysis."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import TargetValueError
from ..functions.expr import Feature, features, gaussian_log_density, softmax
from .gram import gram


@dataclass(frozen=True)
class GaussianClasses:
    targets: list
    counts: np.ndarray
    means: np.ndarray
    scatter: np.ndarray  # per class, not divided by its count

    @property
    def total(self) -> int:
        return int(self.counts.sum())

    @property
    def priors(self) -> np.ndarray:
        return self.counts / self.counts.sum()

    @property
    def covariances(self) -> np.ndarray:
        return self.scatter / self.counts[:, None, None]

    def pooled(self, unbiased: bool = False) -> np.ndarray:
        return self.scatter.sum(0) / (self.total - (len(self.targets) if unbiased else 0))

    def log_terms(self, x: Sequence[Feature], method: str = "QDA", unbiased: bool = False) -> list[Column]:
        """Log of prior times density for each target; QDA uses each class's covariance, LDA the pooled one."""
        if method not in ("QDA", "LDA"):
            raise ValueError("method must be 'QDA' or 'LDA'")
        covs = self.covariances if method == "QDA" else [self.pooled(unbiased)] * len(self.targets)
        columns = features(x)
        return [F.lit(float(np.log(p))) + gaussian_log_density(columns, m, c) for p, m, c in zip(self.priors, self.means, covs, strict=True)]

    def posterior(self, x: Sequence[Feature], method: str = "QDA", unbiased: bool = False) -> list[Column]:
        """P(class | x) as a column per target; for a handful of targets (``with_posteriors`` takes many)."""
        return softmax(self.log_terms(x, method, unbiased))

    @classmethod
    def from_dict(cls, targets: Sequence, d: dict) -> GaussianClasses:
        if len(targets) != len(d["class counts"]):
            raise ValueError(f"{len(targets)} targets for {len(d['class counts'])} classes")
        return cls(list(targets), np.array(d["class counts"], float), np.array(d["means"], float), np.array(d["covariates"], float))

    def to_dict(self) -> dict:
        return {"total": self.total, "class counts": [int(c) for c in self.counts], "means": self.means.tolist(), "covariates": self.scatter.tolist()}


def fit_gda(df: DataFrame, label: str, x: Sequence[Feature], targets: Sequence | None = None) -> GaussianClasses:
    """Counts, means and scatter matrices by class in one pass. A label outside ``targets``, or a null one, is an error, not filtered."""
    groups = gram(df, x, by=label)
    if not groups:
        raise ValueError("no rows")
    if None in groups:
        raise TargetValueError(None, targets or sorted(g for g in groups if g is not None))
    targets = sorted(groups) if targets is None else list(targets)
    for found in groups:
        if found not in targets:
            raise TargetValueError(found, targets)
    missing = [t for t in targets if t not in groups]
    if missing:
        raise ValueError(f"no rows for {missing}")
    return GaussianClasses(targets, np.array([groups[t].n for t in targets]), np.array([groups[t].mean for t in targets]), np.array([groups[t].centred for t in targets]))


def with_posteriors(df: DataFrame, model: GaussianClasses, x: Sequence[Feature], keep: Sequence[str], method: str = "QDA") -> DataFrame:
    """Long form: a row per input row and class with its probability.

    The log densities go through one array, so the plan grows with the number of classes, not its square.
    """
    logs = df.select(*keep, F.array(*model.log_terms(x, method)).alias("_logs"))
    # The generator between the steps keeps the array from being written out once per use.
    held = logs.select(*keep, F.inline(F.array(F.struct(F.col("_logs").alias("_l"))))).withColumn("_top", F.array_max("_l"))
    whole = F.aggregate(F.col("_l"), F.lit(0.0), lambda a, v: a + F.exp(v - F.col("_top")))
    shares = held.select(*keep, F.col("_l"), F.col("_top"), whole.alias("_w")).select(*keep, "_top", "_w", F.posexplode("_l").alias("_k", "_v"))
    names = F.array(*[F.lit(t) for t in model.targets])
    return shares.select(*keep, names[F.col("_k")].alias("target"), (F.exp(F.col("_v") - F.col("_top")) / F.col("_w")).alias("probability"))
