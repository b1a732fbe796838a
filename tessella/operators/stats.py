"""Multivariate descriptive statistics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expr import Feature, col


def skewness_g1(x: Feature) -> Column:
    """Sample skewness with the bias correction; null below three rows."""
    c, n = col(x), F.count(col(x)).cast("double")
    return F.when(n > 2, F.skewness(c) * F.sqrt(n * (n - 1)) / F.nullif(n - 2, F.lit(0.0)))


def kurtosis_g2(x: Feature) -> Column:
    """Sample excess kurtosis with the bias correction; null below four rows."""
    c, n = col(x), F.count(col(x)).cast("double")
    return F.when(n > 3, ((n + 1) * F.kurtosis(c) + 6) * (n - 1) / F.nullif((n - 2) * (n - 3), F.lit(0.0)))


def describe(df: DataFrame, columns: Sequence[str], by: str | None = None) -> DataFrame:
    """A row per feature (and group): observations, mean, minimum, maximum, skewness, excess kurtosis.

    All features come from one aggregate; its row per group is then unpivoted.
    """
    measures = {"observations": lambda c: F.count(c), "mean": F.avg, "min": F.min, "max": F.max, "skewness": skewness_g1, "kurtosis": kurtosis_g2}
    grouped = df.groupBy(by) if by else df
    wide = grouped.agg(*[f(F.col(c).cast("double")).alias(f"{m}_{i}") for i, c in enumerate(columns) for m, f in measures.items()])
    rows = F.array(*[F.struct(F.lit(c).alias("feature"), *[F.col(f"{m}_{i}").alias(m) for m in measures]) for i, c in enumerate(columns)])
    return wide.select(*([by] if by else []), F.inline(rows))


def covariance_matrix(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Sample covariance in long form ``(i, j, cov)``, all pairs from one aggregate."""
    pairs = [(i, j) for i in range(len(columns)) for j in range(i, len(columns))]
    one = df.agg(*[F.covar_samp(F.col(columns[i]).cast("double"), F.col(columns[j]).cast("double")).alias(f"c{i}_{j}") for i, j in pairs])
    cells = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.col(f"c{min(i, j)}_{max(i, j)}").alias("cov")) for i in range(len(columns)) for j in range(len(columns))])
    return one.select(F.inline(cells))
