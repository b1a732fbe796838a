"""Column expressions shared by the operators; all stay inside generated JVM code."""

from __future__ import annotations

import functools
import math
import operator
from collections.abc import Callable, Sequence

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from .linalg import inverse_logdet

Feature = str | Column


def col(x: Feature) -> Column:
    return F.col(x) if isinstance(x, str) else x


def required(x: Feature, name: object) -> Column:
    """The feature as a double; a null stops the job and names the feature."""
    return F.coalesce(col(x).cast("double"), F.raise_error(F.lit(f"feature {name} is null")).cast("double"))


def features(x: Sequence[Feature]) -> list[Column]:
    return [required(c, c if isinstance(c, str) else i) for i, c in enumerate(x)]


def vector(array: Feature, d: int) -> Column:
    """An array column as doubles; a row that is null, has a null element or another length stops the job."""
    a = col(array)
    found = F.concat(F.lit(f"expected {d} dimensions, found "), F.coalesce(F.size(a).cast("string"), F.lit("none")))
    return F.when(F.size(a) != d, F.raise_error(found)).when(a.isNull() | F.exists(a, lambda v: v.isNull()), F.raise_error(F.lit("a feature is null"))).otherwise(a).cast("array<double>")


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then(value)`` with the value computed once, however often it is used."""
    return F.transform(F.array(value), then)[0]


def total(parts: Sequence[Column]) -> Column:
    return functools.reduce(operator.add, parts)


def squared_distance(x: Sequence[Column], y: Sequence[Column | float]) -> Column:
    pairs = [(a, b if isinstance(b, Column) else F.lit(float(b))) for a, b in zip(x, y, strict=True)]
    return total([(a - b) * (a - b) for a, b in pairs])


def gaussian_log_density(x: Sequence[Column], mean: Sequence[float], cov) -> Column:
    """Log of the multivariate normal density; inverse and determinant are computed once, on the driver."""
    inverse, logdet = inverse_logdet(cov)
    d = [a - F.lit(float(m)) for a, m in zip(x, mean, strict=True)]
    terms = [F.lit(float(inverse[i, j] * (1 if i == j else 2))) * d[i] * d[j] for i in range(len(d)) for j in range(i, len(d))]
    return F.lit(-0.5 * (len(d) * math.log(2 * math.pi) + logdet)) - F.lit(0.5) * total(terms)


def softmax(logs: Sequence[Column]) -> list[Column]:
    """Shares in proportion to ``exp(logs)``, safe where all of them underflow. Every share repeats all logs; for a handful of them."""
    top = F.greatest(*logs) if len(logs) > 1 else logs[0]
    shares = [F.exp(x - top) for x in logs]
    whole = total(shares)
    return [s / whole for s in shares]


def _sum(array: Column) -> Column:
    return F.aggregate(array, F.lit(0.0), lambda a, v: a + v)


def softmax_array(logs: Sequence[Column]) -> Column:
    """The same shares in one array; every log is computed once, so the plan grows with their number."""
    raised = lambda l: let(F.array_max(l), lambda top: F.transform(l, lambda v: F.exp(v - top)))
    return let(F.array(*logs), lambda l: let(raised(l), lambda e: let(_sum(e), lambda whole: F.transform(e, lambda v: v / whole))))


def log_sum_exp(logs: Sequence[Column]) -> Column:
    return let(F.array(*logs), lambda l: let(F.array_max(l), lambda top: top + F.log(_sum(F.transform(l, lambda v: F.exp(v - top))))))


#: Up to this many centroids the nearest is found by plain comparisons, beyond that in an array; both give the same.
COMPARED = 8


def nearest(x: Sequence[Column], centroids: np.ndarray) -> tuple[Column, Column]:
    """Index of the nearest centroid (the first on ties) and its squared distance."""
    distances = [squared_distance(x, c) for c in centroids]
    if len(distances) > COMPARED:
        every = F.array(*distances)
        return let(every, lambda d: (F.array_position(d, F.array_min(d)) - 1).cast("int")), F.array_min(every)
    least = F.least(*distances) if len(distances) > 1 else distances[0]
    index = F.lit(len(distances) - 1)
    for i in range(len(distances) - 2, -1, -1):
        index = F.when(distances[i] <= least, F.lit(i)).otherwise(index)
    return index, least
