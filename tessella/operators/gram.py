"""The aggregation behind most operators: counts, means and centred cross products, grouped and weighted."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.expr import Feature, col, features

#: Above this many features the moments are summed in Arrow blocks instead of one expression each.
EXPRESSION_FEATURES = 12


@dataclass(frozen=True)
class Gram:
    """Moments of the columns ``x`` followed by ``y`` if there is one. ``n`` is the weight of all rows."""

    n: float
    mean: np.ndarray
    centred: np.ndarray  # sum of w * (x - mean)(x - mean)'
    low: np.ndarray | None = None
    high: np.ndarray | None = None

    @property
    def raw(self) -> np.ndarray:
        """Sum of w * x x'."""
        return self.centred + self.n * np.outer(self.mean, self.mean)

    @property
    def covariance(self) -> np.ndarray:
        """Population covariance."""
        return self.centred / self.n


def merge(a: Gram, b: Gram) -> Gram:
    """The moments of both sets of rows; central moments are merged, so large means do not cancel."""
    n = a.n + b.n
    gap = b.mean - a.mean
    return Gram(n, a.mean + gap * (b.n / n), a.centred + b.centred + np.outer(gap, gap) * (a.n * b.n / n), np.minimum(a.low, b.low), np.maximum(a.high, b.high))


def gram(df: DataFrame, x: Sequence[Feature], y: Feature | None = None, by: Feature | None = None) -> dict:
    """One ``Gram`` for each value of ``by`` (the key None without ``by``); no rows give an empty dictionary.

    Rows with a null feature stop the job. A NaN is a number here and makes the moments of its feature NaN.
    The data are read once: each task reduces its rows to one row of moments per group, and these are merged.
    Up to ``EXPRESSION_FEATURES`` features the moments are aggregate expressions, beyond that Arrow blocks; the results are the same.
    """
    columns = features([*x, *([] if y is None else [y])])
    d = len(columns)
    if d > EXPRESSION_FEATURES:
        return _wide(df, columns, by)
    named = df.select(*[c.alias(f"x{i}") for i, c in enumerate(columns)], *([] if by is None else [col(by).alias("by")]))
    aggs = [F.count(F.lit(1)).alias("n")]
    aggs += [f(f"x{i}").alias(f"{name}{i}") for i in range(d) for f, name in ((F.avg, "m"), (F.min, "lo"), (F.max, "hi"))]
    aggs += [F.covar_pop(f"x{i}", f"x{j}").alias(f"c{i}_{j}") for i in range(d) for j in range(i, d)]
    out = {}
    for row in (named.groupBy("by") if by is not None else named).agg(*aggs).collect():
        n = row["n"]
        if not n:
            continue
        centred = np.zeros((d, d))
        for i in range(d):
            for j in range(i, d):
                centred[i, j] = centred[j, i] = row[f"c{i}_{j}"] * n
        out[row["by"] if by is not None else None] = Gram(float(n), *(np.array([row[f"m{i}"] for i in range(d)]), centred, np.array([row[f"lo{i}"] for i in range(d)]), np.array([row[f"hi{i}"] for i in range(d)])))
    return out


#: Rows of moments are merged in steps, so that none takes more than a share of what the tasks send.
FAN = (1024, 32, 1)


def _wide(df: DataFrame, columns: list, by: Feature | None) -> dict:
    """Wide case: blocks of rows are centred and multiplied with BLAS; what moves is d * d numbers per task and group."""
    d = len(columns)
    named = df.select((F.lit(0) if by is None else col(by)).alias("by"), F.array(*columns).alias("x"))
    schema = T.StructType([T.StructField("by", named.schema["by"].dataType), T.StructField("part", T.IntegerType()), T.StructField("n", T.DoubleType()), *[T.StructField(name, T.ArrayType(T.DoubleType())) for name in ("mean", "centred", "low", "high")]])

    def rows(held: dict, part: int, kind: pa.DataType) -> list[pa.Array]:
        lists = [pa.array([np.ravel(getattr(g, name)) for g in held.values()], pa.list_(pa.float64())) for name in ("mean", "centred", "low", "high")]
        return [pa.array(list(held), kind), pa.array([part] * len(held), pa.int32()), pa.array([g.n for g in held.values()], pa.float64()), *lists]

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}
        kind = None
        for batch in batches:
            kind = batch.column(0).type
            values = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
            keys = batch.column(0).dictionary_encode(null_encoding="encode")
            codes = keys.indices.to_numpy(zero_copy_only=False)
            for k, key in enumerate(keys.dictionary.to_pylist()):
                a = values[codes == k]
                mean = a.mean(0)
                new = Gram(float(len(a)), mean, (a - mean).T @ (a - mean), a.min(0), a.max(0))
                held[key] = merge(held[key], new) if key in held else new
        if held:
            yield pa.RecordBatch.from_arrays(rows(held, TaskContext.get().partitionId(), kind), names=schema.names)

    def read(row: dict) -> Gram:
        return Gram(row["n"], np.array(row["mean"]), np.array(row["centred"]).reshape(d, d), np.array(row["low"]), np.array(row["high"]))

    def joined(table: pa.Table) -> pa.Table:
        held: Gram | None = None
        for batch in table.to_batches():
            for row in batch.to_pylist():
                held = read(row) if held is None else merge(held, read(row))
        return pa.Table.from_arrays(rows({table.column(0)[0].as_py(): held}, table.column(1)[0].as_py(), table.schema.field(0).type), names=schema.names)

    parts = named.mapInArrow(blocks, schema)
    for fan in FAN:
        parts = parts.withColumn("part", F.pmod("part", F.lit(fan))).groupBy("by", "part").applyInArrow(joined, schema)
    return {None if by is None else r["by"]: read(r.asDict()) for r in parts.collect()}


def gram_cells(df: DataFrame, x: Sequence[Feature]) -> DataFrame:
    """Raw cross products in long form ``(i, j, s)``; one global aggregate, then an unpivot of its single row. A null feature stops the job."""
    columns = features(x)
    pairs = [(i, j) for i in range(len(columns)) for j in range(len(columns))]
    sums = df.agg(*[F.sum(columns[i] * columns[j]).alias(f"s{i}_{j}") for i, j in pairs if i <= j])
    cells = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.col(f"s{min(i, j)}_{max(i, j)}").alias("s")) for i, j in pairs])
    return sums.select(F.inline(cells))
