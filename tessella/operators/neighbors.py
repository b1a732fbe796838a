"""Exact k nearest neighbours, classification and regression."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.expr import features, squared_distance
from ..functions.expr import vector as as_vector

#: Query points are sent to every task up to this many numbers (rows times features); more go through a grid.
BROADCAST_NUMBERS = 1_000_000
#: Distances of a block that are held at a time.
TILE = 2_000_000
#: Training rows are dealt to so many buckets in the grid; queries are copied to each.
GRID_BUCKETS = 64
#: Up to this many dimensions rows are searched in boxes.
BOX_DIMENSIONS = 8
#: Training rows in a block of boxes and in a box, query points in a group, and numbers of distances and of found rows that are held at a time.
BOX_BLOCK, BOX_ROWS, BOX_QUERIES, BOX_TILE, BOX_FOUND = 262_144, 64, 64, 1_000_000, 65_536


def neighbours(train: DataFrame, queries: DataFrame, k: int, train_id: str, query_id: str, x: Sequence[str] | None = None, vector: str | None = None, dimensions: int = 0, label: str | None = None, rounded: int | None = None, leave_out_own: bool = False) -> DataFrame:
    """``query_id, rank, train_id, d2[, label]``: the k rows with the smallest squared distance, ties to the smaller id.

    Each task keeps its own k best per query before the shuffle, which then moves k rows per task and query.
    Give features as the columns ``x`` of both sides or as an array column ``vector``; a null feature stops the job.
    ``rounded`` rounds distances before they are compared. ``leave_out_own`` is for queries that are
    training rows themselves: a row is then no neighbour of the query with its id. Rows at no finite distance are no neighbours.
    """
    if k < 1:
        raise ValueError("k must be positive")
    d = len(x) if x else dimensions

    def side(df: DataFrame, tag: str, key: str, extra: Sequence[Column]) -> DataFrame:
        return df.select(F.col(key).alias(f"{tag}_id"), (F.array(*features(x)) if x else as_vector(vector, d)).alias(tag), *extra)

    t = side(train, "t", train_id, [F.col(label).alias("t_label")] if label else [])
    q = side(queries, "q", query_id, [])
    size = queries.select(query_id).limit(BROADCAST_NUMBERS // max(1, d) + 1).count() * d
    if size > BROADCAST_NUMBERS:
        scored = _by_grid(t, q, d, leave_out_own)
    else:
        scored = (_by_boxes if 0 < d <= BOX_DIMENSIONS else _by_blocks)(t, q, k, d, rounded, leave_out_own)
    if rounded is not None:
        scored = scored.withColumn("d2", F.round("d2", rounded))
    best = scored.withColumn("rank", F.row_number().over(Window.partitionBy("q_id").orderBy("d2", "t_id"))).where(F.col("rank") <= k)
    return best.select(F.col("q_id").alias("query_id"), "rank", F.col("t_id").alias("train_id"), "d2", *([F.col("t_label").alias("label")] if label else []))


def _by_blocks(t: DataFrame, q: DataFrame, k: int, d: int, rounded: int | None, leave_out_own: bool) -> DataFrame:
    """The k nearest of each block of training rows: a matrix product bounds the distances, those within reach are computed as they are."""
    asked = q.toArrow()  # of checked size
    ids, points = asked.column(0).combine_chunks(), asked.column(1).combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
    schema = T.StructType([T.StructField("q_id", q.schema["q_id"].dataType), *[f for f in t.schema.fields if f.name != "t"], T.StructField("d2", T.DoubleType())])
    rows = max(1, TILE // max(1, len(points)))

    def nearest(batch: pa.RecordBatch, where: dict) -> pa.RecordBatch:
        x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
        squares = np.square(points).sum(1)[:, None] + np.square(x).sum(1)[None, :]
        bound = squares - 2 * (points @ x.T)
        error = 1e-13 * (d + 4) * squares + (0 if rounded is None else 10.0**-rounded)
        if leave_out_own:
            for c, i in enumerate(batch.column(0).to_pylist()):
                for r in where.get(i, ()):
                    bound[r, c] = error[r, c] = np.inf
        most = min(k, x.shape[0]) - 1
        reach = np.partition(bound + error, most, axis=1)[:, most]
        r, c = np.nonzero((bound - error <= reach[:, None]) & np.isfinite(bound))
        d2 = np.square(x[c] - points[r]).sum(1)
        place = np.empty(len(x), np.int64)
        place[pc.sort_indices(batch.column(0)).to_numpy()] = np.arange(len(x))  # ties to the smaller id
        order = np.lexsort((place[c], d2 if rounded is None else np.round(d2, rounded), r))
        first = np.searchsorted(r[order], np.arange(len(points)))
        keep = order[np.arange(len(order)) - first[r[order]] < k]
        taken = pa.array(c[keep])
        return pa.RecordBatch.from_arrays([ids.take(pa.array(r[keep])), batch.column(0).take(taken), *[batch.column(i).take(taken) for i in range(2, batch.num_columns)], pa.array(d2[keep])], names=schema.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where: dict = {}
        for r, i in enumerate(ids.to_pylist() if leave_out_own else ()):
            where.setdefault(i, []).append(r)
        for batch in batches:
            for at in range(0, batch.num_rows if len(points) else 0, rows):
                yield nearest(batch.slice(at, rows), where)

    return t.mapInArrow(run, schema)


def _halved(x: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """An order of the rows and where its boxes of at most ``most`` rows start and end: rows are halved along their widest dimension."""
    order, starts, open_ = np.arange(len(x)), [], [(0, len(x))] if len(x) else []
    while open_:
        lo, hi = open_.pop()
        if hi - lo <= most:
            starts.append(lo)
            continue
        at = order[lo:hi]
        inside = x[at]
        wide, middle = np.argmax(inside.max(0) / 2 - inside.min(0) / 2), (hi - lo) // 2
        order[lo:hi] = at[np.argpartition(inside[:, wide], middle)]
        open_ += [(lo + middle, hi), (lo, lo + middle)]
    return order, np.array([*starts, len(x)], np.int64)


def _square_sum(parts: Iterator[np.ndarray]) -> np.ndarray:
    """Squares added in the order of dimensions; as each step is monotone, a bound of all parts bounds the rounded sum too."""
    total = None
    for p in parts:
        total = p * p if total is None else total + p * p
    return total


class _Boxes:
    """Exact neighbours of few dimensions: boxes of training rows that lie beyond the reach of a whole group of queries are not compared.

    Reach is the k-th smallest distance found so far, so it is taken over from block to block of a task.
    """

    def __init__(self, points: np.ndarray, codes: np.ndarray | None, starts: np.ndarray, k: int, rounded: int | None):
        self.points, self.codes, self.starts, self.k, self.rounded = points, codes, starts, k, rounded
        self.reach = np.full(len(points), np.inf)
        self.compared = 0

    def within(self, d2: np.ndarray) -> np.ndarray:
        """The largest distance that may still be equal to ``d2`` once both are rounded."""
        return d2 if self.rounded is None else d2 * (1 + 1e-14) + 1.001 * 10.0**-self.rounded

    def rounding(self, d2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The least and the largest that rounding may give, in whatever way it treats halves."""
        if self.rounded is None:
            return d2, d2
        scale = 10.0**self.rounded
        units = np.minimum(d2, 1e280 / max(scale, 1.0)) * scale
        slack = 1e-6 + 1e-14 * units
        large = d2 * 1e-280 * max(scale, 1.0) >= 1  # nothing to round
        return np.where(large, d2, np.ceil(units - 0.5 - slack) / scale), np.where(large, d2, np.floor(units + 0.5 + slack) / scale)

    def block(self, x: np.ndarray, place: np.ndarray, codes: np.ndarray | None, distinct: bool) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Query, row and distance of the k nearest rows ``x`` of each query, with those that rounding may put among them. ``place``: order of the ids."""
        use = np.flatnonzero(np.isfinite(x).all(1))
        if distinct:  # of equal points the first k, and one for the query's own, are enough
            use = use[np.lexsort((place[use], *x[use].T))]
            new = np.append(True, (x[use[1:]] != x[use[:-1]]).any(1))[: len(use)]
            at = np.arange(len(use))
            use = use[at - np.maximum.accumulate(np.where(new, at, 0)) <= self.k]
        if not len(use):
            return
        order, starts = _halved(x[use], BOX_ROWS)
        use = use[order]
        x, place = x[use], place[use]
        low, high, sizes = np.minimum.reduceat(x, starts[:-1]), np.maximum.reduceat(x, starts[:-1]), np.diff(starts)
        for lo, hi in zip(self.starts[:-1], self.starts[1:], strict=True):
            q = self.points[lo:hi]
            least, most = q.min(0), q.max(0)
            with np.errstate(over="ignore"):
                gap = _square_sum(np.maximum(np.maximum(low[:, i] - most[i], least[i] - high[:, i]), 0) for i in range(x.shape[1]))
            near = np.argsort(gap, kind="stable")
            # Boxes in the order of their gap; as many at a time as a few rows more than k need, then all within reach.
            done, held = 0, None
            while done < len(near):
                ahead = near[done : done + max(1, BOX_TILE // (BOX_ROWS * len(q)))]
                ahead = ahead[gap[ahead] <= self.reach[lo:hi].max()]
                if not len(ahead):
                    break
                if held is None and np.isinf(self.reach[lo:hi]).any():
                    ahead = ahead[: int(np.searchsorted(np.cumsum(sizes[ahead]), 4 * self.k + 2)) + 1]
                done += len(ahead)
                rows = np.repeat(starts[ahead] - np.append(0, np.cumsum(sizes[ahead])[:-1]), sizes[ahead]) + np.arange(sizes[ahead].sum())
                held = self._nearer(lo, hi, x, rows, use, place, codes, held)
            if held is not None and len(held[0]):
                yield held[0] + lo, use[held[1]], held[2]

    def _nearer(self, lo: int, hi: int, x: np.ndarray, rows: np.ndarray, use: np.ndarray, place: np.ndarray, codes: np.ndarray | None, held: tuple | None) -> tuple:
        q, k = self.points[lo:hi], self.k
        self.compared += len(q) * len(rows)
        with np.errstate(over="ignore"):
            d2 = _square_sum(x[rows, i][None, :] - q[:, i][:, None] for i in range(x.shape[1]))
        if codes is not None:
            d2[codes[use[rows]][None, :] == self.codes[lo:hi][:, None]] = np.inf
        if len(rows) >= k:
            self.reach[lo:hi] = np.minimum(self.reach[lo:hi], self.within(np.partition(d2, k - 1, axis=1)[:, k - 1]))
        r, c = np.nonzero((d2 <= self.reach[lo:hi][:, None]) & (d2 < np.inf))
        d2, c = d2[r, c], rows[c]
        if held is not None:
            r, c, d2 = np.append(held[0], r), np.append(held[1], c), np.append(held[2], d2)
        least, most = self.rounding(d2)
        order = np.lexsort((place[c], most, r))
        r, c, d2, least, most = r[order], c[order], d2[order], least[order], most[order]
        first = np.searchsorted(r, np.arange(len(q) + 1))
        last = np.minimum(first[:-1] + k, first[1:]) - 1  # k-th of each query, or its last
        full = first[1:] - first[:-1] >= k
        self.reach[lo:hi][full] = np.minimum(self.reach[lo:hi][full], self.within(d2[last[full]]))
        at = last[r]
        keep = (least < most[at]) | (least == most[at]) & (place[c] <= place[c[at]]) | ~full[r]
        return r[keep], c[keep], d2[keep]


def _by_boxes(t: DataFrame, q: DataFrame, k: int, d: int, rounded: int | None, leave_out_own: bool) -> DataFrame:
    """The k nearest of each block of training rows, both sides in boxes; training rows are dealt evenly to tasks, as files may be few."""
    asked = q.toArrow()  # of checked size
    ids, points = asked.column(0).combine_chunks(), asked.column(1).combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
    finite = np.flatnonzero(np.isfinite(points).all(1))
    order, starts = _halved(points[finite], BOX_QUERIES)
    ids, points = ids.take(pa.array(finite[order])), points[finite[order]]
    schema = T.StructType([T.StructField("q_id", q.schema["q_id"].dataType), *[f for f in t.schema.fields if f.name != "t"], T.StructField("d2", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where: dict = {}
        mine = np.array([where.setdefault(i, len(where)) for i in ids.to_pylist()], np.int64) if leave_out_own else None
        search = _Boxes(points, mine, starts, k, rounded)

        def nearest(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            block = pa.Table.from_batches(held).combine_chunks()
            x = block.column(1).combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
            place = np.empty(len(x), np.int64)
            place[pc.sort_indices(block.column(0), null_placement="at_start").to_numpy()] = np.arange(len(x))  # ties to the smaller id
            codes = np.array([where.get(i, -1) for i in block.column(0).to_pylist()], np.int64) if leave_out_own else None
            distinct = not leave_out_own or len(pc.unique(block.column(0))) == len(x)
            found, n = [], 0

            def out() -> Iterator[pa.RecordBatch]:
                r, c, d2 = (np.concatenate(a) for a in zip(*found, strict=True))
                rows = block.take(pa.array(c))
                columns = [ids.take(pa.array(r)), *[rows.column(i).combine_chunks() for i in range(rows.num_columns) if i != 1], pa.array(d2)]
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)

            for f in search.block(x, place, codes, distinct):
                found.append(f)
                n += len(f[0])
                if n >= BOX_FOUND:
                    yield from out()
                    found, n = [], 0
            if found:
                yield from out()

        held, n = [], 0
        for batch in batches if len(points) else ():
            held.append(batch)
            n += batch.num_rows
            if n >= BOX_BLOCK:
                yield from nearest(held)
                held, n = [], 0
        if n:
            yield from nearest(held)

    return t.repartition(t.sparkSession.sparkContext.defaultParallelism).mapInArrow(run, schema)


def _by_grid(t: DataFrame, q: DataFrame, d: int, leave_out_own: bool) -> DataFrame:
    """Queries of any number: training rows are dealt to buckets, queries are copied to each; the window keeps k per task before its shuffle."""
    both = t.withColumn("bucket", F.pmod(F.xxhash64("t_id"), F.lit(GRID_BUCKETS)).cast("int")).join(q.withColumn("bucket", F.explode(F.sequence(F.lit(0), F.lit(GRID_BUCKETS - 1)))), "bucket")
    if leave_out_own:
        both = both.where("q_id != t_id")
    d2 = squared_distance([F.col("t")[i] for i in range(d)], [F.col("q")[i] for i in range(d)])
    return both.select("q_id", *[c for c in t.columns if c != "t"], d2.alias("d2")).where("d2 < double('infinity')")


def classify(near: DataFrame) -> DataFrame:
    """Majority label of each query; the smaller label wins ties."""
    votes = near.groupBy("query_id", "label").agg(F.count(F.lit(1)).alias("votes"))
    best = votes.groupBy("query_id").agg(F.min(F.struct(-F.col("votes"), F.col("label"))).alias("best"))
    return best.select("query_id", F.col("best.label").alias("label"))


def regress(near: DataFrame) -> DataFrame:
    """Mean label of the neighbours found, which may be fewer than k."""
    return near.groupBy("query_id").agg(F.avg(F.col("label").cast("double")).alias("estimate"))


def knn(train: DataFrame, queries: DataFrame, k: int, mode: str, x: Sequence[str], label: str, train_id: str) -> DataFrame:
    """Query coordinates with an estimate; equal query points collapse."""
    if mode not in ("classification", "regression"):
        raise ValueError("mode must be 'classification' or 'regression'")
    points = queries.select(*x).distinct().withColumn("point", F.to_json(F.struct(*x)))
    near = neighbours(train, points, k, train_id, "point", x=x, label=label)
    found = classify(near) if mode == "classification" else regress(near)
    return points.join(found, points["point"] == found["query_id"]).select(*x, "label" if mode == "classification" else "estimate")
