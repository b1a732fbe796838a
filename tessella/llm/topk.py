"""Exact top-k inner products by no-random-access aggregation over sorted lists.

Vectors are turned into integers (``floor(scale * x)``). Every block of candidates keeps one list per
dimension, sorted by value. A query reads its lists from the end that helps it: from the top where its own
component is positive, from the bottom where it is negative. Lists are read in rounds of equal depth
and never looked up out of order. For every candidate the entries read so far give

* a lower bound: what was read, plus the worst value that is left in each unread list;
* an upper bound: what was read, plus the value at which each unread list has arrived.

Once few candidates have an upper bound that reaches the k-th best lower bound, or the k-th best score that the query has
in other blocks, reading goes on for these alone, round by round to the end of their lists, which gives their exact scores.
All queries of a block advance together: a round's entries are the non-zero cells of a matrix of gains, which is made once for
all query blocks, and adding them for all queries is a matrix product. A few queries of each block look at their bounds in every
round; the others read on without a look to the depth at which half of these ended, the end of the lists if need be.

Candidates are packed into blocks where they are read, queries likewise. Tasks are the cells of a grid of parts of the queries and
parts of the candidates. A task holds its query blocks with their k best so far, builds the lists of one candidate block
after the other and passes on k rows per query, which are merged. Work is queries times candidates, as asked; what moves is
blocks, not pairs.

Sums are taken in single precision, double precision or whole numbers of any size, whichever is exact for the block's
largest values; a score beyond 64 bits stops the job.

Rows with a null id or vector, or with null or non-finite components, take no part, nor do vectors of another length than
the query's. Repeated rows of a candidate count once; several vectors under one id count with their best score.
A query never meets its own id. Ties go to the smaller id.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import batches_of, stash, unstash

SCALE = 64
#: Rows of a packed block of candidates, and of queries.
CANDIDATE_BLOCK, QUERY_BLOCK = 8192, 1024
#: Blocks in an Arrow batch, and query blocks that a task holds.
BLOCKS, HELD_BLOCKS = 8, 64
#: Queries that show how deep is to be read, and queries that are read together.
TRIAL, QUERY_TILE = 8, 256
#: Depth of each round of reading, as a share of the lists.
ROUNDS = (1 / 16, 1 / 8, 1 / 4, 1 / 2, 1.0)


def quantise(vectors: pa.Array, scale: int = SCALE) -> list[tuple[np.ndarray, np.ndarray]]:
    """Rows with whole, finite vectors and those vectors as whole numbers, for each length."""
    lengths = pc.fill_null(pc.list_value_length(vectors), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    values = vectors.flatten().to_numpy(zero_copy_only=False).astype(float, copy=False)  # null: nan
    starts = np.cumsum(lengths) - lengths
    out = []
    for d in np.unique(lengths[lengths > 0]).tolist():
        rows = np.flatnonzero(lengths == d)
        x = values[starts[rows][:, None] + np.arange(d)]
        fine = np.isfinite(x).all(1)
        out.append((rows[fine], np.floor(scale * x[fine]) + 0.0))
    return out


def exact_kind(q: np.ndarray, x: np.ndarray) -> type:
    """A type in which all sums of products are exact. Gains are differences of two values, and lower and upper bounds are sums of two such sums."""
    largest = 4 * float(np.abs(q).max()) * float(np.abs(x).max()) * x.shape[1]
    return np.float32 if largest < 1 << 24 else np.float64 if largest < 1 << 53 else object


def whole(x: np.ndarray, kind: type) -> np.ndarray:
    return np.vectorize(int, otypes=[object])(x) if kind is object else x.astype(kind)


class SortedLists:
    """Candidates ``x`` (rows, dimensions) of whole numbers as one sorted list per dimension; candidates are kept in the order of their ids."""

    def __init__(self, ids: np.ndarray, x: np.ndarray):
        x = np.ascontiguousarray(x, np.float64)
        at = np.argsort(ids, kind="stable")
        self.unique = not len(ids) or bool((ids[at[1:]] != ids[at[:-1]]).all())
        if not self.unique:  # equal rows of one id count once; compared bit by bit
            _, first = np.unique(np.column_stack([ids, x.view(np.int64)]), axis=0, return_index=True)
            at = first[np.argsort(ids[first], kind="stable")]
        self.ids, self.x = np.asarray(ids)[at], x[at]
        self.unique = len(np.unique(self.ids)) == len(self.ids)
        n, d = self.x.shape
        small = n and np.abs(self.x).max() < 1 << 15  # short numbers are sorted by radix
        order = np.argsort(self.x.astype(np.int16) if small else self.x, axis=0, kind="stable")
        self.up = np.empty((n, d), np.int32)  # place from the bottom
        np.put_along_axis(self.up, order, np.arange(n, dtype=np.int32)[:, None], axis=0)
        self.sorted = np.take_along_axis(self.x, order, axis=0)
        self.depths = [min(n, math.ceil(n * share)) for share in ROUNDS]
        self.kept: dict[tuple, np.ndarray] = {}

    def lists(self, kind: type) -> np.ndarray:
        return self._once(("lists", kind), lambda: whole(self.sorted, kind))

    def _once(self, key: tuple, make: Callable[[], np.ndarray]) -> np.ndarray:
        if key not in self.kept:
            self.kept[key] = make()
        return self.kept[key]

    def gains(self, kind: type, before: int, depth: int) -> np.ndarray:
        """What the entries at places from ``before`` to ``depth`` of the lists add to the lower bound of their candidates: the
        gain over the worst value of a list read from the top, then of one read from the bottom; 0 where a list was not read."""

        def make() -> np.ndarray:
            x, lists = whole(self.x, kind), self.lists(kind)
            gain = np.hstack([x - lists[0], x - lists[-1]])
            if before or depth < len(self.ids):
                place = np.hstack([len(self.ids) - 1 - self.up, self.up])
                gain[(place < before) | (place >= depth)] = 0
            return gain

        return self._once((kind, before, depth), make)

    def slack(self, kind: type, depth: int) -> np.ndarray:
        """What unread entries may add: lists have arrived at ``depth``, and no entry behind is better."""

        def make() -> np.ndarray:
            lists, n = self.lists(kind), len(self.ids)
            reach = np.hstack([lists[n - depth] - lists[0], lists[depth - 1] - lists[-1]])
            return np.where(np.hstack([n - 1 - self.up, self.up]) >= depth, reach, kind(0) if kind is not object else 0)

        return self._once(("slack", kind, depth), make)

    def found(self, query_ids: np.ndarray, q: np.ndarray, k: int, reach: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Position of the query, candidate id and exact score of the k best of each query, ties to the smaller id. ``reach`` is
        the k-th best score of each query in other blocks: lower ones may be left out."""
        n = len(self.ids)
        if not n or not len(q):
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        kind = exact_kind(q, self.x)
        q = whole(q, kind)
        signed = np.hstack([np.maximum(q, 0), np.minimum(q, 0)])
        asked = _Asked(signed, signed @ np.append(self.lists(kind)[0], self.lists(kind)[-1]), np.searchsorted(self.ids, query_ids), np.searchsorted(self.ids, query_ids, "right"), np.full(len(q), -np.inf) if reach is None else reach, kind, k)
        rows, since, out = np.arange(len(q)), len(self.depths) - 1, []
        if self.unique and k < n - 1:
            # Bounds of a few queries tell how deep is read before any can end; the others look at theirs from there on.
            trial = rows[:: -(-len(q) // TRIAL)]
            since = int(np.median(self._read(asked, trial, 0, out)))
            rows = np.delete(rows, trial)
        for at in range(0, len(rows), QUERY_TILE):
            self._read(asked, rows[at : at + QUERY_TILE], since, out)
        return _best(np.concatenate([np.broadcast_to(r, len(i)) for r, i, _ in out]), np.concatenate([i for _, i, _ in out]), np.concatenate([s.astype(np.int64) for _, _, s in out]), k)

    def _read(self, asked: _Asked, rows: np.ndarray, since: int, out: list) -> np.ndarray:
        """Reads the lists of some queries round by round, the first of which goes down to the depth number ``since``; gives the round in which each query ended."""
        n, kind, k = len(self.ids), asked.kind, asked.k
        lower, before, left = asked.worst[rows][:, None], 0, np.arange(len(rows))
        ended = np.full(len(rows), len(self.depths) - 1)
        for step in range(since, len(self.depths)):
            depth = self.depths[step]
            lower = lower + asked.signed[rows] @ self.gains(kind, before, depth).T
            if depth == n:
                break
            before = depth
            upper = (lower + asked.signed[rows] @ self.slack(kind, depth).T).astype(float)
            sure = lower.astype(float)
            for i, (a, b) in enumerate(zip(asked.first[rows], asked.last[rows], strict=True)):
                sure[i, a:b] = upper[i, a:b] = -np.inf
            kth = np.maximum(np.partition(sure, n - k, axis=1)[:, n - k], asked.reach[rows])
            qualify = (upper >= kth[:, None]) & (upper > -np.inf)
            done = qualify.sum(1) <= 4 * k
            for i in np.flatnonzero(done):
                at = np.flatnonzero(qualify[i])
                score = lower[i, at]
                for a, b in zip(self.depths[step:], self.depths[step + 1 :], strict=False):
                    score = score + self.gains(kind, a, b)[at] @ asked.signed[rows[i]]
                out.append((rows[i], self.ids[at], score))
            ended[left[done]] = step
            lower, rows, left = lower[~done], rows[~done], left[~done]
            if not len(rows):
                return ended
        self._select(asked, rows, lower, out)
        return ended

    def _select(self, asked: _Asked, rows: np.ndarray, score: np.ndarray, out: list) -> None:
        """The candidates that may be among the k best by their whole scores."""
        ids, k = self.ids, asked.k
        order = score.astype(float) if asked.kind is object else score
        for i, (a, b) in enumerate(zip(asked.first[rows], asked.last[rows], strict=True)):
            order[i, a:b] = -np.inf
        if not self.unique:  # an id counts with its best score
            ids, starts = np.unique(ids, return_index=True)
            if asked.kind is object:
                score = np.maximum.reduceat(score, starts, axis=1)
            order = np.maximum.reduceat(order, starts, axis=1)
        if asked.kind is not object:
            score = order
        cut = np.maximum(asked.reach[rows].astype(order.dtype), np.finfo(order.dtype).min)
        many = np.flatnonzero(np.count_nonzero(order >= cut[:, None], axis=1) > 4 * k)
        if len(many) and len(ids) > k:
            cut[many] = np.maximum(cut[many], np.partition(order[many], len(ids) - k, axis=1)[:, len(ids) - k])
            if asked.kind is not object:
                for i in many[np.count_nonzero(order[many] >= cut[many][:, None], axis=1) > 4 * k]:
                    order[i, np.flatnonzero(order[i] == cut[i])[k:]] = -np.inf  # of equal scores the smaller ids
        r, c = np.nonzero(order >= cut[:, None])
        out.append((rows[r], ids[c], score[r, c]))

    def top(self, query_ids: np.ndarray, q: np.ndarray, k: int) -> list[tuple[int, np.ndarray, np.ndarray]]:
        """For each query: its position, candidate ids and exact scores of its k best, ties to the smaller id."""
        if not len(self.ids):
            return []
        rows, ids, scores = self.found(query_ids, q, k)
        at = np.searchsorted(rows, np.arange(len(q) + 1))
        return [(row, ids[a:b], scores[a:b]) for row, (a, b) in enumerate(zip(at[:-1], at[1:], strict=True))]


@dataclass
class _Asked:
    """Queries of a block: positive and negative components side by side, scores of the worst values of all lists, places of the
    query's own id, scores reached elsewhere."""

    signed: np.ndarray
    worst: np.ndarray
    first: np.ndarray
    last: np.ndarray
    reach: np.ndarray
    kind: type
    k: int


def _best(rows: np.ndarray, ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best of each row in order; an id counts once, with its best score."""
    order = np.lexsort((~scores, ids, rows))
    order = order[np.append(True, (np.diff(rows[order]) != 0) | (ids[order][1:] != ids[order][:-1]))[: len(order)]]
    order = order[np.lexsort((~scores[order], rows[order]))]  # stable: equal scores stay in the order of ids
    order = order[np.arange(len(order)) - np.searchsorted(rows[order], rows[order]) < k]
    return rows[order], ids[order], scores[order]


def _bytes(x: np.ndarray) -> tuple[str, bytes]:
    """Whole numbers as bytes, and the smallest type that holds them."""
    largest = np.abs(x).max()
    kind = "<i2" if largest < 1 << 15 else "<i4" if largest < 1 << 31 else "<f8"
    return kind, x.astype(kind).tobytes()


def _pack(rows: int, scale: int):
    """Packs rows (id, vector) into blocks (ids and whole numbers as binary, their type, dimensions); the task keeps one block open per length."""

    def run(batches):
        held: dict[int, tuple[list, list]] = {}

        def block(d):
            ids, x = held.pop(d)
            kind, packed = _bytes(np.concatenate(x))
            return pa.RecordBatch.from_arrays([pa.array([np.concatenate(ids).astype(np.int64).tobytes()], pa.binary()), pa.array([packed], pa.binary()), pa.array([kind]), pa.array([d], pa.int32())], names=["ids", "x", "kind", "d"])

        for batch in batches:
            for kept, vectors in quantise(batch.column(1), scale):
                named = batch.column(0).take(pa.array(kept)).to_numpy(zero_copy_only=False)
                at, d = 0, vectors.shape[1]
                while at < len(named):
                    ids, x = held.setdefault(d, ([], []))
                    most = rows - sum(map(len, ids))
                    ids.append(named[at : at + most])
                    x.append(vectors[at : at + most])
                    at += most
                    if sum(map(len, ids)) == rows:
                        yield block(d)
        for d in list(held):
            yield block(d)

    return run


def _numbers(b: bytes, kind: str, d: int) -> np.ndarray:
    return np.frombuffer(b, kind).reshape(-1, d).astype(np.float64)


def _match(k: int):
    """Takes blocks by task, queries before candidates; a task's query blocks are held with their k best, and candidates pass by."""

    def run(batches):
        number, held = None, []

        def out():
            for block in held:
                rows, ids, scores = block["best"]
                if len(rows):
                    yield pa.RecordBatch.from_arrays([pa.array(block["ids"][rows]), pa.array(ids), pa.array(scores)], names=["query_id", "vec_id", "score"])

        for batch in batches:
            for at in range(batch.num_rows):
                r = {name: batch.column(i)[at].as_py() for i, name in enumerate(batch.schema.names)}
                if r["task"] != number:
                    yield from out()
                    number, held = r["task"], []
                ids, x = np.frombuffer(r["ids"], np.int64), _numbers(r["x"], r["kind"], r["d"])
                if r["side"] == 0:
                    none = np.zeros(0, np.int64)
                    held.append({"ids": ids, "q": x, "best": (none, none, none), "reach": np.full(len(ids), -np.inf)})
                    continue
                mine = [block for block in held if block["q"].shape[1] == r["d"]]
                lists = SortedLists(ids, x) if mine else None
                for block in mine:
                    more = lists.found(block["ids"], block["q"], k, block["reach"])
                    if len(more[0]):
                        block["best"] = _best(*map(np.concatenate, zip(block["best"], more, strict=True)), k)
                        rows, _, scores = block["best"]
                        last = np.flatnonzero(np.bincount(rows, minlength=len(block["ids"])) == k)
                        block["reach"][last] = scores[np.searchsorted(rows, last, "right") - 1]
        yield from out()

    return run


def top_k(queries: DataFrame, candidates: DataFrame, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = SCALE) -> DataFrame:
    """``query_id, rank, vec_id, score``: the k candidates with the largest integer inner product for each query; no rows where either side is empty."""

    def side(df: DataFrame, rows: int) -> DataFrame:
        plain = df.where(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
        # Small partitions are joined, without a shuffle, so that blocks fill up.
        return plain.coalesce(max(1, -(-df.count() // rows))).mapInArrow(_pack(rows, scale), "ids binary, x binary, kind string, d int")

    spark = queries.sparkSession
    # Numbers are given before the blocks are written, so that a lost task's block keeps its number.
    blocks = stash(side(candidates, CANDIDATE_BLOCK).withColumn("block", F.monotonically_increasing_id()), "candidates")
    asked = stash(side(queries, QUERY_BLOCK).withColumn("query_block", F.monotonically_increasing_id()), "queries")
    # Tasks are cells of a grid of parts of the queries and parts of the candidates: a block goes to each cell of its part, so blocks move, not pairs.
    width, n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions"))), asked.count()
    across = max(-(-n // HELD_BLOCKS), min(n, math.isqrt(2 * width)), 1)
    down = max(1, min(blocks.count(), -(-2 * width // across)))

    def dealt(df: DataFrame, number: str, parts: int, side: int, others: int, step: int, other_step: int) -> DataFrame:
        # The partition that wrote a block and its place there: neighbours go to different parts.
        part = F.pmod(F.shiftright(number, 33) + F.col(number).bitwiseAND((1 << 33) - 1), F.lit(parts)).cast("int")
        tasks = F.transform(F.sequence(F.lit(0), F.lit(others - 1)), lambda other: part * step + other * other_step)
        return df.select(F.explode(tasks).alias("task"), F.lit(side).alias("side"), F.col(number).alias("number"), "ids", "x", "kind", "d")

    both = dealt(asked, "query_block", across, 0, down, 1, across).unionAll(dealt(blocks, "block", down, 1, across, across, 1))
    ordered = both.repartitionById(across * down, F.col("task")).sortWithinPartitions("task", "side", "number").drop("number")
    with batches_of(spark, BLOCKS):
        local = stash(ordered.mapInArrow(_match(k), "query_id long, vec_id long, score long"), "found")
    for done in (blocks, asked):
        unstash(done)
    merged = local.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    ranked = merged.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
