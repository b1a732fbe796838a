import math

import numpy as np
import pytest

from tessella.llm import topk
from tessella.llm.queries import OP4_SQL, op4_topk

from ..compare import connect, rows_of_duckdb, rows_of_spark


def brute(queries, rows, k):
    def usable(v):
        return v is not None and len(v) and all(x is not None and math.isfinite(x) for x in v)

    q8 = lambda v: [math.floor(64 * x) for x in v]
    out = []
    for qid in {q for q, v in queries if q is not None and usable(v)}:
        best = {}
        for q, v in queries:
            if q != qid or not usable(v):
                continue
            for i, w in rows:
                if i is not None and i != qid and usable(w) and len(w) == len(v):
                    best[i] = max(best.get(i, -math.inf), sum(a * b for a, b in zip(q8(v), q8(w), strict=True)))
        out += [(qid, r + 1, i, s) for r, (i, s) in enumerate(sorted(best.items(), key=lambda x: (-x[1], x[0]))[:k])]
    return sorted(out)


@pytest.mark.parametrize(("n", "d", "k"), [(300, 4, 5), (900, 16, 20), (15, 3, 20), (1, 2, 3)])
def test_lists_equal_brute_force(n, d, k):
    rng = np.random.default_rng(n)
    ids, x = rng.permutation(n), np.floor(64 * rng.normal(0, 0.3, (n, d)))
    lists = topk.SortedLists(ids, x)
    got = {int(ids[row]): list(zip(i.tolist(), s.tolist(), strict=True)) for row, i, s in lists.top(ids[:40], x[:40], k)}
    for row in range(min(n, 40)):
        want = sorted(((int(i), int(s)) for i, s in zip(ids, x @ x[row], strict=True) if i != ids[row]), key=lambda p: (-p[1], p[0]))[:k]
        assert got[int(ids[row])] == want


def test_reading_stops_early_where_bounds_allow():
    rng = np.random.default_rng(0)
    x = np.floor(rng.normal(0, 1, (4000, 2)) * 64)
    x[:20] += 4000
    seen = []
    lists = topk.SortedLists(np.arange(4000), x)
    inner = np.partition
    np.partition = lambda a, *b, **c: seen.append(a.shape) or inner(a, *b, **c)
    try:
        lists.top(np.array([-1]), np.array([[64.0, 64.0]]), 10)
    finally:
        np.partition = inner
    assert len(seen) == 1  # one round of reading was enough


def test_operator_on_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(i, [float(i % 7) / 7, -float(i % 3) / 3]) for i in range(60)]
    rows += [(20, [0.5, 0.5]), (20, [0.5, 0.5]), (21, [0.9, 0.9]), (None, [1.0, 1.0]), (70, None), (71, []), (72, [nan, 1.0]), (73, [inf, 1.0]), (74, [None, 1.0]), (80, [1.0, 2.0, 3.0]), (81, [1.0, 0.0, 0.0])]
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<double>, score int").repartition(5)
    queries = df.where("vec_id % 20 = 0")
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in topk.top_k(queries, df, 6).collect())
    assert got == brute([r for r in rows if r[0] is not None and r[0] % 20 == 0], rows, 6)
    assert topk.top_k(queries.limit(0), df, 6).count() == 0 and topk.top_k(queries, df.limit(0), 6).count() == 0


def test_query_equals_sql(spark, sf):
    assert rows_of_spark(op4_topk(spark, sf)) == rows_of_duckdb(connect(sf), OP4_SQL)


@pytest.mark.parametrize("size", [4001, 60_000, 2_000_000, 40_000_000])
def test_large_values_and_ids_are_exact(size):
    rng = np.random.default_rng(size)
    n, d, k = 50, 3, 50
    ids = np.array([(1 << 53) + i for i in range(n)], np.int64)
    x = rng.integers(-size, size, (n, d)).astype(float)
    x[1], x[2] = x[0], size - 1
    lists = topk.SortedLists(ids, x)
    for row, found, scores in lists.top(np.array([-1, (1 << 53) + 1]), np.array([x[2], x[3]]), k):
        q = [int(v) for v in (x[2], x[3])[row]]
        want = sorted(((int(i), sum(a * int(b) for a, b in zip(q, v, strict=True))) for i, v in zip(ids, x, strict=True) if not (row == 1 and i == ids[1])), key=lambda p: (-p[1], p[0]))
        assert list(zip(found.tolist(), scores.tolist(), strict=True)) == want


def test_one_dimension_by_hand():
    lists = topk.SortedLists(np.array([1, 2]), np.array([[4001.0], [3999.0]]))
    ((_, ids, scores),) = lists.top(np.array([9]), np.array([[4001.0]]), 5)
    assert ids.tolist() == [1, 2] and scores.tolist() == [16_008_001, 15_999_999]


def test_early_ends_resolve_exact_scores():
    rng = np.random.default_rng(5)
    x = np.floor(rng.normal(0, 1, (3000, 3)) * 64)
    x[:30] += rng.integers(900, 1200, (30, 3))
    lists, q = topk.SortedLists(np.arange(3000), x), np.array([[64.0, 32.0, 50.0], [-64.0, 10.0, 3.0]])
    for row, found, scores in lists.top(np.array([-1, -2]), q, 10):
        want = sorted(((-int(s), i) for i, s in enumerate(x @ q[row])))[:10]
        assert list(zip((-scores).tolist(), found.tolist(), strict=True)) == want


def test_operator_on_large_vectors_and_ids(spark):
    big = 1 << 53
    rows = [(big, [62.6, 1.0]), (big + 1, [62.6, 1.0]), (big + 2, [-62.6, 1.0]), (20, [1e6, -3e6]), (40, [62.53, -0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in topk.top_k(df.where("vec_id in (20, 40)"), df, 6).collect())
    assert got == brute([r for r in rows if r[0] in (20, 40)], rows, 6)


def test_few_queries_look_at_bounds_where_none_can_end():
    rng = np.random.default_rng(8)
    n, d, k = 3000, 48, 10
    x = np.floor(rng.normal(0, 8, (n, d)))
    x[2000:] = x[1500]  # equal scores
    lists, seen = topk.SortedLists(np.arange(n), x), []
    inner = np.partition
    np.partition = lambda a, *b, **c: seen.append(a.size) or inner(a, *b, **c)
    try:
        rows, ids, scores = lists.found(np.arange(300), x[:300], k)
    finally:
        np.partition = inner
    assert sum(seen) < 2 * 300 * n  # each round was cut for all queries before, about 5 times
    for row in range(0, 300, 7):
        want = sorted((-int(s), i) for i, s in enumerate(x @ x[row]) if i != row)[:k]
        assert list(zip((-scores[rows == row]).tolist(), ids[rows == row].tolist(), strict=True)) == want


@pytest.mark.parametrize("structured", [False, True])
def test_scores_reached_elsewhere_leave_out_lower_ones(structured):
    rng = np.random.default_rng(9)
    x = np.floor(rng.normal(0, 8, (900, 3 if structured else 20)))
    if structured:
        x[:8] += 300
    q, k, held, reach = x[:40], 5, None, np.full(40, -np.inf)
    for part in np.array_split(rng.permutation(900), 3):
        more = topk.SortedLists(part, x[part]).found(np.arange(40), q, k, reach)
        held = more if held is None else topk._best(*map(np.concatenate, zip(held, more, strict=True)), k)
        assert held[0].tolist() == np.repeat(np.arange(40), k).tolist()
        reach = held[2][k - 1 :: k].astype(float)
    for row in range(40):
        want = sorted((-int(s), i) for i, s in enumerate(x @ x[row]) if i != row)[:k]
        assert list(zip((-held[2][held[0] == row]).tolist(), held[1][held[0] == row].tolist(), strict=True)) == want


def test_operator_over_many_blocks(spark, monkeypatch):
    for name, value in (("CANDIDATE_BLOCK", 16), ("QUERY_BLOCK", 4), ("HELD_BLOCKS", 2)):
        monkeypatch.setattr(topk, name, value)
    rng = np.random.default_rng(10)
    rows = [(i, [float(v) for v in rng.normal(0, 0.2, 3 if i % 3 else 5)]) for i in range(400)]
    rows += [(400 + i, rows[40][1]) for i in range(60)]  # copies of a query
    rows += [(i, [float(v) for v in rng.normal(0, 0.2, 3)]) for i in range(0, 90, 3)]  # ids with several vectors
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(7)
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in topk.top_k(df.where("vec_id % 5 = 0"), df, 7).collect())
    assert got == brute([r for r in rows if r[0] % 5 == 0], rows, 7)
