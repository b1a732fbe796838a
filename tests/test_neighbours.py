from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pytest

from tessella.operators import neighbors
from tessella.plans import catalog


@pytest.mark.parametrize("broadcast", [True, False])
def test_a_query_is_not_its_own_neighbour(spark, monkeypatch, broadcast):
    rng = np.random.default_rng(3)
    points = rng.integers(0, 6, (60, 2)).astype(float)  # many equal points
    df = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(points)], "id int, a double, b double")
    if not broadcast:
        monkeypatch.setattr(neighbors, "BROADCAST_NUMBERS", 0)
    near = neighbors.neighbours(df, df.where("id % 20 = 0"), 4, "id", "id", x=["a", "b"], leave_out_own=True)
    want = set()
    for q in range(0, 60, 20):
        d2 = ((points - points[q]) ** 2).sum(1)
        want |= {(q, r + 1, i) for r, i in enumerate(sorted((i for i in range(60) if i != q), key=lambda i: (d2[i], i))[:4])}
    assert {(r["query_id"], r["rank"], r["train_id"]) for r in near.collect()} == want


@pytest.mark.parametrize("name, source, key, k", [("knn_neighbours_embeddings", "embeddings", "vec_id", 5), ("knn_classify_embeddings", "embeddings", "vec_id", 1), ("knn_regress_embeddings", "embeddings", "vec_id", 1), ("knn_2d_parts", "part", "p_partkey", 3)])
def test_queries_are_all_ids_divisible_by_20(spark, sf, name, source, key, k):
    ids = sorted(r[key] for r in spark.read.parquet(f"{sf}/{source}.parquet").where(f"{key} % 20 = 0").collect() for _ in range(k))
    assert len(ids) > k
    assert sorted(r["query_id"] for r in catalog.QUERIES[name](spark, sf).collect()) == ids


def test_blocks_of_equal_points_and_text_ids(spark, monkeypatch):
    monkeypatch.setattr(neighbors, "TILE", 7)
    rng = np.random.default_rng(1)
    points = rng.integers(0, 3, (90, 2)).astype(float) * 1e3
    df = spark.createDataFrame([(f"{i:03}", [float(v) for v in p], i) for i, p in enumerate(points)], "id string, v array<double>, y int").repartition(4)
    near = neighbors.neighbours(df, df.where("y < 9"), 6, "id", "id", vector="v", dimensions=2, label="y")
    want = {(f"{q:03}", r + 1, f"{i:03}", i) for q in range(9) for r, i in enumerate(sorted(range(90), key=lambda i: (((points[i] - points[q]) ** 2).sum(), i))[:6])}
    assert {(r["query_id"], r["rank"], r["train_id"], r["label"]) for r in near.collect()} == want
    assert neighbors.neighbours(df.limit(0), df, 2, "id", "id", vector="v", dimensions=2).count() == 0
    assert neighbors.neighbours(df, df.limit(0), 2, "id", "id", vector="v", dimensions=2).count() == 0


@pytest.mark.parametrize("broadcast", [True, False])
def test_a_null_feature_stops_the_job(spark, monkeypatch, broadcast):
    if not broadcast:
        monkeypatch.setattr(neighbors, "BROADCAST_NUMBERS", 0)
    df = spark.createDataFrame([(1, 1.0, [1.0]), (2, None, [None])], "id long, f1 double, v array<double>")
    for how in ({"x": ["f1"]}, {"vector": "v", "dimensions": 1}):
        with pytest.raises(Exception, match="is null"):
            neighbors.neighbours(df, df.where("id = 1"), 2, "id", "id", **how).collect()


def test_few_dimensions_compare_near_boxes_only():
    rng = np.random.default_rng(7)
    x = rng.random((20_000, 2))
    order, starts = neighbors._halved(x[::4], neighbors.BOX_QUERIES)
    own = np.arange(20_000)[::4][order]
    search = neighbors._Boxes(x[own], own, starts, 3, 9)
    found = {}
    for part in np.array_split(np.arange(20_000), 2):  # blocks of one task
        for r, c, d2 in search.block(x[part], part, part, True):
            for i, j, v in zip(r.tolist(), part[c].tolist(), d2.tolist(), strict=True):
                found.setdefault(i, []).append((v, j))
    assert search.compared < 0.1 * len(own) * len(x)  # all pairs were compared before
    for r in range(0, len(own), 137):
        d2 = ((x - x[own[r]]) ** 2).sum(1)
        want = [i for i in np.argsort(d2)[:4] if i != own[r]][:3]
        assert [i for _, i in sorted(found[r])[:3]] == want


@pytest.mark.parametrize("rounded", [None, 2])
@pytest.mark.parametrize("repeated", [False, True])
def test_boxes_equal_brute_force(spark, monkeypatch, rounded, repeated):
    monkeypatch.setattr(neighbors, "_by_blocks", None)
    monkeypatch.setattr(neighbors, "BOX_BLOCK", 40)
    monkeypatch.setattr(neighbors, "BOX_ROWS", 4)
    monkeypatch.setattr(neighbors, "BOX_QUERIES", 3)
    monkeypatch.setattr(neighbors, "BOX_TILE", 50)
    monkeypatch.setattr(neighbors, "BOX_FOUND", 10)
    rng = np.random.default_rng(11)
    points = np.append(rng.integers(0, 5, (200, 3)) * 0.05, rng.normal(0, 1, (100, 3)), axis=0)
    points[50:90] = points[50]  # equal points
    odd = {7: np.inf, 8: np.nan, 9: 1e200, 10: -1e150}
    for i, v in odd.items():
        points[i, 1] = v
    ids = [i // 2 if repeated and i < 60 else i for i in range(300)]
    rows = [(i, *map(float, p)) for i, p in zip(ids, points, strict=True)]
    df = spark.createDataFrame(rows, "id long, a double, b double, c double").repartition(3)
    asked = [i for i in range(300) if ids[i] % 5 == 0 and not (repeated and i < 60)]
    near = neighbors.neighbours(df, spark.createDataFrame([rows[i] for i in asked], df.schema), 6, "id", "id", x=["a", "b", "c"], rounded=rounded, leave_out_own=True)
    want = []
    with np.errstate(all="ignore"):
        for q in asked:
            d2 = [float(sum((points[i][j] - points[q][j]) ** 2 for j in range(3))) for i in range(300)]
            key = [v if rounded is None or not v < 1e20 else float(Decimal(repr(v)).quantize(Decimal(1).scaleb(-rounded), ROUND_HALF_UP)) for v in d2]
            able = [i for i in range(300) if ids[i] != ids[q] and d2[i] < np.inf]
            want += [(ids[q], r + 1, ids[i], key[i]) for r, i in enumerate(sorted(able, key=lambda i: (key[i], ids[i]))[:6])]
    assert sorted(map(tuple, near.collect())) == sorted(want)
