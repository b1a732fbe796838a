"""Hand-checked fixtures, invariants and guards of the statistical operators."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.errors import DimensionMismatchError, SingularMatrixError, TargetValueError
from tessella.functions.linalg import cholesky_solve
from tessella.operators.gram import merge
from tessella.operators import discriminant, gram, kmeans, mixture, neighbors, regression, sampling, stats
from tessella.sources import layouts, params
from tessella.streaming.moments import RunningGram

rng = np.random.default_rng(5)
OVERLAP = np.vstack([rng.normal([0, 0], 1, (150, 2)), rng.normal([1.5, 1], [1, 2], (150, 2))])


@pytest.fixture(scope="module")
def points(spark):
    return spark.createDataFrame([(i, float(a), float(b), "u" if i < 150 else "v") for i, (a, b) in enumerate(OVERLAP)], "id long, x double, y double, k string")


def test_skewness_and_kurtosis_by_hand(spark):
    df = spark.createDataFrame([(v,) for v in (-1.0, -2.0, -3.0, -10.0, -4.0)], "v double")
    r = stats.describe(df, ["v"]).first()
    a = np.array([-1.0, -2, -3, -10, -4])
    c, n = a - a.mean(), 5
    g1 = (c**3).mean() / (c**2).mean() ** 1.5
    g2 = (c**4).mean() / (c**2).mean() ** 2 - 3
    assert r["max"] == -1 and r["min"] == -10
    assert r["skewness"] == pytest.approx(g1 * np.sqrt(n * (n - 1)) / (n - 2))
    assert r["kurtosis"] == pytest.approx(((n + 1) * g2 + 6) * (n - 1) / ((n - 2) * (n - 3)))
    short = stats.describe(df.limit(2), ["v"]).first()
    assert short["skewness"] is None and short["kurtosis"] is None


def test_gram_does_not_depend_on_partitions_and_wide_equals_narrow(points, monkeypatch):
    a = gram.gram(points.repartition(7), ["x", "y"])[None]
    b = gram.gram(points.coalesce(1), ["x", "y"])[None]
    monkeypatch.setattr(gram, "EXPRESSION_FEATURES", 1)
    c = gram.gram(points, ["x", "y"])[None]
    for g in (b, c):
        assert np.allclose(a.centred, g.centred) and np.allclose(a.mean, g.mean) and a.n == g.n == 300
    assert np.allclose(a.raw, OVERLAP.T @ OVERLAP)


@pytest.mark.parametrize("narrow", [12, 0])
def test_narrow_and_wide_treat_nulls_nans_and_no_rows_alike(spark, monkeypatch, narrow):
    monkeypatch.setattr(gram, "EXPRESSION_FEATURES", narrow)
    df = spark.createDataFrame([(1.0, "a"), (None, "b"), (float("nan"), "c"), (3.0, None)], "x double, k string")
    with pytest.raises(Exception, match="is null"):
        gram.gram(df, ["x"])
    got = gram.gram(df.where("x is not null"), ["x"], by="k")
    assert set(got) == {"a", "c", None} and np.isnan(got["c"].mean[0]) and got[None].mean[0] == 3
    assert gram.gram(df.limit(0), ["x"]) == {} and gram.gram(df.limit(0), ["x"], by="k") == {}


def test_wide_groups_equal_narrow_groups(points, monkeypatch):
    a = gram.gram(points, ["x"], "y", by="k")
    monkeypatch.setattr(gram, "EXPRESSION_FEATURES", 1)
    b = gram.gram(points.repartition(9), ["x"], "y", by="k")
    assert a.keys() == b.keys()
    for k in a:
        assert all(np.allclose(getattr(a[k], f), getattr(b[k], f)) for f in ("n", "mean", "centred", "low", "high"))


def test_null_features_stop_every_operator(spark):
    df = spark.createDataFrame([(1.0, 2.0, "a"), (None, 1.0, "b"), (2.0, 2.0, "b")], "x double, y double, k string")
    m = mixture.Mixture(np.array([1.0]), np.zeros((1, 2)), np.eye(2)[None])
    x = ["x", "y"]
    g = discriminant.GaussianClasses(["a"], np.ones(1), np.zeros((1, 2)), np.eye(2)[None])
    for job in (lambda: kmeans.assign(df, x, [[0.0, 0.0], [1.0, 1.0]]).collect(), lambda: kmeans.step(df, x, [[0.0, 0.0], [1.0, 1.0]]), lambda: kmeans.loss(df, x, [[0.0, 0.0]]).collect(), lambda: mixture.em_step(df, m, x), lambda: mixture.from_clusters(df, x, [[0.0, 0.0], [2.0, 2.0]]), lambda: mixture.log_likelihood(df, m, x), lambda: gram.gram_cells(df, x).collect(), lambda: discriminant.with_posteriors(df, g, x, ["k"]).collect()):
        with pytest.raises(Exception, match="feature x is null"):
            job()
    with pytest.raises(TargetValueError):
        discriminant.fit_gda(spark.createDataFrame([(1.0, "a"), (2.0, None)], "x double, k string"), "k", ["x"])


def test_many_components_and_dimensions(spark, monkeypatch):
    k, d = 10, 20
    data = rng.normal(0, 1, (400, d)) + 3 * rng.integers(0, 2, (400, 1))
    df = spark.createDataFrame([tuple(map(float, r)) for r in data], ", ".join(f"x{i} double" for i in range(d)))
    x = df.columns
    m = mixture.Mixture(np.full(k, 1 / k), rng.normal(0, 1, (k, d)), np.stack([np.eye(d) * (1 + j / 5) for j in range(k)]))
    logs = np.stack([np.log(1 / k) - 0.5 * (d * np.log(2 * np.pi * (1 + j / 5)) + ((data - m.mu[j]) ** 2).sum(1) / (1 + j / 5)) for j in range(k)])
    r = np.exp(logs - logs.max(0))
    likelihood = (np.log(r.sum(0)) + logs.max(0)).sum()
    r /= r.sum(0)
    new = mixture.em_step(df, m, x)
    assert np.allclose(new.mixing, r.mean(1)) and np.allclose(new.mu, r @ data / r.sum(1)[:, None])
    c = data - new.mu[3]
    assert np.allclose(new.covariance[3], (r[3][:, None] * c).T @ c / r[3].sum())
    assert mixture.log_likelihood(df, m, x) == pytest.approx(likelihood)
    shares = np.array([row["responsibilities"] for row in mixture.with_responsibilities(df, m, x).select("responsibilities").collect()])
    assert np.allclose(np.sort(shares, axis=0), np.sort(r.T, axis=0))
    narrow = mixture.Mixture(m.mixing[:2] * 5, m.mu[:2, :2], np.stack([np.eye(2)] * 2))
    few = mixture.em_step(df, narrow, x[:2])
    monkeypatch.setattr(mixture, "EXPRESSION_SUMS", 0)
    blocks = mixture.em_step(df, narrow, x[:2])
    assert np.allclose(few.mu, blocks.mu) and np.allclose(few.covariance, blocks.covariance) and np.allclose(few.mixing, blocks.mixing)


def test_many_centroids_equal_few(points, monkeypatch):
    centroids = rng.normal(0, 1, (7, 2)).tolist() + [[0.5, 0.5]] * 2
    a = [r["cluster"] for r in kmeans.assign(points, ["x", "y"], centroids).orderBy("id").collect()]
    monkeypatch.setattr("tessella.functions.expr.COMPARED", 100)
    assert a == [r["cluster"] for r in kmeans.assign(points, ["x", "y"], centroids).orderBy("id").collect()]


def test_a_frame_that_the_caller_keeps_stays_kept(points):
    mine = points.select("id", "x", "y").persist()
    kmeans.best_of(mine, ["x", "y"], 2, reruns=1, iteration_limit=2, key="id")
    assert mine.storageLevel.useMemory
    mine.unpersist()


def test_ols_with_and_without_constant(spark):
    x = rng.normal(5, 2, (60, 2))
    y = 3 * x[:, 0] - x[:, 1] + 7 + rng.normal(0, 0.1, 60)
    df = spark.createDataFrame([(*map(float, r), float(t)) for r, t in zip(x, y, strict=True)], "a double, b double, t double")
    m = regression.ols(df, ["a", "b"], "t")
    want = np.linalg.lstsq(np.column_stack([x, np.ones(60)]), y, rcond=None)[0]
    assert np.allclose(m.coefficients, want) and m.observations == 60
    assert np.allclose(regression.ols(df, ["a", "b"], "t", bias=False).theta, np.linalg.lstsq(x, y, rcond=None)[0])
    assert np.allclose(regression.ols(df.withColumn("one", F.lit(1.0)), ["one", "a", "b"], "t", bias=False).theta, want[[2, 0, 1]])
    for scaling in regression.SCALINGS:
        r = regression.ridge(df, ["a", "b"], "t", 1e-9, scaling)
        assert np.allclose(r.theta * r.scale, want[:2])
    with pytest.raises(SingularMatrixError):
        regression.ols(df.withColumn("c", F.col("a") * 2), ["a", "c"], "t")
    with pytest.raises(ValueError):
        regression.ridge(df, ["a"], "t", 1.0, "zscore")


def test_ridge_selection_equals_a_direct_fit(spark):
    x = rng.normal(0, 1, (80, 2))
    y = x @ [2.0, -1.0] + rng.normal(0, 1, 80)
    df = spark.createDataFrame([(i, *map(float, r), float(t)) for i, (r, t) in enumerate(zip(x, y, strict=True))], "id long, a double, b double, t double")
    held = {r["id"] for r in sampling.sample_n(df, 20, 3, "id").collect()}
    h = np.array([i in held for i in range(80)])
    errors = {}
    for lam in (0.1, 10.0, 1000.0):
        c, m = x[~h] - x[~h].mean(0), y[~h].mean()
        t = np.linalg.solve(c.T @ c + lam * np.eye(2), c.T @ (y[~h] - m))
        errors[lam] = ((y[h] - m - (x[h] - x[~h].mean(0)) @ t) ** 2).mean()
    got = regression.ridge_select(df, ["a", "b"], "t", [0.1, 10.0, 1000.0], "id", 20, seed=3)
    assert got.errors == pytest.approx(errors) and got.penalty == min(errors, key=errors.get)
    assert np.allclose(got.theta, regression.ridge(df, ["a", "b"], "t", got.penalty).theta)


def test_discriminant_guards_and_equal_covariances(points, spark):
    m = discriminant.fit_gda(points, "k", ["x", "y"], ["u", "v"])
    assert np.allclose(m.covariances[0], np.cov(OVERLAP[:150].T, bias=True)) and np.allclose(m.priors, 0.5)
    rows = discriminant.with_posteriors(points, m, ["x", "y"], ["id"]).groupBy("id").agg(F.sum("probability").alias("s")).collect()
    assert all(r["s"] == pytest.approx(1) for r in rows)
    same = discriminant.GaussianClasses(m.targets, m.counts, m.means, np.stack([m.scatter.sum(0) / 2] * 2))
    both = points.select(same.posterior(["x", "y"], "QDA")[0].alias("q"), same.posterior(["x", "y"], "LDA")[0].alias("l")).collect()
    assert all(r["q"] == pytest.approx(r["l"]) for r in both)
    with pytest.raises(TargetValueError):
        discriminant.fit_gda(points, "k", ["x", "y"], ["u"])
    assert m.to_dict()["total"] == 300


def test_kmeans_loss_falls_and_empty_cluster_stays(points):
    now, losses = [[0.0, 0.0], [5.0, 5.0]], []
    for _ in range(4):
        now, _, lost = kmeans.step(points, ["x", "y"], now)
        losses.append(lost)
    assert losses == sorted(losses, reverse=True)
    new, sizes, _ = kmeans.step(points, ["x", "y"], [[0.0, 0.0], [1e6, 1e6]])
    assert sizes[1] == 0 and list(new[1]) == [1e6, 1e6]
    best = kmeans.best_of(points, ["x", "y"], 2, reruns=3, seed=1, key="id")
    assert best.loss <= kmeans.lloyd(points, ["x", "y"], kmeans.initial_centroids(points, ["x", "y"], 2, 1, "id")).loss
    with pytest.raises(ValueError):
        kmeans.initial_centroids(points.limit(1), ["x", "y"], 2)


def test_em_against_numpy_on_overlapping_clusters(points):
    m = mixture.Mixture(np.array([0.5, 0.5]), np.array([[0.0, 0.0], [1.0, 1.0]]), np.array([np.eye(2), np.eye(2) * 2]))
    dens = np.stack([w * np.exp(-0.5 * np.einsum("ni,ij,nj->n", OVERLAP - u, np.linalg.inv(c), OVERLAP - u)) / (2 * np.pi * np.sqrt(np.linalg.det(c))) for w, u, c in zip(m.mixing, m.mu, m.covariance, strict=True)], 1)
    r = dens / dens.sum(1, keepdims=True)
    new = mixture.em_step(points, m, ["x", "y"])
    assert np.allclose(new.mixing, r.mean(0))
    mu = (r.T @ OVERLAP) / r.sum(0)[:, None]
    assert np.allclose(new.mu, mu)
    for k in range(2):
        c = OVERLAP - mu[k]
        assert np.allclose(new.covariance[k], (r[:, k, None] * c).T @ c / r[:, k].sum())
    likelihood = [mixture.log_likelihood(points, m, ["x", "y"])]
    mixture.fit(points, m, ["x", "y"], iteration_limit=4, tolerance=0.0, on_step=lambda _, s: likelihood.append(mixture.log_likelihood(points, s, ["x", "y"])))
    assert likelihood == sorted(likelihood) and len(likelihood) == 4
    assert np.allclose(mixture.Mixture.from_json(m.to_json()).mu, m.mu)
    with pytest.raises(DimensionMismatchError):
        mixture.em_step(points, m, ["x"])
    start = mixture.init(points, ["x", "y"], 2, 200, reruns=2, key="id")
    assert start.mixing.sum() == pytest.approx(1)


def test_responsibilities_far_away_do_not_underflow(spark):
    m = mixture.Mixture(np.array([0.5, 0.5]), np.array([[0.0], [1.0]]), np.ones((2, 1, 1)))
    r = spark.createDataFrame([(1e4,)], "x double").select(*mixture.responsibilities(m, ["x"])).first()
    assert r[0] == 0 and r[1] == 1


def test_neighbours_ties_votes_and_grid(spark, monkeypatch):
    train = spark.createDataFrame([(1, 1.0, "1"), (2, 3.0, "0"), (3, 3.0, "1"), (4, 9.0, "0")], "id long, f1 double, y string")
    queries = spark.createDataFrame([(2.0,), (2.0,), (9.0,)], "f1 double")
    near = neighbors.neighbours(train, queries.distinct(), 2, "id", "f1", x=["f1"], label="y")
    got = sorted((r["query_id"], r["rank"], r["train_id"]) for r in near.collect())
    assert got == [(2.0, 1, 1), (2.0, 2, 2), (9.0, 1, 4), (9.0, 2, 2)]
    monkeypatch.setattr(neighbors, "BROADCAST_NUMBERS", 0)
    grid = neighbors.neighbours(train, queries.distinct(), 2, "id", "f1", x=["f1"], label="y")
    assert sorted((r["query_id"], r["rank"], r["train_id"]) for r in grid.collect()) == got
    assert {(r["f1"], r["label"]) for r in neighbors.knn(train, queries, 2, "classification", ["f1"], "y", "id").collect()} == {(2.0, "0"), (9.0, "0")}
    assert {(r["f1"], r["estimate"]) for r in neighbors.knn(train, queries, 9, "regression", ["f1"], "y", "id").collect()} == {(2.0, 0.5), (9.0, 0.5)}


def test_vectors_of_another_length_stop(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0])], "id long, v array<double>")
    with pytest.raises(Exception, match="dimensions"):
        neighbors.neighbours(df, df, 1, "id", "id", vector="v", dimensions=2).collect()


def test_sample_sizes_and_repeatability(points):
    assert sampling.sample_n(points, 1000).count() == 300 and sampling.sample_n(points, 0).count() == 0
    a = {r["id"] for r in sampling.sample_n(points.repartition(5), 40, 9, "id").collect()}
    b = {r["id"] for r in sampling.sample_n(points.coalesce(1), 40, 9, "id").collect()}
    assert a == b and len(a) == 40
    bound = sampling.sample_bound(points, 40, 9, "id")
    assert {r["id"] for r in points.where(sampling.priority("id", 9) <= bound).collect()} == a


def test_delimited_input_and_stored_parameters(spark, tmp_path):
    (tmp_path / "d.csv").write_text("1,2.5,3.5,a\n2, 4 ,5,b\n")
    df = layouts.read_delimited(spark, str(tmp_path / "d.csv"), layouts.neighbours_layout(2))
    assert [tuple(r) for r in df.orderBy("idx").collect()] == [("1", 2.5, 3.5, "a"), ("2", 4.0, 5.0, "b")]
    for bad in ("1,x,3.5,a", "1,2.5,,a", "1,2.5,3.5", "1,2.5,3.5,", "1,2.5,3.5,a,b"):
        (tmp_path / "bad.csv").write_text(bad + "\n")
        with pytest.raises(Exception, match="empty or no number|expected 4 fields"):
            layouts.read_delimited(spark, str(tmp_path / "bad.csv"), layouts.neighbours_layout(2)).collect()
    (tmp_path / "t.csv").write_text("first,1,2,and more,,\n\nsecond,3,4\n")
    rows = layouts.read_delimited(spark, str(tmp_path / "t.csv"), layouts.statistics_layout(2)).orderBy("idx").collect()
    assert [tuple(r) for r in rows] == [("first", 1.0, 2.0), ("second", 3.0, 4.0)]
    (tmp_path / "l.csv").write_text("0.5,1\n2\n")
    assert sorted(layouts.read_numbers(spark, str(tmp_path / "l.csv"))) == [0.5, 1.0, 2.0]
    path = params.iteration_path(str(tmp_path / "em"), 1)
    params.save_params(spark, {"mixing": [1.0]}, path)
    assert params.load_params(spark, path) == {"mixing": [1.0]}
    params.write_lines(df, str(tmp_path / "out"))
    assert sorted(r["value"] for r in layouts.read_lines(spark, str(tmp_path / "out")).collect()) == ["1,2.5,3.5,a", "2,4.0,5.0,b"]
    params.write_json(df, str(tmp_path / "j"))
    assert json.loads(spark.read.text(str(tmp_path / "j")).first()["value"])["idx"] in ("1", "2")


def test_stream_equals_batch(spark, points, tmp_path):
    points.repartition(3).write.parquet(str(tmp_path / "in"))
    running = RunningGram(["x", "y"])
    stream = spark.readStream.schema(points.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    running.start(stream, str(tmp_path / "cp")).awaitTermination(120)
    want = gram.gram(points, ["x", "y"])[None]
    assert running.value.n == want.n and np.allclose(running.value.centred, want.centred)
    running.add(points, running.last)
    assert running.value.n == want.n
    # A new driver goes on from the stored value and does not count a repeated batch.
    points.limit(50).write.mode("append").parquet(str(tmp_path / "in"))
    again = RunningGram(["x", "y"])
    again.start(stream, str(tmp_path / "cp")).awaitTermination(120)
    both = merge(want, gram.gram(points.limit(50), ["x", "y"])[None])
    assert again.value.n == 350 and np.allclose(again.value.centred, both.centred) and np.allclose(again.value.mean, both.mean)
    again.add(points, again.last)
    assert again.value.n == 350
    with pytest.raises(ValueError):
        RunningGram(["x"], store=again.store).restore(points.sparkSession)


def test_singular_systems():
    for a in ([[1.0, 1.0], [1.0, 1.0]], [[0.0]], [[float("nan")]]):
        with pytest.raises(SingularMatrixError):
            cholesky_solve(a, np.ones(len(a)))
