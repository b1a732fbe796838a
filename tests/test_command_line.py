"""Small examples with known results, run through the command line."""

import json

import numpy as np
import pytest

from tessella.__main__ import main
from tessella.sources.params import load_params

#: Example rows and the labels and estimates that belong to them.
TRAIN = "0,1,2,1\n1,0,1,1\n2,1,1,1\n3,10,9,0\n4,8,7,0\n5,6,9,0\n"
POINTS = "0.98,1.34\n6.08,7.54\n8.42,9.23\n1.56,2.46\n1.56,2.46\n"


def write(tmp_path, name, text):
    (tmp_path / name).write_text(text)
    return str(tmp_path / name)


def lines(spark, path):
    return sorted(r["value"] for r in spark.read.text(path).collect())


def test_knn(spark, tmp_path):
    train, points = write(tmp_path, "t", TRAIN), write(tmp_path, "p", POINTS)
    for kind, want in (("classification", ["1", "0", "0", "1"]), ("regression", ["1.0", "0.0", "0.0", "1.0"])):
        out = str(tmp_path / kind)
        main(["knn", train, out, "--dimensions", "2", "--knn-type", kind, "--n-neighbours", "3", "--points-to-estimate", points], spark)
        assert lines(spark, out) == sorted(f"{p},{w}" for p, w in zip(POINTS.split()[:4], want, strict=True))


def test_ols_ridge_and_stats(spark, tmp_path):
    rng = np.random.default_rng(0)
    x = rng.normal(0, 1, 50)
    y = 2 + 3 * x
    out = str(tmp_path / "ols")
    main(["ols", write(tmp_path, "r", "".join(f"{b},1.0,{a}\n" for a, b in zip(x, y, strict=True))), out, "--dimensions", "2", "--no-bias"], spark)
    assert load_params(spark, out) == pytest.approx([2, 3])
    rows = write(tmp_path, "i", "".join(f"{i},{a},{b}\n" for i, (a, b) in enumerate(zip(x, y, strict=True))))
    out = str(tmp_path / "ridge")
    main(["ridge", rows, out, "--dimensions", "1", "--cv-lambdas", write(tmp_path, "l", "0.001,10\n100\n"), "--hold-out-sample-size", "10", "--scaling", "z-score"], spark)
    got = load_params(spark, out)
    assert got["penalty"] == 0.001 and got["bias_term"] == pytest.approx(y.mean()) and got["theta"][0] == pytest.approx(3 * x.std(), rel=1e-3)
    out = str(tmp_path / "stats")
    main(["stats", rows, out, "--dimensions", "2"], spark)
    got = load_params(spark, out)
    assert got["observations"] == 50 and got["mean"] == pytest.approx([x.mean(), y.mean()]) and np.allclose(got["covariance"], np.cov(x, y))


def test_gda_and_mixtures(spark, tmp_path):
    rng = np.random.default_rng(0)
    points = np.vstack([rng.normal(10, 1, (40, 2)), rng.normal(1, 1, (40, 2))])
    out = str(tmp_path / "gda")
    main(["gda", write(tmp_path, "g", "".join(f"{i},{'ab'[i // 40]},{p[0]},{p[1]}\n" for i, p in enumerate(points))), out, "--dimensions", "2", "--targets", '["a", "b"]'], spark)
    got = load_params(spark, out)
    assert got["class counts"] == [40, 40] and np.allclose(got["covariates"][0], 40 * np.cov(points[:40].T, bias=True))
    main(["gda-posterior", str(tmp_path / "g"), str(tmp_path / "post"), "--dimensions", "2", "--parameters", out, "--targets", '["a", "b"]'], spark)
    best = {}
    for line in lines(spark, str(tmp_path / "post")):
        i, target, share = line.split(",")
        best[int(i)] = max(best.get(int(i), (0.0, "")), (float(share), target))
    assert [best[i][1] for i in range(80)] == ["a"] * 40 + ["b"] * 40
    rows = write(tmp_path, "m", "".join(f"{i},{p[0]},{p[1]}\n" for i, p in enumerate(points)))
    out = str(tmp_path / "gmm")
    main(["gmm", rows, out, "--dimensions", "2", "--clusters", "2", "--sample-size", "60", "--kmeans-reruns", "2"], spark)
    first, second = load_params(spark, out + "_0"), load_params(spark, out + "_1")
    assert np.allclose(sorted(m[0] for m in second["mu"]), sorted([points[40:, 0].mean(), points[:40, 0].mean()]), atol=1e-3)
    main(["gmm-init", rows, str(tmp_path / "init"), "--dimensions", "2", "--clusters", "2", "--sample-size", "60", "--kmeans-reruns", "2"], spark)
    assert load_params(spark, str(tmp_path / "init")) == first
    main(["gmm-step", rows, str(tmp_path / "step"), "--dimensions", "2", "--parameters", json.dumps(first)], spark)
    assert np.allclose(load_params(spark, str(tmp_path / "step"))["mu"], second["mu"])


def test_sample_and_bad_options(spark, tmp_path):
    main(["sample", write(tmp_path, "s", "".join(f"line {i}\n" for i in range(30))), str(tmp_path / "out"), "--sample-size", "7"], spark)
    got = lines(spark, str(tmp_path / "out"))
    assert len(set(got)) == 7 and all(g.startswith("line ") for g in got)
    with pytest.raises(SystemExit):
        main(["ols", "a", "b", "--dimensions", "0"], spark)
    with pytest.raises(SystemExit):
        main(["knn", "a", "b", "--dimensions", "2"], spark)
