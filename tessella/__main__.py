"""Command line: each statistical job over delimited text, with parameters as JSON lines.

``python -m tessella JOB INPUT OUTPUT [options]``; see ``--help`` of each job.
"""

from __future__ import annotations

import argparse
import json
import sys
from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import discriminant, mixture, neighbors, regression, sampling, stats
from .sources import layouts, params


def positive(text: str) -> int:
    value = int(text)
    if value < 1:
        raise argparse.ArgumentTypeError("must be a positive whole number")
    return value


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="tessella", description=__doc__)
    jobs = top.add_subparsers(dest="job", required=True)

    def job(name: str, about: str, dimensions: bool = True) -> argparse.ArgumentParser:
        p = jobs.add_parser(name, help=about)
        p.add_argument("input")
        p.add_argument("output")
        if dimensions:
            p.add_argument("--dimensions", type=positive, required=True)
        return p

    job("stats", "mean, extremes, covariance, skewness and kurtosis of idx, f1..fd; further fields are not read")
    p = job("ols", "least squares on y, f1..fd")
    p.add_argument("--bias", action=argparse.BooleanOptionalAction, default=True)
    p = job("ridge", "ridge regression on idx, f1..fd, y with a penalty chosen on a hold-out sample")
    p.add_argument("--cv-lambdas", required=True, help="file of penalties")
    p.add_argument("--hold-out-sample-size", type=positive, default=1000)
    p.add_argument("--scaling", choices=["none", "z-score", "max-min"], default="none")
    p = job("gda", "class counts, means and scatter of idx, label, f1..fd")
    p.add_argument("--targets", type=json.loads, required=True, help="JSON list of labels")
    p = job("gda-posterior", "class probabilities of idx, label, f1..fd by the parameters that gda has written")
    p.add_argument("--parameters", required=True, help="output folder of gda")
    p.add_argument("--targets", type=json.loads, required=True, help="JSON list of labels, as given to gda")
    p.add_argument("--method", choices=["QDA", "LDA"], default="QDA")
    p = job("knn", "nearest neighbours over idx, f1..fd, y")
    p.add_argument("--knn-type", choices=["regression", "classification"], required=True)
    p.add_argument("--n-neighbours", type=positive, required=True)
    p.add_argument("--points-to-estimate", required=True, help="file of points f1..fd")
    for name, about in (("gmm-init", "initial state of a Gaussian mixture of idx, f1..fd"), ("gmm", "Gaussian mixture of idx, f1..fd: initial state and steps, one output folder per state")):
        p = job(name, about)
        p.add_argument("--clusters", type=positive, required=True)
        p.add_argument("--sample-size", type=positive, required=True)
        p.add_argument("--kmeans-convergence", type=float, default=0.01)
        p.add_argument("--iteration-limit", type=positive, default=100)
        p.add_argument("--kmeans-reruns", type=positive, default=10)
    p.add_argument("--em-iteration-limit", type=positive, default=10)
    p.add_argument("--em-convergence", type=float, default=0.01)
    p = job("gmm-step", "one step of a mixture of idx, f1..fd from given parameters")
    p.add_argument("--parameters", type=json.loads, required=True)
    p = job("sample", "lines of an exact number, without replacement", dimensions=False)
    p.add_argument("--sample-size", type=positive, required=True)
    for p in jobs.choices.values():
        p.add_argument("--seed", type=int, default=0)
    return top


def describe(df: DataFrame, x: Sequence[str]) -> dict:
    rows = {r["feature"]: r for r in stats.describe(df, x).collect()}
    covariance = np.zeros((len(x), len(x)))
    for r in stats.covariance_matrix(df, x).collect():
        covariance[r["i"], r["j"]] = np.nan if r["cov"] is None else r["cov"]
    out = {m: [rows[c][m] for c in x] for m in ("mean", "max", "min", "skewness", "kurtosis")}
    return out | {"covariance": covariance.tolist(), "observations": rows[x[0]]["observations"]}


def main(argv: Sequence[str] | None = None, spark: SparkSession | None = None) -> None:
    a = parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName(f"tessella {a.job}").getOrCreate()
    d = getattr(a, "dimensions", 0)
    x = [f"f{i + 1}" for i in range(d)]

    def read(layout: layouts.Layout, path: str = a.input) -> DataFrame:
        return layouts.read_delimited(spark, path, layout)

    if a.job == "stats":
        params.save_params(spark, describe(read(layouts.statistics_layout(d)), x), a.output)
    elif a.job == "ols":
        params.save_params(spark, regression.ols(read(layouts.regression_layout(d)), x, "y", a.bias).coefficients, a.output)
    elif a.job == "ridge":
        penalties = layouts.read_numbers(spark, a.cv_lambdas)
        scaling = None if a.scaling == "none" else a.scaling
        model = regression.ridge_select(read(layouts.ridge_layout(d)), x, "y", penalties, "idx", a.hold_out_sample_size, scaling, a.seed)
        params.save_params(spark, model.to_dict() | {"penalty": model.penalty}, a.output)
    elif a.job == "gda":
        params.save_params(spark, discriminant.fit_gda(read(layouts.discriminant_layout(d)), "label", x, a.targets).to_dict(), a.output)
    elif a.job == "gda-posterior":
        model = discriminant.GaussianClasses.from_dict(a.targets, params.load_params(spark, a.parameters))
        params.write_lines(discriminant.with_posteriors(read(layouts.discriminant_layout(d)), model, x, ["idx"], a.method), a.output)
    elif a.job == "knn":
        points = read(layouts.points_layout(d), a.points_to_estimate)
        # Ties go to the smaller index: shorter ones first, so whole numbers are in their order.
        rows = read(layouts.neighbours_layout(d)).withColumn("idx", F.concat(F.lpad(F.length("idx").cast("string"), 10, "0"), F.lit(":"), "idx"))
        params.write_lines(neighbors.knn(rows, points, a.n_neighbours, a.knn_type, x, "y", "idx"), a.output)
    elif a.job in ("gmm", "gmm-init"):
        df = read(layouts.mixture_layout(d))
        start = mixture.init(df, x, a.clusters, a.sample_size, a.kmeans_reruns, a.iteration_limit, a.kmeans_convergence, a.seed, "idx")
        if a.job == "gmm-init":
            params.save_params(spark, start.to_dict(), a.output)
            return
        store = lambda step, m: params.save_params(spark, m.to_dict(), params.iteration_path(a.output, step))
        store(0, start)
        mixture.fit(df, start, x, a.em_iteration_limit, a.em_convergence, store)
    elif a.job == "gmm-step":
        model = mixture.Mixture.from_dict(a.parameters)
        params.save_params(spark, mixture.em_step(read(layouts.mixture_layout(d)), model, x).to_dict(), a.output)
    else:
        params.write_lines(sampling.sample_n(layouts.read_lines(spark, a.input), a.sample_size, a.seed), a.output)


if __name__ == "__main__":
    main(sys.argv[1:])
