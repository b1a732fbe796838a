"""One query per operator over the benchmark tables, with the SQL that a second engine runs for comparison.

Doubles are rounded on both sides; ``+ 0.0`` turns a negative zero into zero.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import discriminant, gram, kmeans, mixture, neighbors, regression, sampling, stats

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(c: Column | str, places: int = 6) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, places) + F.lit(0.0)


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(F.col("l_quantity").alias("quantity"), (F.col("l_extendedprice") / 1000).alias("price"), F.col("l_discount").alias("discount"), F.col("l_tax").alias("tax"), F.col("l_returnflag").alias("flag"))


FOUR = ["quantity", "price", "discount", "tax"]
FEATURES = {"quantity": "l_quantity", "price": "l_extendedprice/1000", "discount": "l_discount", "tax": "l_tax"}


# Descriptive statistics ------------------------------------------------------------------------

_DESCRIBE = "select '{f}' feature, count(*) observations, round(avg({e}),6)+0.0 mean, round(min({e}),6)+0.0 min, round(max({e}),6)+0.0 max, round(skewness({e}),4)+0.0 skewness, round(kurtosis({e}),4)+0.0 kurtosis from lineitem"


@query(" union all ".join(_DESCRIBE.format(f=f, e=e) for f, e in FEATURES.items()))
def describe_lineitem(spark, sf_dir):
    d = stats.describe(lines(spark, sf_dir), FOUR)
    return d.select("feature", "observations", rounded("mean").alias("mean"), rounded("min").alias("min"), rounded("max").alias("max"), rounded("skewness", 4).alias("skewness"), rounded("kurtosis", 4).alias("kurtosis"))


@query("select event_type, 'value' feature, count(value) observations, round(avg(value),6)+0.0 mean, round(min(value),6)+0.0 min, round(max(value),6)+0.0 max, round(skewness(value),4)+0.0 skewness, round(kurtosis(value),4)+0.0 kurtosis from events group by event_type")
def events_describe(spark, sf_dir):
    d = stats.describe(table(spark, sf_dir, "events"), ["value"], by="event_type")
    return d.select("event_type", "feature", "observations", rounded("mean").alias("mean"), rounded("min").alias("min"), rounded("max").alias("max"), rounded("skewness", 4).alias("skewness"), rounded("kurtosis", 4).alias("kurtosis"))


def _pairs_sql(cell: str) -> str:
    e = list(FEATURES.values())
    return " union all ".join(f"select {i} i, {j} j, {cell.format(a=e[i], b=e[j])} from lineitem" for i in range(4) for j in range(4))


@query(_pairs_sql("round(covar_samp({a},{b}),4)+0.0 cov"))
def covariance_lineitem(spark, sf_dir):
    return stats.covariance_matrix(lines(spark, sf_dir), FOUR).select("i", "j", rounded("cov", 4).alias("cov"))


@query(_pairs_sql("round(sum(({a})*({b})),2)+0.0 s"))
def gram_lineitem(spark, sf_dir):
    return gram.gram_cells(lines(spark, sf_dir), FOUR).select("i", "j", rounded("s", 2).alias("s"))


@query("select i - 1 i, j - 1 j, round(covar_pop(v[i], v[j]) * count(*), 4)+0.0 s from (select embedding::double[] v from embeddings), range(1,65) a(i), range(1,65) b(j) group by i, j")
def gram_embeddings(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings").select(*[F.col("embedding")[i].cast("double").alias(f"x{i}") for i in range(64)])
    g = gram.gram(vectors, vectors.columns)[None]
    cells = [(i, j, float(g.centred[i, j])) for i in range(64) for j in range(64)]
    return spark.createDataFrame(cells, "i long, j long, s double").select("i", "j", rounded("s", 4).alias("s"))


# Regression --------------------------------------------------------------------------------------

_SOLVE = """
with s as (select l_quantity a, l_discount b, l_extendedprice/1000 y from lineitem),
r as (select count(*) n, avg(a) ma, avg(b) mb, avg(y) my, covar_pop(a,a) aa, covar_pop(a,b) ab, covar_pop(b,b) bb, covar_pop(a,y) ay,
  covar_pop(b,y) yb, max(a)-min(a) ra, max(b)-min(b) rb from s),
w as (select *, {wa} wa, {wb} wb from r),
m as (select *, n*aa*wa*wa+{lam} p, n*ab*wa*wb q, n*bb*wb*wb+{lam} t, n*ay*wa u, n*yb*wb v from w),
z as (select *, (t*u-q*v)/(p*t-q*q) ta, (p*v-q*u)/(p*t-q*q) tb from m)
"""


def _coefficients(spark, model):
    return spark.createDataFrame([tuple(map(float, model.coefficients))], "theta_a double, theta_b double, intercept double").select(*[rounded(c).alias(c) for c in ("theta_a", "theta_b", "intercept")])


@query(_SOLVE.format(wa="1.0", wb="1.0", lam=0) + "select round(ta,6)+0.0 theta_a, round(tb,6)+0.0 theta_b, round(my-ta*ma-tb*mb,6)+0.0 intercept from z")
def ols_price(spark, sf_dir):
    return _coefficients(spark, regression.ols(lines(spark, sf_dir), ["quantity", "discount"], "price"))


@query("""with s as (select l_quantity a, l_discount b, l_extendedprice/1000 y from lineitem),
m as (select sum(a*a) p, sum(a*b) q, sum(b*b) t, sum(a*y) u, sum(b*y) v from s)
select round((t*u-q*v)/(p*t-q*q),6)+0.0 theta_a, round((p*v-q*u)/(p*t-q*q),6)+0.0 theta_b from m""")
def ols_no_bias(spark, sf_dir):
    model = regression.ols(lines(spark, sf_dir), ["quantity", "discount"], "price", bias=False)
    return spark.createDataFrame([tuple(map(float, model.coefficients))], "theta_a double, theta_b double").select(rounded("theta_a").alias("theta_a"), rounded("theta_b").alias("theta_b"))


@query(_SOLVE.format(wa="1.0", wb="1.0", lam=0) + "select l_returnflag flag, count(*) n, round(avg(my-ta*ma-tb*mb + ta*l_quantity + tb*l_discount),6)+0.0 fitted from lineitem, z group by l_returnflag")
def ols_predict(spark, sf_dir):
    df = lines(spark, sf_dir)
    model = regression.ols(df, ["quantity", "discount"], "price")
    return df.groupBy("flag").agg(F.count(F.lit(1)).alias("n"), rounded(F.avg(model.predict(["quantity", "discount"]))).alias("fitted"))


def _ridge(spark, sf_dir, scaling):
    m = regression.ridge(lines(spark, sf_dir), ["quantity", "discount"], "price", 600.0, scaling)
    return spark.createDataFrame([(*map(float, m.theta), m.bias_term)], "theta_a double, theta_b double, bias_term double").select(*[rounded(c).alias(c) for c in ("theta_a", "theta_b", "bias_term")])


_RIDGE = "select round(ta,6)+0.0 theta_a, round(tb,6)+0.0 theta_b, round(my,6)+0.0 bias_term from z"


@query(_SOLVE.format(wa="1.0", wb="1.0", lam=600) + _RIDGE)
def ridge_none(spark, sf_dir):
    return _ridge(spark, sf_dir, None)


@query(_SOLVE.format(wa="1/sqrt(aa)", wb="1/sqrt(bb)", lam=600) + _RIDGE)
def ridge_zscore(spark, sf_dir):
    return _ridge(spark, sf_dir, "z-score")


@query(_SOLVE.format(wa="1/ra", wb="1/rb", lam=600) + _RIDGE)
def ridge_maxmin(spark, sf_dir):
    return _ridge(spark, sf_dir, "max-min")


PENALTIES = [0.5, 50.0, 5000.0]


@query(f"""
with p as (select p_size::double a, p_partkey/1000.0 b, p_retailprice/1000 y, row_number() over (order by md5('7|'||p_partkey::varchar)) <= 50 held from part),
g as (select held, count(*) n, avg(a) ma, avg(b) mb, avg(y) my, covar_pop(a,a) aa, covar_pop(a,b) ab, covar_pop(b,b) bb, covar_pop(a,y) ay, covar_pop(b,y) yb from p group by held),
l as (select unnest({PENALTIES}) lam),
m as (select lam, ma, mb, my, n*aa+lam p, n*ab q, n*bb+lam t, n*ay u, n*yb v from g, l where not held),
z as (select lam, ma, mb, my, (t*u-q*v)/(p*t-q*q) ta, (p*v-q*u)/(p*t-q*q) tb from m),
e as (select lam, avg((y-my-ta*(a-ma)-tb*(b-mb))*(y-my-ta*(a-ma)-tb*(b-mb))) err from p, z where held group by lam)
select lam::double penalty, round(err,6)+0.0 error, row_number() over (order by err, lam) = 1 chosen from e""")
def ridge_select_lambda(spark, sf_dir):
    part = table(spark, sf_dir, "part").select("p_partkey", F.col("p_size").cast("double").alias("a"), (F.col("p_partkey") / 1000.0).alias("b"), (F.col("p_retailprice") / 1000).alias("y"))
    m = regression.ridge_select(part, ["a", "b"], "y", PENALTIES, key="p_partkey", hold_out=50, seed=7)
    return spark.createDataFrame([(p, e, p == m.penalty) for p, e in m.errors.items()], "penalty double, error double, chosen boolean").select("penalty", rounded("error").alias("error"), "chosen")


# Discriminant analysis -----------------------------------------------------------------------------


@query("""select l_returnflag flag, count(*) n, round(count(*)*1.0/(select count(*) from lineitem),6)+0.0 prior, round(avg(l_quantity),6)+0.0 mean_x, round(avg(l_extendedprice/1000),6)+0.0 mean_y,
round(covar_pop(l_quantity,l_quantity)*count(*),2)+0.0 scatter_xx, round(covar_pop(l_quantity,l_extendedprice/1000)*count(*),2)+0.0 scatter_xy, round(covar_pop(l_extendedprice/1000,l_extendedprice/1000),6)+0.0 cov_yy from lineitem group by l_returnflag""")
def gda_params(spark, sf_dir):
    m = discriminant.fit_gda(lines(spark, sf_dir), "flag", ["quantity", "price"])
    rows = [(t, int(m.counts[i]), float(m.priors[i]), *map(float, m.means[i]), float(m.scatter[i, 0, 0]), float(m.scatter[i, 0, 1]), float(m.covariances[i, 1, 1])) for i, t in enumerate(m.targets)]
    df = spark.createDataFrame(rows, "flag string, n long, prior double, mean_x double, mean_y double, scatter_xx double, scatter_xy double, cov_yy double")
    return df.select("flag", "n", *[rounded(c).alias(c) for c in ("prior", "mean_x", "mean_y")], *[rounded(c, 2).alias(c) for c in ("scatter_xx", "scatter_xy")], rounded("cov_yy").alias("cov_yy"))


_POSTERIOR = """
with p as (select p_partkey id, p_brand k, cast(p_size as double) x, p_retailprice/1000 y from part),
g as (select k, count(*) n, avg(x) mx, avg(y) my, covar_pop(x,x) sxx, covar_pop(x,y) sxy, covar_pop(y,y) syy from p group by k),
t as (select sum(n) nn, sum(n*sxx)/sum(n) pxx, sum(n*sxy)/sum(n) pxy, sum(n*syy)/sum(n) pyy from g),
h as (select k, n*1.0/nn pr, mx, my, {cov} from g cross join t),
d as (select id, h.k, ln(pr)-0.5*ln(cxx*cyy-cxy*cxy)-0.5*(cyy*(x-mx)*(x-mx)-2*cxy*(x-mx)*(y-my)+cxx*(y-my)*(y-my))/(cxx*cyy-cxy*cxy) lp from p cross join h),
e as (select id, k, exp(lp-max(lp) over (partition by id)) e from d)
select id, k target, round(e/sum(e) over (partition by id),6)+0.0 probability from e"""


def _posterior(spark, sf_dir, method):
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), "p_brand", F.col("p_size").cast("double").alias("x"), (F.col("p_retailprice") / 1000).alias("y"))
    model = discriminant.fit_gda(part, "p_brand", ["x", "y"])
    return discriminant.with_posteriors(part, model, ["x", "y"], ["id"], method).select("id", "target", rounded("probability").alias("probability"))


@query(_POSTERIOR.format(cov="sxx cxx, sxy cxy, syy cyy"))
def gda_posterior_qda(spark, sf_dir):
    return _posterior(spark, sf_dir, "QDA")


@query(_POSTERIOR.format(cov="pxx cxx, pxy cxy, pyy cyy"))
def gda_posterior_lda(spark, sf_dir):
    return _posterior(spark, sf_dir, "LDA")


@query("select label, i - 1 i, j - 1 j, round(covar_pop(v[i], v[j]), 9)+0.0 cov from (select label, embedding::double[] v from embeddings), range(1,65) a(i), range(1,65) b(j) group by label, i, j")
def gda_embeddings(spark, sf_dir):
    """Covariances by class of vectors that are too wide for an expression per cell."""
    vectors = table(spark, sf_dir, "embeddings").select("label", *[F.col("embedding")[i].cast("double").alias(f"x{i}") for i in range(64)])
    m = discriminant.fit_gda(vectors, "label", [f"x{i}" for i in range(64)])
    cells = [(t, i, j, float(c[i, j])) for t, c in zip(m.targets, m.covariances, strict=True) for i in range(64) for j in range(64)]
    return spark.createDataFrame(cells, "label int, i long, j long, cov double").select("label", "i", "j", rounded("cov", 9).alias("cov"))


# K-means -----------------------------------------------------------------------------------------------

CENTROIDS = [[10.0, 20.0], [30.0, 50.0], [45.0, 20.0]]
_POINTS = "p as (select row_number() over () rid, l_quantity x, l_extendedprice/1000 y from lineitem)"


def _steps(n: int) -> str:
    out = [_POINTS, "c0 as (select * from (values " + ", ".join(f"({k}, {x}, {y})" for k, (x, y) in enumerate(CENTROIDS)) + ") t(k, mx, my))"]
    for i in range(n):
        out.append(f"a{i} as (select p.x, p.y, arg_min(k, struct_pack(d := (x-mx)*(x-mx)+(y-my)*(y-my), k := k)) k, min((x-mx)*(x-mx)+(y-my)*(y-my)) d from p, c{i} group by rid, x, y)")
        out.append(f"c{i + 1} as (select k, avg(x) mx, avg(y) my, count(*) n from a{i} group by k)")
    return "with " + ", ".join(out)


def _centroids(spark, new, sizes):
    return spark.createDataFrame([(k, float(c[0]), float(c[1]), int(n)) for k, (c, n) in enumerate(zip(new, sizes, strict=True))], "cluster int, mean_x double, mean_y double, n long").select("cluster", rounded("mean_x").alias("mean_x"), rounded("mean_y").alias("mean_y"), "n")


_CENTROIDS_SQL = " select k::int as cluster, round(mx,6)+0.0 mean_x, round(my,6)+0.0 mean_y, n from "


@query(_steps(1) + _CENTROIDS_SQL + "c1")
def kmeans_step(spark, sf_dir):
    new, sizes, _ = kmeans.step(lines(spark, sf_dir), ["quantity", "price"], CENTROIDS)
    return _centroids(spark, new, sizes)


@query(_steps(3) + _CENTROIDS_SQL + "c3")
def kmeans_3_steps(spark, sf_dir):
    points = lines(spark, sf_dir).select("quantity", "price").persist()
    now, sizes = CENTROIDS, None
    for _ in range(3):
        now, sizes, _ = kmeans.step(points, ["quantity", "price"], now)
    points.unpersist()
    return _centroids(spark, now, sizes)


@query(_steps(1) + " select round(sum(d),2)+0.0 loss from a0")
def kmeans_loss(spark, sf_dir):
    return kmeans.loss(lines(spark, sf_dir), ["quantity", "price"], CENTROIDS).select(rounded("loss", 2).alias("loss"))


@query("with p as (select p_partkey id, p_size::double x, p_retailprice/1000 y from part), c as (select * from (values (0, 10.0, 1.0), (1, 25.0, 1.5), (2, 40.0, 1.0)) t(k, mx, my)) select id, arg_min(k, struct_pack(d := (x-mx)*(x-mx)+(y-my)*(y-my), k := k))::int as cluster from p, c group by id, x, y")
def kmeans_assign(spark, sf_dir):
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_size").cast("double").alias("x"), (F.col("p_retailprice") / 1000).alias("y"))
    return kmeans.assign(part, ["x", "y"], [[10.0, 1.0], [25.0, 1.5], [40.0, 1.0]]).select("id", "cluster")


@query(f"""with k as (select * from (values (0, {CENTROIDS[0][0]}, {CENTROIDS[0][1]}), (1, {CENTROIDS[1][0]}, {CENTROIDS[1][1]}), (2, {CENTROIDS[2][0]}, {CENTROIDS[2][1]})) t(k, mx, my)), {_POINTS},
a as (select x, y, arg_min(k, struct_pack(d := (x-mx)*(x-mx)+(y-my)*(y-my), k := k)) k from p, k group by rid, x, y)
select k::int component, round(count(*)*1.0/(select count(*) from p),6)+0.0 mixing, round(avg(x),6)+0.0 mu_x, round(avg(y),6)+0.0 mu_y, round(covar_pop(x,x),5)+0.0 s_xx, round(covar_pop(x,y),5)+0.0 s_xy, round(covar_pop(y,y),5)+0.0 s_yy from a group by k""")
def gmm_init_params(spark, sf_dir):
    return _mixture(spark, mixture.from_clusters(lines(spark, sf_dir), ["quantity", "price"], CENTROIDS))


# Mixtures ---------------------------------------------------------------------------------------------------

START = mixture.Mixture.from_dict({"mixing": [0.4, 0.6], "mu": [[15.0, 20.0], [35.0, 50.0]], "covariance": [[[60.0, 20.0], [20.0, 150.0]], [[80.0, -10.0], [-10.0, 300.0]]]})


def _mixture(spark, m):
    rows = [(k, float(m.mixing[k]), *map(float, m.mu[k]), float(m.covariance[k, 0, 0]), float(m.covariance[k, 0, 1]), float(m.covariance[k, 1, 1])) for k in range(len(m.mixing))]
    df = spark.createDataFrame(rows, "component int, mixing double, mu_x double, mu_y double, s_xx double, s_xy double, s_yy double")
    return df.select("component", *[rounded(c).alias(c) for c in ("mixing", "mu_x", "mu_y")], *[rounded(c, 5).alias(c) for c in ("s_xx", "s_xy", "s_yy")])


def _em(n: int) -> str:
    first = " union all ".join(f"select {k} k, {START.mixing[k]}::double w, {START.mu[k][0]}::double mx, {START.mu[k][1]}::double my, {START.covariance[k][0][0]}::double cxx, {START.covariance[k][0][1]}::double cxy, {START.covariance[k][1][1]}::double cyy" for k in range(2))
    out = ["p as materialized (select row_number() over () rid, l_quantity x, l_extendedprice/1000 y from lineitem)", f"m0 as ({first})"]
    for i in range(n):
        out.append(f"d{i} as (select rid, x, y, k, ln(w)-0.5*ln(cxx*cyy-cxy*cxy)-0.5*(cyy*(x-mx)*(x-mx)-2*cxy*(x-mx)*(y-my)+cxx*(y-my)*(y-my))/(cxx*cyy-cxy*cxy) lp from p, m{i})")
        out.append(f"r{i} as (select x, y, k, exp(lp)/sum(exp(lp)) over (partition by rid) r from d{i})")
        out.append(f"u{i} as (select k, sum(r) n, sum(r*x)/sum(r) mx, sum(r*y)/sum(r) my from r{i} group by k)")
        out.append(f"m{i + 1} as (select r{i}.k, any_value(n)/(select count(*) from p) w, any_value(mx) mx, any_value(my) my, sum(r*(x-mx)*(x-mx))/any_value(n) cxx, sum(r*(x-mx)*(y-my))/any_value(n) cxy, sum(r*(y-my)*(y-my))/any_value(n) cyy from r{i} join u{i} on r{i}.k=u{i}.k group by r{i}.k)")
    return "with " + ", ".join(out) + f" select k::int component, round(w,6)+0.0 mixing, round(mx,6)+0.0 mu_x, round(my,6)+0.0 mu_y, round(cxx,5)+0.0 s_xx, round(cxy,5)+0.0 s_xy, round(cyy,5)+0.0 s_yy from m{n}"


@query(_em(1))
def gmm_em_step(spark, sf_dir):
    return _mixture(spark, mixture.em_step(lines(spark, sf_dir), START, ["quantity", "price"]))


@query(_em(3))
def gmm_em_3_steps(spark, sf_dir):
    return _mixture(spark, mixture.fit(lines(spark, sf_dir), START, ["quantity", "price"], iteration_limit=4, tolerance=-1.0)[0])


#: Five components over the first eight dimensions of the embeddings.
WIDE_K, WIDE_D = 5, 8
WIDE_START = mixture.Mixture.from_dict({"mixing": [1 / WIDE_K] * WIDE_K, "mu": [[0.02 * ((3 * k + i) % 7 - 3) for i in range(WIDE_D)] for k in range(WIDE_K)], "covariance": [[[0.02 * (1 + k % 3) if i == j else 0.0 for j in range(WIDE_D)] for i in range(WIDE_D)] for k in range(WIDE_K)]})


def _em_wide() -> str:
    """The covariances to start from are multiples of the unit matrix, so densities need no inverse."""
    logs = " union all ".join(f"select rid, v, {k} k, ln({WIDE_START.mixing[k]}) - {WIDE_D / 2}*ln({WIDE_START.covariance[k][0][0]}) - 0.5*list_sum(list_transform(list_zip(v, {WIDE_START.mu[k].tolist()}), lambda z: (z[1]-z[2])*(z[1]-z[2])))/{WIDE_START.covariance[k][0][0]} lp from p" for k in range(WIDE_K))
    return f"""with p as materialized (select row_number() over () rid, list_slice(embedding::double[], 1, {WIDE_D}) v from embeddings), d as ({logs}),
    u as (select v, k, exp(lp) / sum(exp(lp)) over (partition by rid) r from d),
    m as (select k, i, sum(r) / (select count(*) from p) w, sum(r * v[i]) / sum(r) mu from u, range(1, {WIDE_D + 1}) a(i) group by k, i)
    select x.k::int component, x.i - 1 i, y.i - 1 j, round(any_value(x.w), 6)+0.0 mixing, round(any_value(x.mu), 6)+0.0 mu, round(sum(u.r * (u.v[x.i] - x.mu) * (u.v[y.i] - y.mu)) / sum(u.r), 7)+0.0 cov
    from u join m x on x.k = u.k join m y on y.k = u.k group by x.k, x.i, y.i"""


@query(_em_wide())
def gmm_em_step_embeddings(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings").select(*[F.col("embedding")[i].cast("double").alias(f"x{i}") for i in range(WIDE_D)])
    m = mixture.em_step(vectors, WIDE_START, vectors.columns)
    cells = [(k, i, j, float(m.mixing[k]), float(m.mu[k, i]), float(m.covariance[k, i, j])) for k in range(WIDE_K) for i in range(WIDE_D) for j in range(WIDE_D)]
    return spark.createDataFrame(cells, "component int, i long, j long, mixing double, mu double, cov double").select("component", "i", "j", rounded("mixing").alias("mixing"), rounded("mu").alias("mu"), rounded("cov", 7).alias("cov"))


PART_MIX = mixture.Mixture.from_dict({"mixing": [0.3, 0.7], "mu": [[15.0, 1.2], [35.0, 1.6]], "covariance": [[[90.0, 0.5], [0.5, 0.2]], [[120.0, -0.4], [-0.4, 0.1]]]})


def _share(k: int) -> str:
    m, c = PART_MIX.mu[k], PART_MIX.covariance[k]
    det = c[0][0] * c[1][1] - c[0][1] ** 2
    return f"ln({PART_MIX.mixing[k]})-0.5*ln({det})-0.5*({c[1][1]}*(x-{m[0]})*(x-{m[0]})-2*({c[0][1]})*(x-{m[0]})*(y-{m[1]})+{c[0][0]}*(y-{m[1]})*(y-{m[1]}))/{det}"


@query(f"with p as (select p_partkey id, p_size::double x, p_retailprice/1000 y from part), d as (select id, {_share(0)} a, {_share(1)} b from p) select id, round(1/(1+exp(b-a)),6)+0.0 r0, round(1/(1+exp(a-b)),6)+0.0 r1 from d")
def gmm_responsibilities(spark, sf_dir):
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_size").cast("double").alias("x"), (F.col("p_retailprice") / 1000).alias("y"))
    r = mixture.responsibilities(PART_MIX, ["x", "y"])
    return part.select("id", rounded(r[0]).alias("r0"), rounded(r[1]).alias("r1"))


# Neighbours and samples ---------------------------------------------------------------------------------------

# Every id divisible by 20 is a query, all rows but its own are training rows.

_NEAR = """with e as (select vec_id, label, embedding::double[] v from embeddings),
d as (select q.vec_id qid, t.vec_id, t.label, round(list_sum(list_transform(range(1,65), lambda i: (t.v[i]-q.v[i])*(t.v[i]-q.v[i]))),9) d2 from e t, e q where q.vec_id % 20 = 0 and t.vec_id <> q.vec_id),
r as (select *, row_number() over (partition by qid order by d2, vec_id) rn from d qualify rn <= 5) """


def _near(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    return neighbors.neighbours(e, e.where("vec_id % 20 = 0"), 5, "vec_id", "vec_id", vector="embedding", dimensions=64, label="label", rounded=9, leave_out_own=True)


@query(_NEAR + "select qid query_id, rn::int as rank, vec_id train_id, d2+0.0 d2, label from r")
def knn_neighbours_embeddings(spark, sf_dir):
    return _near(spark, sf_dir).withColumn("d2", F.col("d2") + F.lit(0.0))


@query(_NEAR + "select qid query_id, label from (select qid, label, row_number() over (partition by qid order by count(*) desc, label) w from r group by qid, label) where w = 1")
def knn_classify_embeddings(spark, sf_dir):
    return neighbors.classify(_near(spark, sf_dir))


@query(_NEAR + "select qid query_id, round(avg(label),6)+0.0 estimate from r group by qid")
def knn_regress_embeddings(spark, sf_dir):
    return neighbors.regress(_near(spark, sf_dir)).select("query_id", rounded("estimate").alias("estimate"))


@query("""with p as (select p_partkey id, p_size::double a, p_retailprice/1000 b from part),
d as (select q.id query_id, t.id train_id, round((t.a-q.a)*(t.a-q.a)+(t.b-q.b)*(t.b-q.b),9) d2 from p t, p q where q.id % 20 = 0 and t.id <> q.id)
select query_id, row_number() over (partition by query_id order by d2, train_id)::int as rank, train_id, d2+0.0 d2 from d qualify rank <= 3""")
def knn_2d_parts(spark, sf_dir):
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_size").cast("double").alias("a"), (F.col("p_retailprice") / 1000).alias("b"))
    near = neighbors.neighbours(part, part.where("id % 20 = 0"), 3, "id", "id", x=["a", "b"], rounded=9, leave_out_own=True)
    return near.withColumn("d2", F.col("d2") + F.lit(0.0))


@query("select o_orderkey, round(o_totalprice,2)+0.0 total from orders order by md5('42|'||o_orderkey::varchar), o_orderkey limit 100")
def sample_n_orders(spark, sf_dir):
    return sampling.sample_n(table(spark, sf_dir, "orders"), 100, seed=42, key="o_orderkey").select("o_orderkey", rounded("o_totalprice", 2).alias("total"))
