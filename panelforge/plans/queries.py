"""The registered queries of the panel engine: each applies operators to panels made of the tables, and has SQL with the same rows where SQL can say it.

Responses are the monthly revenues of nations, factors those of regions, both in millions. Doubles are rounded on both sides, so that sums in another order agree.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..config import Dependence, Distance, Model
from ..operators import cluster as C
from ..operators import covariance as V
from ..operators import dependence as D
from ..operators import diagnostics as G
from ..operators import ewm as E
from ..operators import lineage as L
from ..operators import metrics as M
from ..operators import selection
from ..operators import signs as S
from ..operators import stability as T
from ..operators import weights as W
from ..operators.estimator import FactorModel, fit, moments
from ..sources import panels as P

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

BASE = """
s AS (SELECT s_suppkey, n_name AS asset, 'R' || n_regionkey AS cluster FROM supplier JOIN nation ON s_nationkey = n_nationkey),
r AS (SELECT (year(l_shipdate) * 12 + month(l_shipdate) - 1)::INTEGER AS t, asset, cluster, sum(l_extendedprice * (1 - l_discount)) / 1e6 AS v FROM lineitem JOIN s ON l_suppkey = s_suppkey GROUP BY 1, 2, 3),
y AS (SELECT t, asset, cluster, v AS y FROM r),
x AS (SELECT t, cluster AS factor, sum(v) AS x FROM r GROUP BY 1, 2),
k AS (SELECT DISTINCT asset, cluster FROM r),
yd AS (SELECT t, asset, cluster, y - avg(y) OVER (PARTITION BY asset) AS y FROM y),
xd AS (SELECT t, factor, x - avg(x) OVER (PARTITION BY factor) AS x FROM x)"""

TESTS = """,
m AS (SELECT {key}, factor, sum(x * y) AS xy, sum(x * x) AS xx, sum(y * y) AS yy, count(*) AS n, count(DISTINCT asset) AS q FROM yd JOIN xd USING (t) GROUP BY 1, 2),
g AS (SELECT *, xy / xx AS slope, xy / xx / sqrt(greatest(0.0, yy - xy * xy / xx) / greatest(n - q, 1) / xx) AS t_stat FROM m),
z AS (SELECT *, CASE WHEN abs(t_stat) < 0.75 THEN 0 ELSE sign(slope) END::INTEGER AS sign FROM g)"""

PARTS = """,
q0 AS (SELECT (t // 12)::INTEGER AS as_of, asset, sum(v) AS v FROM r GROUP BY 1, 2),
p AS (SELECT as_of, asset, 'c' || ((row_number() OVER (PARTITION BY as_of ORDER BY round(v, 6) DESC, asset) - 1) // 6) AS cluster FROM q0)"""

TOGETHER = """,
now AS (SELECT a.as_of, a.asset, b.asset AS peer FROM p a JOIN p b USING (as_of, cluster) WHERE a.asset <> b.asset),
tog AS (SELECT a.as_of AS h, a.asset, b.asset AS peer, (a.cluster = b.cluster)::INTEGER::DOUBLE AS same FROM p a JOIN p b USING (as_of) WHERE a.asset <> b.asset)"""

COASSOC = TOGETHER + """,
co0 AS (SELECT n.as_of, n.asset, avg(same) AS w FROM now n JOIN tog h ON n.asset = h.asset AND n.peer = h.peer AND h.h <= n.as_of AND h.h > n.as_of - 3 GROUP BY 1, 2),
co AS (SELECT p.as_of, p.asset, coalesce(w, 1.0) AS w FROM p LEFT JOIN co0 USING (as_of, asset))"""


def rounded(c: Column | str, n: int = 6) -> Column:
    """0.0 for a rounded -0.0."""
    return F.round(F.col(c) if isinstance(c, str) else c, n) + F.lit(0.0)


def query(sql: str | None = None, name: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[name or f.__name__] = f
        if sql:
            SQL[name or f.__name__] = sql
        return f

    return add


def with_base(rest: str, select: str) -> str:
    return f"WITH {BASE}{rest}\n{select}"


def panels(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return P.nation_panels(spark, sf)


def centred(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    x, y, k = panels(spark, sf)
    return W.demean(x, "factor", "x"), W.demean(y, "asset", "y"), k


def yearly(spark: SparkSession, sf: str) -> DataFrame:
    """Partitions: nations by rank of their revenue in a year, six to a cluster."""
    r = P.revenue(spark, sf).groupBy(F.floor(F.col("t") / 12).cast("int").alias("as_of"), "asset").agg(F.sum("v").alias("v"))
    rank = F.row_number().over(Window.partitionBy("as_of").orderBy(F.desc(F.round("v", 6)), "asset")) - 1
    return r.select(F.lit("p").alias("panel"), "as_of", "asset", F.concat(F.lit("c"), F.floor(rank / 6)).alias("cluster"))


# ---- panels, weights, scores


@query(with_base("", "SELECT t, asset, round(y, 6) + 0.0 AS y FROM y"))
def panel_responses(spark, sf):
    return panels(spark, sf)[1].select("t", "asset", rounded("y").alias("y"))


@query(with_base("", "SELECT t, asset, round(y, 6) + 0.0 AS y FROM yd"))
def demean_panel(spark, sf):
    return centred(spark, sf)[1].select("t", "asset", rounded("y").alias("y"))


@query(with_base("", "SELECT t, asset, round(pow(1 - 2.0::DOUBLE / 25, max(t) OVER () - t), 9) + 0.0 AS w2 FROM y"))
def solver_weights(spark, sf):
    return W.solver_weights(panels(spark, sf)[1], 24).select("t", "asset", rounded("w2", 9).alias("w2"))


@query(with_base("", "SELECT t, asset, round(pow(0.9::DOUBLE, max(t) OVER () - t) / sum(pow(0.9::DOUBLE, mt - t)) OVER (PARTITION BY asset), 9) + 0.0 AS w FROM (SELECT *, max(t) OVER () AS mt FROM y)"))
def normalised_weights(spark, sf):
    y = panels(spark, sf)[1]
    w = W.expanding_power(F.col("t"), F.max("t").over(Window.partitionBy("panel")), 0.9)
    return W.normalised(y.withColumn("w", w), "w", ["panel", "asset"]).select("t", "asset", rounded("w", 9).alias("w"))


@query(with_base("", "SELECT t, asset, round((y - avg(y) OVER (PARTITION BY asset)) / nullif(stddev_pop(y) OVER (PARTITION BY asset), 0), 6) + 0.0 AS z FROM y"))
def zscore_population(spark, sf):
    return W.zscore(panels(spark, sf)[1], ["panel", "asset"], "y").select("t", "asset", rounded("z").alias("z"))


@query(with_base("", "SELECT t, asset, CASE WHEN coalesce(sd, 0) > 0 THEN round((y - m) / sd, 6) + 0.0 ELSE 0.0 END AS z FROM (SELECT *, avg(y) OVER (PARTITION BY t) AS m, stddev_samp(y) OVER (PARTITION BY t) AS sd FROM y)"))
def cross_section_zscore(spark, sf):
    return W.cross_section(panels(spark, sf)[1], ["panel", "t"], "y").select("t", "asset", rounded("z").alias("z"))


@query("SELECT event_type AS asset, (year(ts) * 12 + month(ts) - 1)::INTEGER AS t, round(arg_max(value, ts), 6) + 0.0 AS value FROM events GROUP BY 1, 2")
def month_end_values(spark, sf):
    e = spark.read.parquet(f"{sf}/events.parquet")
    return P.month_end(e, by="event_type").select(F.col("event_type").alias("asset"), "t", rounded("value").alias("value"))


@query(with_base("", "SELECT * FROM (SELECT factor AS asset, t, round(ln(x) - ln(lag(x) OVER (PARTITION BY factor ORDER BY t)) - rf, 6) + 0.0 AS excess FROM x LEFT JOIN (SELECT t + 1 AS t, x / 1e4 AS rf FROM x WHERE factor = 'R0') USING (t)) WHERE t IN (SELECT t FROM (SELECT t, rf, x AS v, lag(x) OVER (PARTITION BY factor ORDER BY t) AS b FROM x LEFT JOIN (SELECT t + 1 AS t, x / 1e4 AS rf FROM x WHERE factor = 'R0') USING (t)) WHERE rf IS NOT NULL AND b IS NOT NULL)"))
def excess_log_returns(spark, sf):
    x = panels(spark, sf)[0]
    prices = x.select(F.col("factor").alias("asset"), "t", F.col("x").alias("value"))
    return P.excess_returns(prices, x.where("factor = 'R0'").select("t", (F.col("x") / 1e4).alias("rf"))).select("asset", "t", rounded("excess").alias("excess"))


# ---- signs


@query(with_base(TESTS.format(key="asset"), "SELECT asset, factor, n, round(slope, 6) + 0.0 AS slope, round(t_stat, 4) + 0.0 AS t_stat, sign FROM z"))
def gate_signs(spark, sf):
    x, y, _ = centred(spark, sf)
    return S.slope_tests(x, y).select("asset", "factor", "n", rounded("slope").alias("slope"), rounded("t_stat", 4).alias("t_stat"), "sign")


@query(with_base(TESTS.format(key="cluster"), "SELECT cluster, factor, n, round(slope, 6) + 0.0 AS slope, round(t_stat, 4) + 0.0 AS t_stat, sign FROM z"))
def pooled_signs(spark, sf):
    x, y, k = centred(spark, sf)
    return S.slope_tests(x, y, k).select("cluster", "factor", "n", rounded("slope").alias("slope"), rounded("t_stat", 4).alias("t_stat"), "sign")


@query(with_base(TESTS.format(key="asset") + ",\ngiven AS (SELECT asset, 'R0' AS factor, -1 AS given FROM k WHERE cluster = 'R1')", "SELECT asset, factor, coalesce(given, sign)::INTEGER AS sign FROM z LEFT JOIN given USING (asset, factor)"))
def sign_overrides(spark, sf):
    x, y, k = centred(spark, sf)
    given = k.where("cluster = 'R1'").select("panel", "asset", F.lit("R0").alias("factor"), F.lit(-1).alias("given"))
    return S.override(S.slope_tests(x, y), given).select("asset", "factor", "sign")


@query(with_base("""
, a AS (SELECT asset, cluster, factor, sign(sum(x * y) / sum(x * x))::INTEGER AS own FROM yd JOIN xd USING (t) GROUP BY 1, 2, 3),
b AS (SELECT cluster, factor, sign(sum(x * y) / sum(x * x))::INTEGER AS pooled FROM yd JOIN xd USING (t) GROUP BY 1, 2)""", "SELECT asset, cluster, factor, own, pooled FROM a JOIN b USING (cluster, factor) WHERE own * pooled < 0"))
def sign_disagreements(spark, sf):
    x, y, k = centred(spark, sf)
    return S.disagreements(x, y, k).select("asset", "cluster", "factor", "own", "pooled")


CELLS = TESTS.format(key="asset") + ",\ncells AS (SELECT asset, factor, sign, CASE WHEN sign = 0 THEN 1.0::DOUBLE ELSE 1 / greatest(abs(slope), 0.05::DOUBLE) END AS w FROM z)"


def _cells(spark, sf):
    x, y, k = centred(spark, sf)
    return S.slope_tests(x, y).withColumn("w", S.cell_weight(F.col("slope"), F.col("sign"), 1.0, 0.05)), k


@query(with_base(CELLS, "SELECT asset, factor, round(w, 6) + 0.0 AS w FROM cells"))
def adaptive_cell_weights(spark, sf):
    return _cells(spark, sf)[0].select("asset", "factor", rounded("w").alias("w"))


@query(with_base(CELLS, "SELECT asset, round(coalesce(sqrt(avg(CASE WHEN sign <> 0 THEN w * w END)), 1.0), 6) + 0.0 AS row_weight FROM cells GROUP BY 1"))
def adaptive_row_weights(spark, sf):
    return S.row_weights(_cells(spark, sf)[0]).select("asset", rounded("row_weight").alias("row_weight"))


@query(with_base(CELLS, "SELECT cluster, factor, round(coalesce(sqrt(avg(CASE WHEN sign <> 0 THEN w * w END)), 1.0), 6) + 0.0 AS block_weight FROM cells JOIN k USING (asset) GROUP BY 1, 2"))
def adaptive_block_weights(spark, sf):
    return S.block_weights(*_cells(spark, sf)).select("cluster", "factor", rounded("block_weight").alias("block_weight"))


# ---- dependence

PAIRS = "SELECT a.asset AS a, b.asset AS b, count(*) AS n, {e} FROM {t} a JOIN {t} b USING (t) WHERE a.asset < b.asset GROUP BY 1, 2"


@query(with_base("", PAIRS.format(t="y", e="round(corr(a.y, b.y), 6) + 0.0 AS rho")))
def pearson_pairs(spark, sf):
    return D.pearson(panels(spark, sf)[1]).select("a", "b", "n", rounded("rho").alias("rho"))


@query(with_base(",\nrk AS (SELECT t, asset, rank() OVER (PARTITION BY asset ORDER BY y) + (count(*) OVER (PARTITION BY asset, y) - 1) / 2.0::DOUBLE AS y FROM y)", PAIRS.format(t="rk", e="round(corr(a.y, b.y), 6) + 0.0 AS rho")))
def spearman_pairs(spark, sf):
    return D.spearman(panels(spark, sf)[1]).select("a", "b", "n", rounded("rho").alias("rho"))


@query(with_base("""
, w0 AS (SELECT t, asset, y, pow(1 - 2.0::DOUBLE / 37, max(t) OVER () - t) AS w FROM yd),
w1 AS (SELECT *, sum(w * y) OVER (PARTITION BY asset) / sum(w) OVER (PARTITION BY asset) AS m FROM w0),
w2 AS (SELECT *, sqrt(sum(w * (y - m) * (y - m)) OVER (PARTITION BY asset) / sum(w) OVER (PARTITION BY asset)) AS sd FROM w1),
sg AS (SELECT t, asset, w, (y >= 0.5::DOUBLE * sd)::INTEGER - (y <= -0.5::DOUBLE * sd)::INTEGER AS s FROM w2)""", "SELECT a.asset AS a, b.asset AS b, count(*) AS n, round(coalesce(sum(a.w * a.s * b.s) / nullif(sum(CASE WHEN a.s <> 0 OR b.s <> 0 THEN a.w ELSE 0 END), 0), 0), 6) + 0.0 AS rho FROM sg a JOIN sg b USING (t) WHERE a.asset < b.asset GROUP BY 1, 2"))
def gerber_pairs(spark, sf):
    return D.gerber(centred(spark, sf)[1], span=36).select("a", "b", "n", rounded("rho").alias("rho"))


EWC = """,
e0 AS (SELECT t, factor, x, pow(1 - 2.0::DOUBLE / 25, max(t) OVER () - t) * (2.0::DOUBLE / 25) AS w FROM xd),
e1 AS (SELECT a.factor AS a, b.factor AS b, count(*) AS n, sum(a.w * a.x * b.x) AS cov FROM e0 a JOIN e0 b USING (t) WHERE a.factor <= b.factor GROUP BY 1, 2)"""


@query(with_base(EWC, "SELECT a, b, n, round(cov, 9) + 0.0 AS cov FROM e1"))
def ewm_covariance_last(spark, sf):
    return D.ewm_correlation(centred(spark, sf)[0], "factor", "x", 24, is_corr=False).select("a", "b", "n", rounded("cov", 9).alias("cov"))


@query(with_base(EWC, "SELECT e1.a, e1.b, e1.n, round(e1.cov / sqrt(u.cov * v.cov), 6) + 0.0 AS rho FROM e1 JOIN e1 u ON u.a = e1.a AND u.b = e1.a JOIN e1 v ON v.a = e1.b AND v.b = e1.b WHERE e1.a < e1.b"))
def ewm_correlation_last(spark, sf):
    return D.ewm_correlation(centred(spark, sf)[0], "factor", "x", 24).select("a", "b", "n", rounded("rho").alias("rho"))


EWM = with_base("", "SELECT a.factor, a.t, round(sum(pow(1 - 2.0::DOUBLE / 13, a.t - b.t) * CASE WHEN b.t = f THEN 1 ELSE 2.0::DOUBLE / 13 END * b.x), 6) + 0.0 AS ewm FROM x a JOIN (SELECT *, min(t) OVER (PARTITION BY factor) AS f FROM x) b ON a.factor = b.factor AND b.t <= a.t {w} GROUP BY 1, 2")


@query(EWM.format(w=""))
def ewm_mean_series(spark, sf):
    return E.ewm_mean(panels(spark, sf)[0], "factor", "x", span=12).select("factor", "t", rounded("ewm").alias("ewm"))


@query(with_base("", "SELECT factor, round(sum(pow(1 - 2.0::DOUBLE / 13, l - t) * CASE WHEN t = f THEN 1 ELSE 2.0::DOUBLE / 13 END * x), 6) + 0.0 AS ewm FROM (SELECT *, min(t) OVER (PARTITION BY factor) AS f, max(t) OVER (PARTITION BY factor) AS l FROM x) GROUP BY 1"))
def ewm_mean_last(spark, sf):
    return E.ewm_last(panels(spark, sf)[0], "factor", "x", 12).select("factor", rounded("ewm").alias("ewm"))


@query(with_base("", "SELECT a.a, a.b, a.t, round(sum(pow(1 - 2.0::DOUBLE / 13, a.t - h.t) * (2.0::DOUBLE / 13) * h.uv), 6) + 0.0 AS cov FROM pr a JOIN pr h ON a.a = h.a AND a.b = h.b AND h.t <= a.t GROUP BY 1, 2, 3").replace("\nSELECT a.a", ",\npr AS (SELECT a.factor AS a, b.factor AS b, t, a.x * b.x AS uv FROM xd a JOIN xd b USING (t) WHERE a.factor <= b.factor)\nSELECT a.a"))
def ewm_covariance_series(spark, sf):
    return E.ewm_covariance_series(centred(spark, sf)[0], "factor", "x", span=12).select("a", "b", "t", rounded("cov").alias("cov"))


@query(with_base("", "SELECT a, b, round(1 - rho, 6) + 0.0 AS linear, round(sqrt(2 * (1 - rho)), 6) + 0.0 AS root, round(acos(rho), 6) + 0.0 AS angle FROM (SELECT a.asset AS a, b.asset AS b, least(1.0, greatest(-1.0, coalesce(corr(a.y, b.y), 0))) AS rho FROM y a JOIN y b USING (t) WHERE a.asset < b.asset GROUP BY 1, 2)"))
def correlation_distances(spark, sf):
    p = D.pearson(panels(spark, sf)[1])
    return p.select("a", "b", *(rounded(D.distance(F.col("rho"), k)).alias(k.value) for k in Distance))


@query(with_base("", "SELECT count(rho) AS pairs, round(sum(rho * rho), 6) + 0.0 AS mass FROM (SELECT CASE WHEN count(*) >= 30 THEN corr(a.y, b.y) END AS rho FROM y a JOIN y b USING (t) WHERE a.asset < b.asset GROUP BY a.asset, b.asset)"))
def off_diagonal_mass(spark, sf):
    return D.off_diagonal_mass(D.pearson(panels(spark, sf)[1], min_periods=30)).select("pairs", rounded("mass").alias("mass"))


@query(with_base(",\nd AS (SELECT DISTINCT t AS as_of FROM y)", "SELECT as_of::INTEGER AS as_of, a.asset AS a, b.asset AS b, round(CASE WHEN isnan(corr(a.y, b.y)) THEN NULL ELSE corr(a.y, b.y) END, 6) + 0.0 AS rho FROM y a JOIN y b USING (t), d WHERE a.asset < b.asset AND t <= as_of GROUP BY 1, 2, 3 HAVING count(*) > 1"))
def rolling_correlations(spark, sf):
    y = panels(spark, sf)[1]
    out = T.correlations_at(y, y.select("panel", F.col("t").alias("as_of")).distinct())
    return out.where("rho is not null").select("as_of", "a", "b", rounded("rho").alias("rho"))


# ---- moments and fits


@query(with_base("""
, w AS (SELECT t, asset, y, pow(1 - 2.0::DOUBLE / 37, max(t) OVER () - t) AS w FROM yd)""", "SELECT asset, count(*) AS n, round(sum(w * a.x * a.x), 6) + 0.0 AS g00, round(sum(w * a.x * b.x), 6) + 0.0 AS g01, round(sum(w * a.x * y), 6) + 0.0 AS c0, round(sum(w * y * y), 6) + 0.0 AS yy, round(sum(w), 6) + 0.0 AS sw FROM w JOIN xd a ON a.t = w.t AND a.factor = 'R0' JOIN xd b ON b.t = w.t AND b.factor = 'R1' GROUP BY 1"))
def weighted_moments(spark, sf):
    x, y, _ = centred(spark, sf)
    m = moments(x, W.solver_weights(y, 36), ["R0", "R1", "R2", "R3", "R4"])
    return m.select("asset", "n", rounded(F.get("g", 0)).alias("g00"), rounded(F.get("g", 1)).alias("g01"), rounded(F.get("c", 0)).alias("c0"), rounded("yy").alias("yy"), rounded("sw").alias("sw"))


def _fitted(model: FactorModel, clusters: bool = False, **more) -> Query:
    def run(spark, sf):
        x, y, k = panels(spark, sf)
        f = fit(model, x, y, k if clusters else None, **more)
        return f.coef.join(f.stats, ["panel", "lam", "asset"]).select("lam", "asset", "factor", rounded("beta", 5).alias("beta"), rounded("alpha_const", 5).alias("alpha_const"), rounded("r2", 5).alias("r2"), "status")

    return run


LAM = 2e-4
for _name, _model, _k in (
    ("fit_lasso", FactorModel(Model.LASSO, LAM), False),
    ("fit_lasso_span_signs", FactorModel(Model.LASSO, LAM, span=36, auto_signs=True, adaptive_gamma=1.0), False),
    ("fit_group", FactorModel(Model.GROUP, LAM, l1_weight=0.2), True),
    ("fit_hcgl_signs", FactorModel(Model.HCGL, LAM, auto_signs=True, adaptive_gamma=1.0), False),
    ("fit_fcgl", FactorModel(Model.FCGL, LAM, auto_signs=True), False),
    ("fit_cooperative", FactorModel(Model.COOPERATIVE, LAM), False),
    ("fit_unilasso", FactorModel(Model.UNILASSO, LAM), False),
):
    QUERIES[_name] = _fitted(_model, _k)
QUERIES["fit_lambda_path"] = _fitted(FactorModel(Model.GROUP), True, lams=[1e-3, 3e-4, 1e-4])

#: Least squares on one factor is what a lasso without penalty gives on a panel of one factor.
ONE = """,
o AS (SELECT asset, sum(x * y) / sum(x * x) AS beta, avg(y) AS my, avg(x) AS mx, sum(y * y) AS yy, sum(x * y) AS xy FROM yd JOIN (SELECT t, x - avg(x) OVER () AS x FROM x WHERE factor = 'R0') USING (t) GROUP BY 1)"""


def _one_factor(spark, sf, lam=0.0):
    x, y, k = panels(spark, sf)
    x = x.where("factor = 'R0'")
    return fit(FactorModel(Model.LASSO, lam, warmup=None), x, y), x, y, k


#: With a penalty the slope is drawn to 0 by lam / 2 over the factor's sum of squares at the response's times, divided by all times of the panel.
@query(with_base(ONE, "SELECT asset, round(sign(beta) * greatest(0, abs(beta) - 0.02 / 2 / (sxx / (SELECT count(DISTINCT t) FROM x))), 6) + 0.0 AS beta FROM o JOIN (SELECT asset, sum(x * x) AS sxx FROM yd JOIN (SELECT t, x - avg(x) OVER () AS x FROM x WHERE factor = 'R0') USING (t) GROUP BY 1) USING (asset)"))
def fit_one_factor_lasso(spark, sf):
    return _one_factor(spark, sf, 0.02)[0].coef.select("asset", rounded("beta").alias("beta"))


@query(with_base(ONE, "SELECT asset, round(beta, 6) + 0.0 AS beta, round(1 - (yy - 2 * beta * xy + beta * beta * xx) / sst, 6) + 0.0 AS r2 FROM (SELECT o.*, (SELECT 1) AS one, e.xx, e.sst, e.my AS mmy FROM o JOIN (SELECT asset, sum(x * x) + 0 AS xx, sum(y * y) - count(*) * avg(y) * avg(y) AS sst, avg(y) AS my FROM yd JOIN (SELECT t, x - avg(x) OVER () AS x FROM x WHERE factor = 'R0') USING (t) GROUP BY 1) e USING (asset))"))
def fit_one_factor(spark, sf):
    f = _one_factor(spark, sf)[0]
    return f.coef.join(f.stats, ["panel", "lam", "asset"]).select("asset", rounded("beta").alias("beta"), rounded("r2").alias("r2"))


@query(with_base(ONE + """,
ac AS (SELECT asset, avg(y) - any_value(beta) * avg(x) AS a FROM y JOIN (SELECT t, x FROM x WHERE factor = 'R0') USING (t) JOIN o USING (asset) GROUP BY 1)""", "SELECT asset, t, round(beta * x + a, 6) + 0.0 AS y_hat FROM o JOIN ac USING (asset), (SELECT t, x FROM x WHERE factor = 'R0')"))
def predict_one_factor(spark, sf):
    f, x, _, _ = _one_factor(spark, sf)
    return f.predict(x).select("asset", "t", rounded("y_hat").alias("y_hat"))


@query()
def score_fit(spark, sf):
    x, y, _ = panels(spark, sf)
    f = fit(FactorModel(Model.LASSO), x, y, lams=[1e-2, 1e-3, 1e-4])
    return f.score(x, y).join(f.summary(), ["panel", "lam"]).select("lam", rounded("score", 5).alias("score"), "nonzero", "cells", rounded("mean_r2", 5).alias("mean_r2"), "assets")


@query()
def cross_validation(spark, sf):
    x, y, _ = panels(spark, sf)
    return selection.cross_validate(FactorModel(Model.LASSO), x, y, [1e-2, 1e-3, 1e-4], 4)[0].select("lam", rounded("mean_score", 5).alias("mean_score"), "folds")


@query()
def diagonality_validation(spark, sf):
    x, y, _ = panels(spark, sf)
    return selection.diagonality(FactorModel(Model.LASSO), x, y, [1e-2, 1e-3, 1e-4], 3)[0].select("lam", rounded("statistic", 4).alias("statistic"), rounded("threshold", 4).alias("threshold"), "passes")


# ---- clusters in time


@query()
def hierarchical_clusters(spark, sf):
    from ..operators.estimator import group_arrays

    y = centred(spark, sf)[1]
    labels, merges, _ = group_arrays(FactorModel(Model.HCGL, dependence=Dependence.SPEARMAN, remove_pc1=True, n_clusters=6), y)
    return labels.select("asset", "cluster")


@query()
def cluster_merges(spark, sf):
    from ..operators.estimator import group_arrays

    return group_arrays(FactorModel(Model.HCGL), centred(spark, sf)[1])[1].select("step", "left", "right", rounded("height").alias("height"), "size")


def _rolling(spark, sf, **more):
    y = panels(spark, sf)[1]
    dates = y.select("panel", F.col("t").alias("as_of")).distinct()
    return T.rolling_clusters(T.correlations_at(y, dates, 36), **more)


@query()
def rolling_clusters(spark, sf):
    return _rolling(spark, sf).select("as_of", "asset", "cluster", rounded("cutoff").alias("cutoff"))


@query()
def rolling_clusters_smoothed(spark, sf):
    return _rolling(spark, sf, smoother="similarity_ewma", decay=0.5).select("as_of", "asset", "cluster", rounded("cutoff").alias("cutoff"))


@query()
def rolling_clusters_bonus_held(spark, sf):
    y = panels(spark, sf)[1]
    dates = y.select("panel", F.col("t").alias("as_of")).distinct()
    return T.rolling_clusters(T.correlations_at(y, dates, 36), smoother="partition_bonus", delta=0.2, anchors=T.anchors(dates, 12)).select("as_of", "asset", "cluster", rounded("cutoff").alias("cutoff"))


@query(with_base(PARTS + COASSOC, "SELECT as_of, asset, round(w, 6) + 0.0 AS w FROM co"))
def co_association(spark, sf):
    return T.co_association(yearly(spark, sf), 3).select("as_of", "asset", rounded("w").alias("w"))


EWCO = PARTS + TOGETHER + """,
per AS (SELECT n.as_of, n.asset, h.h, avg(same) AS s FROM now n JOIN tog h ON n.asset = h.asset AND n.peer = h.peer AND h.h <= n.as_of GROUP BY 1, 2, 3),
ew AS (SELECT as_of, asset, sum({k} * s) / sum({k}) AS w FROM (SELECT *, min(h) OVER (PARTITION BY as_of, asset) AS f FROM per) GROUP BY 1, 2)"""


@query(with_base(EWCO.format(k="pow(0.5::DOUBLE, as_of - h)"), "SELECT p.as_of, p.asset, CASE WHEN dense_rank() OVER (ORDER BY p.as_of) < 2 THEN 1.0 ELSE round(coalesce(w, 1.0), 6) + 0.0 END AS w FROM p LEFT JOIN ew USING (as_of, asset)"))
def ewma_co_association(spark, sf):
    return T.ewma_co_association(yearly(spark, sf), 3, min_history=2).select("as_of", "asset", rounded("w").alias("w"))


@query(with_base(EWCO.format(k="(pow(0.5::DOUBLE, as_of - h) * CASE WHEN h = f THEN 1 ELSE 0.5::DOUBLE END)"), "SELECT p.as_of, p.asset, round(coalesce(w, 1.0), 6) + 0.0 AS w FROM p LEFT JOIN ew USING (as_of, asset)"))
def ewma_co_association_recursive(spark, sf):
    return T.ewma_co_association(yearly(spark, sf), 3, adjust=False).select("as_of", "asset", rounded("w").alias("w"))


@query(with_base(PARTS + COASSOC, "SELECT as_of, cluster, round(avg(w), 6) + 0.0 AS w, count(*) AS size FROM p JOIN co USING (as_of, asset) GROUP BY 1, 2"))
def cluster_weights(spark, sf):
    p = yearly(spark, sf)
    return T.cluster_weights(p, T.co_association(p, 3)).select("as_of", "cluster", rounded("w").alias("w"), "size")


@query(with_base(PARTS + COASSOC, "SELECT as_of, count(*) AS assets, count(cluster) AS clustered, count(w) AS weighted, count(DISTINCT cluster) AS clusters, count(cluster) / count(*)::DOUBLE AS clustered_ratio, count(w) / count(cluster)::DOUBLE AS weighted_ratio FROM p LEFT JOIN co USING (as_of, asset) GROUP BY 1"))
def cluster_coverage(spark, sf):
    p = yearly(spark, sf)
    return T.coverage(p, T.co_association(p, 3)).drop("panel")


@query(with_base(PARTS + COASSOC, "SELECT as_of, count(*) AS clusters, round(CASE WHEN count(*) >= 2 AND NOT isnan(corr(n, w)) THEN corr(n, w) END, 4) + 0.0 AS size_w_correlation FROM (SELECT as_of, cluster, round(avg(w), 9) AS w, count(*) AS n FROM p JOIN co USING (as_of, asset) WHERE as_of > 1996 GROUP BY 1, 2) GROUP BY 1"))
def size_weight_correlation(spark, sf):
    p = yearly(spark, sf)
    return T.size_correlation(p, T.co_association(p, 3).withColumn("w", F.round("w", 9))).where("as_of > 1996").select("as_of", "clusters", rounded("size_w_correlation", 4).alias("size_w_correlation"))


@query(with_base(PARTS + COASSOC, "SELECT as_of, cluster, count(*) AS cluster_size, round(stddev_samp(w), 6) + 0.0 AS w_asset_std FROM p JOIN co USING (as_of, asset) WHERE as_of > 1995 GROUP BY 1, 2"))
def cluster_dispersion(spark, sf):
    p = yearly(spark, sf)
    return T.dispersion(p, T.co_association(p, 3), 2).select("as_of", "cluster", "cluster_size", rounded("w_asset_std").alias("w_asset_std"))


@query(with_base(PARTS + COASSOC + """,
mv AS (SELECT as_of, asset, coalesce((lag(cluster) OVER (PARTITION BY asset ORDER BY as_of) <> cluster), false)::INTEGER::DOUBLE AS moved FROM p),
e AS (SELECT * FROM co JOIN mv USING (as_of, asset) WHERE w < 1),
c AS (SELECT quantile_cont(w, 0.25) AS lo, quantile_cont(w, 0.75) AS hi FROM e)""", "SELECT round(any_value(lo), 6) + 0.0 AS bottom_cut, round(any_value(hi), 6) + 0.0 AS top_cut, round(avg(CASE WHEN moved = 1 THEN w END), 6) + 0.0 AS mean_w_moved, round(avg(CASE WHEN moved = 0 THEN w END), 6) + 0.0 AS mean_w_stable, round(avg(CASE WHEN w <= lo THEN moved END), 6) + 0.0 AS bottom_rate, round(avg(CASE WHEN w >= hi THEN moved END), 6) + 0.0 AS top_rate FROM e, c"))
def boundary_statistics(spark, sf):
    p = yearly(spark, sf)
    b = T.boundary(p, T.co_association(p, 3), p.withColumnRenamed("cluster", "derived"))
    return b.select(*(rounded(c).alias(c) for c in ("bottom_cut", "top_cut", "mean_w_moved", "mean_w_stable", "bottom_rate", "top_rate")))


#: What a user did last, an hour before each event.
@query("SELECT a.user_id, a.ts, round(b.value, 6) + 0.0 AS last_value FROM (SELECT user_id, ts - INTERVAL 1 HOUR AS ts FROM events) a ASOF LEFT JOIN events b ON a.user_id = b.user_id AND a.ts >= b.ts")
def as_of_lookup(spark, sf):
    e = spark.read.parquet(f"{sf}/events.parquet")
    left = e.select("user_id", (F.col("ts") - F.expr("INTERVAL 1 HOUR")).alias("ts"))
    right = e.select("user_id", "ts", F.col("value").alias("last_value"))
    return T.as_of(left, right, ["user_id"], "ts", "last_value").select("user_id", "ts", rounded("last_value").alias("last_value"))


POOLED = PARTS + COASSOC + """,
cw AS (SELECT as_of, cluster, avg(w) AS w FROM p JOIN co USING (as_of, asset) GROUP BY 1, 2),
sg AS (SELECT t, asset, y AS raw, t // 12 AS as_of FROM y WHERE t // 12 > 1995),
a AS (SELECT sg.t, asset, raw, cluster, cw.w AS w, count(DISTINCT cluster) OVER (PARTITION BY sg.t) AS kinds, count(raw) OVER d AS gn, avg(raw) OVER d AS gm, stddev_samp(raw) OVER d AS gs, count(raw) OVER c AS cn, avg(raw) OVER c AS cm, coalesce(stddev_samp(raw) OVER c, 0) AS cs FROM sg JOIN p ON p.as_of = sg.as_of - 1 AND p.asset = sg.asset JOIN cw ON cw.as_of = p.as_of AND cw.cluster = p.cluster WINDOW d AS (PARTITION BY sg.t), c AS (PARTITION BY sg.t, p.cluster))"""


@query(with_base(POOLED.replace("count(DISTINCT cluster) OVER (PARTITION BY sg.t) AS kinds", "1 AS kinds").replace("SELECT sg.t, asset,", "SELECT sg.t, sg.asset,").replace("raw, cluster,", "raw, p.cluster,"), "SELECT t AS ts, asset, CASE WHEN cn <= 3 THEN round(CASE WHEN gn < 2 OR gs <= 0 THEN 0 ELSE (raw - gm) / gs END, 6) + 0.0 WHEN cn < 2 OR sqrt(w * cs * cs + (1 - w) * gs * gs) <= 0 THEN 0.0 ELSE round((raw - cm) / sqrt(w * cs * cs + (1 - w) * gs * gs), 6) + 0.0 END AS score FROM a"))
def pooled_scores(spark, sf):
    p = yearly(spark, sf)
    w = T.co_association(p, 3)
    shift = lambda df: df.withColumn("as_of", ((F.col("as_of") + 1) * 12).cast("int"))  # noqa: E731  known from the year after on
    signal = panels(spark, sf)[1].where("t >= 23952").select("panel", F.col("t").alias("ts"), "asset", F.col("y").alias("raw"))
    both = signal.join(p.select("panel", ((F.col("as_of") + 1) * 12).alias("m"), "asset"), ["panel", "asset"]).where(F.floor(F.col("ts") / 12) * 12 == F.col("m")).select("panel", "ts", "asset", "raw")
    return T.pooled_score(both, shift(p), shift(w)).select("ts", "asset", rounded("score").alias("score"))


# ---- covariances

COV = TESTS.format(key="asset") + """,
sg AS (SELECT a.factor AS f, b.factor AS g, covar_samp(a.x, b.x) AS cov FROM x a JOIN x b USING (t) GROUP BY 1, 2),
sp AS (SELECT asset, var_samp(y) / 4 AS var FROM y GROUP BY 1),
ld AS (SELECT asset, f, sum(slope * cov) AS load FROM z JOIN sg ON g = factor GROUP BY 1, 2)"""


def _cov(spark, sf):
    x, y, _ = centred(spark, sf)
    key = [F.lit("p").alias("panel"), F.lit(0).alias("as_of")]
    b = S.slope_tests(x, y).select(*key, "asset", "factor", F.col("slope").alias("beta"))
    sp = panels(spark, sf)[1].groupBy("asset").agg((F.var_samp("y") / 4).alias("var")).select(*key, "asset", "var")
    return b, V.factor_covariance(x, 0), sp


@query(with_base(COV, "SELECT f, g, round(cov, 6) + 0.0 AS cov FROM sg"))
def factor_covariance(spark, sf):
    return _cov(spark, sf)[1].select("f", "g", rounded("cov").alias("cov"))


@query(with_base(COV, "SELECT ld.asset AS a, z.asset AS b, round(sum(load * slope) + CASE WHEN ld.asset = z.asset THEN any_value(var) * 0.5 ELSE 0 END, 6) + 0.0 AS cov FROM ld JOIN z ON f = factor JOIN sp ON sp.asset = ld.asset GROUP BY 1, 2"))
def asset_covariance(spark, sf):
    return V.covariance(*_cov(spark, sf), 0.5).select("a", "b", rounded("cov").alias("cov"))


@query(with_base(COV, "SELECT asset, round(sys, 6) + 0.0 AS systematic, round(sqrt(sys), 6) + 0.0 AS systematic_vol, round(sqrt(var), 6) + 0.0 AS residual_vol, round(sqrt(sys + var), 6) + 0.0 AS total_vol FROM (SELECT asset, sum(load * slope) AS sys FROM ld JOIN z USING (asset) WHERE f = factor GROUP BY 1) JOIN sp USING (asset)"))
def asset_variances(spark, sf):
    return V.variances(*_cov(spark, sf)).select("asset", *(rounded(c).alias(c) for c in ("systematic", "systematic_vol", "residual_vol", "total_vol")))


@query(with_base(COV, "SELECT 'new_' || asset AS asset, factor, round(slope, 6) + 0.0 AS beta FROM z WHERE asset IN (SELECT asset FROM k WHERE cluster = 'R2')"))
def keep_assets(spark, sf):
    m = panels(spark, sf)[2].where("cluster = 'R2'").select(F.col("asset").alias("old"), F.concat(F.lit("new_"), "asset").alias("new"))
    return V.keep_assets(_cov(spark, sf)[0], m).select("asset", "factor", rounded("beta").alias("beta"))


@query(with_base(",\nq AS (SELECT *, CASE WHEN cluster = 'R0' THEN 12.0::DOUBLE ELSE 36.0::DOUBLE END AS span, row_number() OVER (PARTITION BY asset ORDER BY t DESC) - 1 AS age, min(t) OVER (PARTITION BY asset) AS t0 FROM yd)", "SELECT asset, round(sum(pow(1 - 2 / (span + 1), age) * CASE WHEN t = t0 THEN 1 ELSE 2 / (span + 1) END * y), 6) + 0.0 AS alpha FROM q GROUP BY 1"))
def estimate_alpha(spark, sf):
    _, y, k = centred(spark, sf)
    spans = k.where("cluster = 'R0'").select("asset", F.lit(12.0).alias("span"))
    return V.estimate_alpha(y, spans, 36.0).select("asset", rounded("alpha").alias("alpha"))


# ---- metrics and diagnostics


def _est(spark, sf):
    x, y, k = centred(spark, sf)
    own = S.slope_tests(x, y)
    est = own.select("panel", "asset", "factor", F.when(F.col("sign") != 0, F.col("slope")).otherwise(0.0).alias("beta"), "sign")
    pooled = S.to_assets(S.slope_tests(x, y, k), k)
    return est, pooled.select("panel", "asset", "factor", F.when(F.col("sign") != 0, F.col("slope")).otherwise(0.0).alias("beta")), k


EST = TESTS.format(key="asset") + """,
pm AS (SELECT cluster, factor, sum(x * y) AS xy, sum(x * x) AS xx, sum(y * y) AS yy, count(*) AS n, count(DISTINCT asset) AS q FROM yd JOIN xd USING (t) GROUP BY 1, 2),
pz AS (SELECT cluster, factor, CASE WHEN abs(xy / xx / sqrt(greatest(0.0, yy - xy * xy / xx) / greatest(n - q, 1) / xx)) < 0.75 THEN 0 ELSE xy / xx END AS b0 FROM pm),
bt AS (SELECT asset, factor, CASE WHEN sign <> 0 THEN slope ELSE 0 END AS b, sign, b0, sign(b0)::INTEGER AS s0 FROM z JOIN k USING (asset) JOIN pz USING (cluster, factor)),
ct AS (SELECT count(*) FILTER (WHERE abs(b) > 1e-6 AND abs(b0) > 1e-6) AS tp, count(*) FILTER (WHERE abs(b) > 1e-6 AND abs(b0) <= 1e-6) AS fp, count(*) FILTER (WHERE abs(b) <= 1e-6 AND abs(b0) > 1e-6) AS fn, avg(CASE WHEN abs(b) > 1e-6 AND abs(b0) > 1e-6 THEN (sign(b) = sign(b0))::INTEGER END) AS sign_rate, sum((b - b0) * (b - b0)) / sum(b0 * b0) AS mse FROM bt)"""


@query(with_base(EST, "SELECT round(tp / (tp + fp)::DOUBLE, 6) + 0.0 AS precision, round(tp / (tp + fn)::DOUBLE, 6) + 0.0 AS recall, round(2 * tp / (2 * tp + fp + fn)::DOUBLE, 6) + 0.0 AS f1, round(sign_rate, 6) + 0.0 AS sign_rate, round(mse, 6) + 0.0 AS beta_mse FROM ct"))
def support_recovery(spark, sf):
    est, truth, _ = _est(spark, sf)
    return M.support(est, truth).select(*(rounded(c).alias(c) for c in ("precision", "recall", "f1", "sign_rate", "beta_mse")))


@query(with_base(EST, "SELECT round(avg(CASE WHEN s0 <> 0 THEN (sign = s0)::INTEGER END), 6) + 0.0 AS recovery, round(avg(CASE WHEN s0 <> 0 THEN (sign = -s0)::INTEGER END), 6) + 0.0 AS flip, round(avg(CASE WHEN s0 <> 0 THEN (sign = 0)::INTEGER END), 6) + 0.0 AS abstain, round(avg(CASE WHEN s0 = 0 THEN (sign <> 0)::INTEGER END), 6) + 0.0 AS false_sign FROM bt"))
def sign_scores(spark, sf):
    est, truth, _ = _est(spark, sf)
    return M.sign_scores(est, truth).select(*(rounded(c).alias(c) for c in ("recovery", "flip", "abstain", "false_sign")))


@query(with_base(EST, "SELECT round(avg(s / n), 6) + 0.0 AS coherence FROM (SELECT abs(sum(CASE WHEN abs(b) > 1e-6 THEN sign(b) ELSE 0 END))::DOUBLE AS s, count(*) FILTER (WHERE abs(b) > 1e-6) AS n FROM bt JOIN k USING (asset) GROUP BY cluster, factor) WHERE n > 0"))
def sign_coherence(spark, sf):
    est, _, k = _est(spark, sf)
    return M.coherence(est, k).select(rounded("coherence").alias("coherence"))


@query(with_base(PARTS + """,
j AS (SELECT a.cluster AS x, b.cluster AS y FROM p a JOIN p b USING (asset) WHERE a.as_of = 1996 AND b.as_of = 1997),
c AS (SELECT x, y, count(*) AS n FROM j GROUP BY 1, 2),
u AS (SELECT sum(n * (n - 1) / 2) AS c, sum(n) AS tot FROM c), ux AS (SELECT sum(n * (n - 1) / 2) AS s FROM (SELECT sum(n) AS n FROM c GROUP BY x)), uy AS (SELECT sum(n * (n - 1) / 2) AS s FROM (SELECT sum(n) AS n FROM c GROUP BY y))""", "SELECT round((c - ux.s * uy.s / (tot * (tot - 1) / 2)) / ((ux.s + uy.s) / 2 - ux.s * uy.s / (tot * (tot - 1) / 2)), 6) + 0.0 AS ari FROM u, ux, uy"))
def adjusted_rand(spark, sf):
    p = yearly(spark, sf)
    return M.rand_index(p.where("as_of = 1996"), p.where("as_of = 1997")).select(rounded("ari").alias("ari"))


@query(with_base(EST + ",\ncut AS (SELECT greatest(0.02::DOUBLE, 1e-4 * max(abs(b))) AS c FROM bt),\non0 AS (SELECT asset, factor, (abs(b) > c)::INTEGER AS o FROM bt, cut)", "SELECT count(DISTINCT asset) AS n_assets, count(DISTINCT factor) AS n_factors, sum(o)::BIGINT AS n_nonzero, coalesce((SELECT string_agg(asset, ',' ORDER BY asset) FROM (SELECT asset FROM on0 GROUP BY 1 HAVING max(o) = 0)), '') AS empty_assets FROM on0"))
def effective_sparsity(spark, sf):
    return G.effective_sparsity(_est(spark, sf)[0], 0.02).select("n_assets", "n_factors", "n_nonzero", "empty_assets")


@query(with_base(EST + ",\ngp AS (SELECT b, lag(b) OVER (ORDER BY b) AS low FROM (SELECT abs(b) AS b FROM bt WHERE b <> 0))", "SELECT round(sqrt(b * low), 6) + 0.0 AS tolerance FROM gp WHERE low IS NOT NULL ORDER BY round(log10(b) - log10(low), 12) DESC, b LIMIT 1"))
def suggest_tolerance(spark, sf):
    return G.suggest_tolerance(_est(spark, sf)[0]).select(rounded("tolerance").alias("tolerance"))


def _resid(spark, sf):
    f, x, y, _ = _one_factor(spark, sf)
    return f.predict(x).join(y, ["panel", "t", "asset"]).select("panel", "t", "asset", (F.col("y") - F.col("y_hat")).alias("y"))


@query()
def residual_diagnostics(spark, sf):
    d = G.diagnose(_resid(spark, sf), n_fitted=1)
    return d.select("n_series", "n_pairs", *(rounded(c, 4).alias(c) for c in ("statistic", "threshold", "top_eigenvalue", "edge")), "passes")


RESID = ONE + """,
rs AS (SELECT asset, t, y - (beta * (x - avg(x) OVER (PARTITION BY asset)) + avg(y) OVER (PARTITION BY asset)) AS e, y FROM y JOIN (SELECT t, x FROM x WHERE factor = 'R0') USING (t) JOIN o USING (asset))"""


@query(with_base(RESID + """,
rp AS (SELECT a.asset AS a, b.asset AS b, CASE WHEN count(*) >= 30 THEN corr(a.e, b.e) END AS rho FROM rs a JOIN rs b USING (t) WHERE a.asset < b.asset GROUP BY 1, 2),
le AS (SELECT min(n) - 2 AS nu, count(*) AS k FROM (SELECT count(*) AS n FROM rs GROUP BY asset))""", "SELECT any_value(k)::INTEGER AS n_series, count(rho)::INTEGER AS n_pairs, round(any_value(nu) * sum(rho * rho), 4) + 0.0 AS statistic FROM rp, le"))
def residual_statistic(spark, sf):
    return G.diagnose(_resid(spark, sf), n_fitted=1).select("n_series", "n_pairs", rounded("statistic", 4).alias("statistic"))


@query(with_base(RESID, "SELECT round(1 - sum(r) / sum(s), 6) + 0.0 AS r2 FROM (SELECT sum(e * e) AS r, var_pop(y) * count(y) AS s FROM rs GROUP BY asset)"))
def pooled_r2(spark, sf):
    f, x, y, _ = _one_factor(spark, sf)
    return M.out_of_sample_r2(f.predict(x), y).select(rounded("r2").alias("r2"))


@query()
def missing_factors(spark, sf):
    return G.missing_factors(_resid(spark, sf), n_fitted=1).select("component", "asset", rounded("loading", 4).alias("loading"))


# ---- lineage


FACTORS = [f"R{i}" for i in range(5)]
TAXONOMY = L.Taxonomy(equity="R1", mixed=0.9, stable=0.2, drifting=0.3, vol_low=1.0, vol_high=1.5)

#: A snapshot for each year: slopes of the year's months, their covariances and variances, and the year's clusters.
YEARS = PARTS + """,
yz AS (SELECT (t // 12)::INTEGER AS idx, asset, factor, sum(x * y) / sum(x * x) AS beta FROM yd JOIN xd USING (t) GROUP BY 1, 2, 3),
ys AS (SELECT (a.t // 12)::INTEGER AS idx, a.factor AS f, b.factor AS g, covar_samp(a.x, b.x) AS cov FROM xd a JOIN xd b USING (t) GROUP BY 1, 2, 3),
yp AS (SELECT (t // 12)::INTEGER AS idx, asset, var_samp(y) / 4 AS var, regr_r2(y, x) AS r2, regr_intercept(y, x) AS insample_alpha FROM y JOIN (SELECT t, x FROM x WHERE factor = 'R0') USING (t) GROUP BY 1, 2),
pt AS (SELECT as_of AS idx, asset, cluster FROM p),
fb AS (SELECT idx, cluster, factor, avg(beta) AS b FROM pt JOIN yz USING (idx, asset) GROUP BY 1, 2, 3),
fc AS (SELECT a.idx, a.cluster, a.factor, any_value(a.b) * sum(b.b * cov) AS c FROM fb a JOIN fb b USING (idx, cluster) JOIN ys ON ys.idx = a.idx AND f = a.factor AND g = b.factor GROUP BY 1, 2, 3),
fp AS (SELECT idx, cluster AS label, sum(c) AS factor_var, CASE WHEN max(c) > 0 THEN arg_max(factor, c) ELSE 'Idio' END AS dominant FROM fc GROUP BY 1, 2),
fi AS (SELECT idx, cluster AS label, count(*) AS size, sum(var) / count(*) / count(*) AS idio_var FROM pt JOIN yp USING (idx, asset) GROUP BY 1, 2),
tp AS (SELECT idx, label, size, dominant, sqrt(factor_var) AS factor_vol, sqrt(idio_var) AS idio_vol, sqrt(factor_var + idio_var) AS total_vol, factor_var / (factor_var + idio_var) AS r2 FROM fp JOIN fi USING (idx, label))"""


def _years(spark, sf):
    """(clusters, betas, sigma, specific), by idx."""
    x, y, _ = centred(spark, sf)
    raw_x, raw_y, _ = panels(spark, sf)
    year = F.floor(F.col("t") / 12).cast("int").alias("idx")
    both = y.join(x, ["panel", "t"])
    b = both.groupBy("panel", year, "asset", "factor").agg((F.sum(F.col("x") * F.col("y")) / F.sum(F.col("x") * F.col("x"))).alias("beta"))
    one, two = x.select("panel", "t", F.col("factor").alias("f"), F.col("x").alias("u")), x.select("panel", "t", F.col("factor").alias("g"), F.col("x").alias("v"))
    sg = one.join(two, ["panel", "t"]).groupBy("panel", year, "f", "g").agg(F.covar_samp("u", "v").alias("cov"))
    sp = raw_y.join(raw_x.where("factor = 'R0'"), ["panel", "t"]).groupBy("panel", year, "asset").agg((F.var_samp("y") / 4).alias("var"), F.regr_r2("y", "x").alias("r2"), F.regr_intercept("y", "x").alias("insample_alpha"))
    return yearly(spark, sf).withColumnRenamed("as_of", "idx"), b, sg, sp


def _snapshots(spark, sf):
    p, b, sg, sp = _years(spark, sf)
    return L.fingerprints(p, b, sg, sp), sg, p


@query(with_base(YEARS, "SELECT idx, label, size, dominant, round(factor_vol * factor_vol, 6) + 0.0 AS factor_var, round(idio_vol * idio_vol, 6) + 0.0 AS idio_var FROM tp"))
def cluster_fingerprints(spark, sf):
    fp, _, _ = _snapshots(spark, sf)
    return fp.select("idx", "label", F.size("members").cast("long").alias("size"), "dominant", rounded("factor_var").alias("factor_var"), rounded("idio_var").alias("idio_var"))


@query(with_base(YEARS + """,
vl AS (SELECT idx, asset, greatest(0, total) AS v FROM (SELECT a.idx, a.asset, sum(a.beta * b.beta * cov) + any_value(var) AS total FROM yz a JOIN yz b USING (idx, asset) JOIN ys ON ys.idx = a.idx AND f = a.factor AND g = b.factor JOIN yp ON yp.idx = a.idx AND yp.asset = a.asset GROUP BY 1, 2)),
wt AS (SELECT idx, asset, cluster, 1 / sqrt(v) / sum(1 / sqrt(v)) OVER (PARTITION BY idx, cluster) AS w FROM pt JOIN vl USING (idx, asset)),
wb AS (SELECT idx, cluster, factor, sum(w * beta) AS b FROM wt JOIN yz USING (idx, asset) GROUP BY 1, 2, 3)""", "SELECT a.idx, a.cluster AS label, round(sum(a.b * b.b * cov), 6) + 0.0 AS factor_var, round(any_value(i), 6) + 0.0 AS idio_var FROM wb a JOIN wb b USING (idx, cluster) JOIN ys ON ys.idx = a.idx AND f = a.factor AND g = b.factor JOIN (SELECT idx, cluster, sum(w * w * var) AS i FROM wt JOIN yp USING (idx, asset) GROUP BY 1, 2) n ON n.idx = a.idx AND n.cluster = a.cluster GROUP BY 1, 2"))
def cluster_fingerprints_inverse_vol(spark, sf):
    return L.fingerprints(*_years(spark, sf), "inverse_vol").select("idx", "label", rounded("factor_var").alias("factor_var"), rounded("idio_var").alias("idio_var"))


CUT = 0.5  # betas of single years move far more than the default tells apart


@query(with_base(YEARS + """,
cm AS (SELECT a.idx AS i, b.idx AS j, a.cluster AS a, b.cluster AS b, count(*) AS n FROM pt a JOIN pt b USING (asset) WHERE b.idx - a.idx IN (1, 2) GROUP BY 1, 2, 3, 4),
na AS (SELECT i, j, a, sum(n) AS na FROM cm GROUP BY 1, 2, 3), nb AS (SELECT i, j, b, sum(n) AS nb FROM cm GROUP BY 1, 2, 4 - 1),
df AS (SELECT u.idx AS i, v.idx AS j, u.cluster AS a, v.cluster AS b, factor, v.b - u.b AS d FROM fb u JOIN fb v USING (factor) WHERE v.idx - u.idx IN (1, 2)),
ms AS (SELECT u.idx AS i, v.idx AS j, f, g, (u.cov + v.cov) / 2 AS cov FROM ys u JOIN ys v USING (f, g) WHERE v.idx - u.idx IN (1, 2)),
sd AS (SELECT i, j, a, b, sqrt(greatest(0, sum(x.d * y.d * cov))) AS spread FROM df x JOIN df y USING (i, j, a, b) JOIN ms USING (i, j) WHERE f = x.factor AND g = y.factor GROUP BY 1, 2, 3, 4),
lk AS (SELECT i, j, a, b, coalesce(n / least(na, nb)::DOUBLE, 0) AS ov, spread, exp(-spread * spread / (2 * 0.5 * 0.5)) AS near FROM sd LEFT JOIN cm USING (i, j, a, b) LEFT JOIN na USING (i, j, a) LEFT JOIN nb USING (i, j, b))""".replace("GROUP BY 1, 2, 4 - 1", "GROUP BY 1, 2, 3"), "SELECT i, a, j, b, round(ov, 6) + 0.0 AS ov, round(spread, 6) + 0.0 AS spread, round(CASE WHEN ov >= 0.6 THEN ov + near ELSE 0.5 * ov + 0.5 * near END * pow(0.5::DOUBLE, j - i - 1), 6) + 0.0 AS weight FROM lk WHERE ov >= 0.6 OR (ov >= 0.3 AND spread <= 0.5)"))
def lineage_links(spark, sf):
    fp, sg, _ = _snapshots(spark, sf)
    return L.links(fp, sg, cut=CUT).select("i", "a", "j", "b", rounded("ov").alias("ov"), rounded("spread").alias("spread"), rounded("weight").alias("weight"))


def _named(p: DataFrame) -> DataFrame:
    """Clusters that keep their label are one track: a lineage that SQL can say."""
    return p.select("panel", F.lit("label").alias("kind"), "idx", F.col("cluster").alias("label"), F.concat(F.lit("d"), "cluster").alias("track")).distinct()


def _track(spark, sf):
    fp, sg, p = _snapshots(spark, sf)
    return L.track_panel(_named(p), fp), sg, p


@query(with_base(YEARS, "SELECT 'd' || label AS track, idx, size::INTEGER AS size, dominant, round(factor_vol, 6) + 0.0 AS factor_vol, round(idio_vol, 6) + 0.0 AS idio_vol, round(total_vol, 6) + 0.0 AS total_vol, round(r2, 6) + 0.0 AS r2 FROM tp"))
def track_panel(spark, sf):
    return _track(spark, sf)[0].select("track", "idx", "size", "dominant", *(rounded(c).alias(c) for c in ("factor_vol", "idio_vol", "total_vol", "r2")))


SPREADS = YEARS + """,
dv AS (SELECT idx, cluster, factor, b - avg(b) OVER (PARTITION BY cluster, factor) AS d FROM fb),
tl AS (SELECT DISTINCT idx, cluster FROM pt),
av AS (SELECT cluster, f, g, avg(cov) AS cov FROM tl JOIN ys USING (idx) GROUP BY 1, 2, 3),
sr AS (SELECT idx, a.cluster AS label, sqrt(greatest(0, sum(a.d * b.d * cov))) AS spread FROM dv a JOIN dv b USING (idx, cluster) JOIN av ON av.cluster = a.cluster AND f = a.factor AND g = b.factor GROUP BY 1, 2)"""


@query(with_base(SPREADS, "SELECT 'd' || label AS track, idx, round(spread, 6) + 0.0 AS spread FROM sr"))
def track_spreads(spark, sf):
    panel, sg, _ = _track(spark, sf)
    return L.spreads(panel, sg).select("track", "idx", rounded("spread").alias("spread"))


@query(with_base(SPREADS, "SELECT 'd' || label AS track, idx, 'beta_break' AS event, printf('spread_vol=%.3f', spread) AS detail FROM sr WHERE spread >= 0.3"))
def track_breaks(spark, sf):
    panel, sg, _ = _track(spark, sf)
    return L.beta_breaks(L.spreads(panel, sg), TAXONOMY).drop("panel")


@query(with_base(SPREADS + """,
mo AS (SELECT label, dominant AS modal, k / sum(k) OVER (PARTITION BY label)::DOUBLE AS modal_share, row_number() OVER (PARTITION BY label ORDER BY k DESC, f) AS r FROM (SELECT label, dominant, count(*) AS k, min(idx) AS f FROM tp GROUP BY 1, 2)),
eq AS (SELECT cluster AS label, avg(b) AS eq FROM fb WHERE factor = 'R1' GROUP BY 1),
li AS (SELECT label, count(*) AS lifetime, avg(factor_vol) AS mv, CASE WHEN count(*) >= 3 THEN regr_slope(factor_vol, i) ELSE 0 END AS vt FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY idx) AS i FROM tp) GROUP BY 1),
md AS (SELECT label, median(spread) AS s FROM sr GROUP BY 1),
al AS (SELECT *, lifetime / (SELECT count(DISTINCT idx) FROM pt)::DOUBLE AS cv FROM li JOIN mo USING (label) JOIN eq USING (label) JOIN md USING (label) WHERE r = 1)""", """SELECT 'd' || label AS track, CASE WHEN modal_share < 0.9 THEN 'Mixed' WHEN modal = 'R1' THEN CASE WHEN eq >= 0.7 THEN 'Equity-HighBeta' WHEN eq <= 0.3 THEN 'Equity-Defensive' ELSE 'Equity-Core' END ELSE modal END AS kind,
round(s, 6) + 0.0 AS stability, CASE WHEN s <= 0.2 THEN 'Stable' WHEN s >= 0.3 THEN 'Drifting' ELSE 'Transitioning' END AS stability_label, round(cv, 6) + 0.0 AS coverage, lifetime, CASE WHEN cv >= 0.7 THEN 'Core' WHEN cv < 0.3 THEN 'Transient' ELSE 'Episodic' END AS persistence,
round(mv, 6) + 0.0 AS mean_factor_vol, CASE WHEN mv < 1 THEN 'Low' WHEN mv > 1.5 THEN 'High' ELSE 'Mid' END AS vol_regime, round(vt, 6) + 0.0 AS vol_trend, modal, round(modal_share, 6) + 0.0 AS modal_share FROM al"""))
def track_classes(spark, sf):
    panel, sg, p = _track(spark, sf)
    c = L.classify(panel, L.spreads(panel, sg), p, FACTORS, TAXONOMY)
    return c.select("track", "kind", rounded("stability").alias("stability"), "stability_label", rounded("coverage").alias("coverage"), "lifetime", "persistence", rounded("mean_factor_vol").alias("mean_factor_vol"), "vol_regime", rounded("vol_trend").alias("vol_trend"), "modal", rounded("modal_share").alias("modal_share"))


RENAMED = "CASE factor WHEN 'R0' THEN 'Equity' WHEN 'R1' THEN 'Rates' ELSE factor END"


@query(with_base(YEARS + f""",
mb AS (SELECT cluster, factor, avg(b) AS b FROM fb GROUP BY 1, 2),
wh AS (SELECT a.factor AS f, b.factor AS g, covar_samp(a.x, b.x) AS cov FROM xd a JOIN xd b USING (t) GROUP BY 1, 2),
ct AS (SELECT a.cluster, a.factor, any_value(a.b) AS b, greatest(0, any_value(a.b) * sum(b.b * cov)) AS c FROM mb a JOIN mb b USING (cluster) JOIN wh ON f = a.factor AND g = b.factor GROUP BY 1, 2),
rk AS (SELECT cluster, {RENAMED} AS factor, b, c, sum(c) OVER (PARTITION BY cluster) AS al, row_number() OVER (PARTITION BY cluster ORDER BY c DESC, factor DESC) AS r FROM ct),
vo AS (SELECT label, avg(factor_vol) AS v FROM tp GROUP BY 1)""", "SELECT 'd' || a.cluster AS track, a.factor || CASE a.factor WHEN 'Equity' THEN CASE WHEN a.b >= 0.7 THEN ' high-β' WHEN a.b <= 0.3 THEN ' defensive' ELSE ' core' END WHEN 'Rates' THEN CASE WHEN a.b > 0 THEN ' long-duration' ELSE ' short-duration' END ELSE CASE WHEN a.b < 0 THEN ' short' ELSE '' END END || CASE WHEN o.c >= 0.35 * a.al THEN ' + ' || o.factor ELSE '' END || ' · ' || CASE WHEN v < 1 THEN 'low-vol' WHEN v > 1.5 THEN 'high-vol' ELSE 'mid-vol' END AS label FROM rk a JOIN rk o ON a.cluster = o.cluster AND a.r = 1 AND o.r = 2 JOIN vo ON label = a.cluster"))
def track_labels(spark, sf):
    panel, _, _ = _track(spark, sf)
    names = lambda c: F.when(F.col(c) == "R0", "Equity").when(F.col(c) == "R1", "Rates").otherwise(F.col(c))
    sg = V.factor_covariance(centred(spark, sf)[0]).select("panel", names("f").alias("f"), names("g").alias("g"), "cov")
    return L.factor_labels(panel, sg, ["Equity", "Rates", "R2", "R3", "R4"], taxonomy=TAXONOMY).select("track", "label")


@query(with_base(YEARS, "SELECT idx, asset, 'd' || cluster AS track FROM pt"))
def track_members(spark, sf):
    p = _years(spark, sf)[0]
    return L.label_panel(_named(p), p).select("idx", "asset", "track")


@query(with_base(YEARS, "SELECT asset, 'd' || cluster AS label FROM pt WHERE idx = (SELECT max(idx) FROM pt WHERE idx <= 2100)"))
def track_members_at(spark, sf):
    p = _years(spark, sf)[0]
    return L.labels_at(L.label_panel(_named(p), p), 2100).select("asset", "label")


@query(with_base(YEARS + """,
sv AS (SELECT a.idx, a.asset, sum(a.beta * b.beta * cov) AS sys FROM yz a JOIN yz b USING (idx, asset) JOIN ys ON ys.idx = a.idx AND f = a.factor AND g = b.factor GROUP BY 1, 2),
bw AS (SELECT idx, asset, max(beta) FILTER (WHERE factor = 'R0') AS b0, max(beta) FILTER (WHERE factor = 'R4') AS b4 FROM yz GROUP BY 1, 2)""", "SELECT idx AS as_of, asset, round(b0, 6) + 0.0 AS beta_r0, round(b4, 6) + 0.0 AS beta_r4, round(r2, 6) + 0.0 AS r2, round(insample_alpha, 6) + 0.0 AS alpha, round(sys, 6) + 0.0 AS systematic, round(var, 6) + 0.0 AS residual, round(sqrt(greatest(0, sys + var)), 6) + 0.0 AS total_vol FROM sv JOIN bw USING (idx, asset) JOIN yp USING (idx, asset)"))
def covariance_snapshot(spark, sf):
    b, sg, sp = (df.withColumnRenamed("idx", "as_of") for df in _years(spark, sf)[1:])
    out = V.snapshot(b, sg, sp, FACTORS)
    return out.select("as_of", "asset", *(rounded(c).alias(c.lower()) for c in ("beta_R0", "beta_R4", "r2", "alpha", "systematic", "residual", "total_vol")))


@query(with_base(YEARS, "SELECT idx AS as_of, f AS factor, round(cov, 6) + 0.0 AS var FROM ys WHERE f = g"))
def factor_variance_series(spark, sf):
    return V.factor_variances(_years(spark, sf)[2].withColumnRenamed("idx", "as_of")).select("as_of", "factor", rounded("var").alias("var"))


@query(with_base(YEARS, "SELECT idx AS as_of, asset, factor, round(beta, 6) + 0.0 AS beta FROM yz WHERE idx = (SELECT max(idx) FROM yz)"))
def latest_betas(spark, sf):
    return V.latest(_years(spark, sf)[1].withColumnRenamed("idx", "as_of")).select("as_of", "asset", "factor", rounded("beta").alias("beta"))


@query()
def lineage_tracks(spark, sf):
    fp, sg, _ = _snapshots(spark, sf)
    return L.tracks(fp, L.links(fp, sg, cut=CUT))


@query()
def lineage_tracks_stepwise(spark, sf):
    fp, sg, _ = _snapshots(spark, sf)
    return L.tracks(fp, L.links(fp, sg, cut=CUT), "steps")


@query()
def lineage_classes(spark, sf):
    out = L.analyze(*_years(spark, sf), FACTORS, taxonomy=TAXONOMY, cut=CUT)["classes"]
    return out.select("track", "kind", rounded("stability", 5).alias("stability"), "stability_label", rounded("coverage").alias("coverage"), "lifetime", "persistence", rounded("mean_factor_vol", 5).alias("mean_factor_vol"), "vol_regime", "modal")


__all__ = ["QUERIES", "SQL", "C"]
