"""How near estimates come to the truth. est and truth: (panel, asset, factor, beta)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KEY = ["panel", "asset", "factor"]


def _both(est: DataFrame, truth: DataFrame) -> DataFrame:
    return truth.select(*KEY, F.col("beta").alias("b0")).join(est.select(*KEY, F.coalesce("beta", F.lit(0.0)).alias("b")), KEY)


def support(est: DataFrame, truth: DataFrame, tol: float = 1e-6) -> DataFrame:
    """(panel, precision, recall, f1, sign_rate, beta_mse): of the non-zero cells, of signs among cells that are non-zero in truth and in the estimate, of squared errors over squared truth."""
    on, yes = F.abs("b") > tol, F.abs("b0") > tol
    g = _both(est, truth).groupBy("panel").agg(
        F.count_if(on & yes).alias("tp"), F.count_if(on & ~yes).alias("fp"), F.count_if(~on & yes).alias("fn"),
        F.avg(F.when(on & yes, (F.signum("b") == F.signum("b0")).cast("double"))).alias("sign_rate"),
        (F.sum(F.pow(F.col("b") - F.col("b0"), F.lit(2))) / F.nullif(F.sum(F.col("b0") * F.col("b0")), F.lit(0.0))).alias("beta_mse"),
    )
    div = lambda a, b: F.coalesce(a / F.nullif(b, F.lit(0)), F.lit(0.0))
    return g.select("panel", div(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"), div(F.col("tp"), F.col("tp") + F.col("fn")).alias("recall"), div(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")).alias("f1"), "sign_rate", "beta_mse")


def sign_scores(est: DataFrame, truth: DataFrame) -> DataFrame:
    """(panel, recovery, flip, abstain, false_sign) of derived signs (.., sign) against those of the true coefficients."""
    j = truth.select(*KEY, F.signum("beta").alias("s0")).join(est.select(*KEY, "sign"), KEY)
    true, null = F.col("s0") != 0, F.col("s0") == 0
    share = lambda when, what: F.avg(F.when(when, what.cast("double")))
    s = F.col("sign")
    return j.groupBy("panel").agg(share(true, s == F.col("s0")).alias("recovery"), share(true, s == -F.col("s0")).alias("flip"), share(true, s == 0).alias("abstain"), share(null, s != 0).alias("false_sign"))


def coherence(est: DataFrame, clusters: DataFrame, tol: float = 1e-6) -> DataFrame:
    """(panel, coherence): mean over (cluster, factor) of |sum of signs| over cells that are not 0."""
    on = F.abs("beta") > tol
    g = est.join(clusters, ["panel", "asset"]).groupBy("panel", "cluster", "factor").agg(F.abs(F.sum(F.when(on, F.signum("beta")).otherwise(0.0))).alias("s"), F.count_if(on).alias("n"))
    return g.where("n > 0").groupBy("panel").agg(F.avg(F.col("s") / F.col("n")).alias("coherence"))


def rand_index(a: DataFrame, b: DataFrame) -> DataFrame:
    """(panel, ari): adjusted Rand index of two partitions (panel, asset, cluster), from the counts of their cells."""
    j = a.select("panel", "asset", F.col("cluster").alias("x")).join(b.select("panel", "asset", F.col("cluster").alias("y")), ["panel", "asset"])
    two = lambda c: F.sum(F.col(c) * (F.col(c) - 1) / 2.0)
    cell = j.groupBy("panel", "x", "y").agg(F.count(F.lit(1)).alias("n"))
    both = cell.groupBy("panel").agg(two("n").alias("c"), F.sum("n").alias("all"))
    for k in "xy":
        both = both.join(cell.groupBy("panel", k).agg(F.sum("n").alias("n")).groupBy("panel").agg(two("n").alias(f"s{k}")), "panel")
    pairs = F.col("all") * (F.col("all") - 1) / 2.0
    want = F.col("sx") * F.col("sy") / F.nullif(pairs, F.lit(0.0))
    top = (F.col("sx") + F.col("sy")) / 2 - want
    return both.select("panel", F.when(top == 0, 1.0).otherwise((F.col("c") - want) / F.nullif(top, F.lit(0.0))).alias("ari"))


def out_of_sample_r2(predicted: DataFrame, y: DataFrame) -> DataFrame:
    """(panel, r2): 1 - SSR / SST pooled over the assets, SST around each asset's mean."""
    j = predicted.join(y.where("y is not null"), ["panel", "t", "asset"]).groupBy("panel", "asset").agg(F.sum(F.pow(F.col("y") - F.col("y_hat"), F.lit(2))).alias("ssr"), (F.var_pop("y") * F.count("y")).alias("sst"))
    return j.groupBy("panel").agg((1 - F.sum("ssr") / F.nullif(F.sum("sst"), F.lit(0.0))).alias("r2"))


def bic(rss: DataFrame) -> DataFrame:
    """rss (.., rss, n, df) with bic."""
    return rss.withColumn("bic", F.col("n") * F.log(F.col("rss") / F.col("n")) + F.col("df") * F.log("n"))
