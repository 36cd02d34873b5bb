"""Covariances from a fit. betas: (panel, as_of, asset, factor, beta); sigma: (panel, as_of, f, g, cov), both triangles; specific: (panel, as_of, asset, var)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KEY = ["panel", "as_of"]


def factor_covariance(x: DataFrame, as_of: int | None = None) -> DataFrame:
    """Sample covariance of the factors, both triangles."""
    one = x.select("panel", "t", F.col("factor").alias("f"), F.col("x").alias("u"))
    two = x.select("panel", "t", F.col("factor").alias("g"), F.col("x").alias("v"))
    c = one.join(two, ["panel", "t"]).groupBy("panel", "f", "g").agg(F.covar_samp("u", "v").alias("cov"))
    return c.select("panel", F.lit(as_of).cast("int").alias("as_of"), "f", "g", "cov") if as_of is not None else c


def loaded(betas: DataFrame, sigma: DataFrame) -> DataFrame:
    """(panel, as_of, asset, f, load): beta times sigma."""
    return betas.join(sigma.withColumnRenamed("g", "factor"), [*KEY, "factor"]).groupBy(*KEY, "asset", "f").agg(F.sum(F.col("beta") * F.col("cov")).alias("load"))


def covariance(betas: DataFrame, sigma: DataFrame, specific: DataFrame, weight: float = 1.0) -> DataFrame:
    """(panel, as_of, a, b, cov): beta sigma beta' + weight * diag(specific)."""
    left = loaded(betas, sigma).select(*KEY, F.col("asset").alias("a"), F.col("f").alias("factor"), "load")
    right = betas.select(*KEY, F.col("asset").alias("b"), "factor", "beta")
    c = left.join(right, [*KEY, "factor"]).groupBy(*KEY, "a", "b").agg(F.sum(F.col("load") * F.col("beta")).alias("sys"))
    c = c.join(specific.select(*KEY, F.col("asset").alias("a"), "var"), [*KEY, "a"], "left")
    return c.select(*KEY, "a", "b", (F.col("sys") + F.when(F.col("a") == F.col("b"), weight * F.coalesce("var", F.lit(0.0))).otherwise(0.0)).alias("cov"))


def variances(betas: DataFrame, sigma: DataFrame, specific: DataFrame) -> DataFrame:
    """Systematic, residual and total variance of each asset, and their roots; no pair but of an asset with itself is made."""
    s = loaded(betas, sigma).withColumnRenamed("f", "factor").join(betas, [*KEY, "asset", "factor"]).groupBy(*KEY, "asset").agg(F.sum(F.col("load") * F.col("beta")).alias("systematic"))
    s = s.join(specific, [*KEY, "asset"], "left").withColumn("residual", F.coalesce("var", F.lit(0.0))).drop("var")
    s = s.withColumn("total", F.col("systematic") + F.col("residual"))
    return s.select("*", *(F.sqrt(F.greatest(F.col(c), F.lit(0.0))).alias(f"{c}_vol") for c in ("systematic", "residual", "total")))


def keep_assets(table: DataFrame, assets: DataFrame, column: str = "asset") -> DataFrame:
    """The rows of the given assets (old, new), by their new names."""
    m = assets.select(F.col("old").alias(column), "new")
    return table.join(m, column).drop(column).withColumnRenamed("new", column).select(table.columns)


def factor_variances(sigma: DataFrame) -> DataFrame:
    """(panel, as_of, factor, var): the diagonal at every date."""
    return sigma.where("f = g").select(*KEY, F.col("f").alias("factor"), F.col("cov").alias("var"))


def snapshot(betas: DataFrame, sigma: DataFrame, specific: DataFrame, factors: list[str], alpha: DataFrame | None = None) -> DataFrame:
    """A row for each asset at each date: a column beta_<factor> for each factor, r2, alpha, insample_alpha, variances and volatilities. specific: (.., asset, var, r2, insample_alpha); alpha: (.., asset, alpha), the alpha of the fit without."""
    b = betas.groupBy(*KEY, "asset").agg(*(F.max(F.when(F.col("factor") == f, F.col("beta"))).alias(f"beta_{f}") for f in factors))
    out = b.join(specific.select(*KEY, "asset", "r2", "insample_alpha"), [*KEY, "asset"], "left")
    out = out.withColumn("alpha", F.col("insample_alpha")) if alpha is None else out.join(alpha.select(*KEY, "asset", "alpha"), [*KEY, "asset"], "left")
    return out.join(variances(betas, sigma, specific.select(*KEY, "asset", "var")), [*KEY, "asset"])


def latest(table: DataFrame) -> DataFrame:
    m = table.groupBy("panel").agg(F.max("as_of").alias("as_of"))
    return table.join(m, KEY).select(table.columns)


def save(tables: dict[str, DataFrame], path: str) -> None:
    """Each table in a folder of its own, by date."""
    for name, df in tables.items():
        df.write.mode("overwrite").partitionBy("as_of").parquet(f"{path}/{name}")


def load(spark, path: str, names: list[str]) -> dict[str, DataFrame]:
    return {n: spark.read.parquet(f"{path}/{n}") for n in names}


def estimate_alpha(resid: DataFrame, spans: DataFrame, default: float, insample: DataFrame | None = None) -> DataFrame:
    """(panel, asset, alpha): last exponentially weighted mean of the residuals (panel, t, asset, y), each asset with the span of its frequency; the alpha of the fit where there are none."""
    v = resid.where("y is not null").join(spans, "asset", "left").withColumn("lam", 1 - 2 / (F.floor(F.coalesce("span", F.lit(default))) + 1))
    ends = v.groupBy("panel", "asset").agg(F.min("t").alias("t0"), F.count(F.lit(1)).alias("n"))
    from pyspark.sql.window import Window

    age = F.row_number().over(Window.partitionBy("panel", "asset").orderBy(F.desc("t"))) - 1
    j = v.join(ends, ["panel", "asset"]).withColumn("age", age)
    w = F.pow("lam", "age") * F.when(F.col("t") == F.col("t0"), 1.0).otherwise(1 - F.col("lam"))
    out = j.groupBy("panel", "asset").agg(F.sum(w * F.col("y")).alias("alpha"))
    if insample is None:
        return out
    return insample.join(out, ["panel", "asset"], "left").select("panel", "asset", F.coalesce("alpha", "insample_alpha").alias("alpha"))
