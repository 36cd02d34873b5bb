"""Dependence of pairs of series: (panel, a, b, n, rho) for a < b, each pair once."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..config import Dependence, Distance, span_decay
from .weights import aged, demean


def pairs(df: DataFrame, key: str, value: str) -> DataFrame:
    """(panel, t, a, b, va, vb): values of two series at one time, both there. The join is on time, so a time's series meet and no others."""
    v = df.where(F.col(value).isNotNull())
    one = v.select("panel", "t", F.col(key).alias("a"), F.col(value).alias("va"))
    two = v.select("panel", "t", F.col(key).alias("b"), F.col(value).alias("vb"))
    return one.join(two, ["panel", "t"]).where("a < b")


def pearson(df: DataFrame, key: str = "asset", value: str = "y", min_periods: int = 1) -> DataFrame:
    """Pairwise complete; null below min_periods common rows."""
    p = pairs(df, key, value).groupBy("panel", "a", "b").agg(F.count(F.lit(1)).alias("n"), F.corr("va", "vb").alias("rho"))
    return p.withColumn("rho", F.when(F.col("n") >= min_periods, F.nanvl("rho", F.lit(None))))


def ranked(df: DataFrame, key: str, value: str) -> DataFrame:
    """Values by their ranks in the series, ties by the mean rank."""
    v = df.where(F.col(value).isNotNull())
    w = Window.partitionBy("panel", key)
    r = F.rank().over(w.orderBy(value)) + (F.count(F.lit(1)).over(w.partitionBy("panel", key, value)) - 1) / 2.0
    return v.withColumn(value, r)


def spearman(df: DataFrame, key: str = "asset", value: str = "y", min_periods: int = 1) -> DataFrame:
    return pearson(ranked(df, key, value), key, value, min_periods)


def gerber(df: DataFrame, key: str = "asset", value: str = "y", span: float | None = None, threshold: float = 0.5) -> DataFrame:
    """Weighted share of joint moves beyond `threshold` deviations, those together less those apart, among times when either moved."""
    decay = 1.0 if span is None else span_decay(span)
    v = aged(df).where(F.col(value).isNotNull()).withColumn("w", F.pow(F.lit(decay), F.col("age")))
    by = Window.partitionBy("panel", key)
    mean = F.sum(F.col("w") * F.col(value)).over(by) / F.sum("w").over(by)
    v = v.withColumn("m", mean).withColumn("sd", F.sqrt(F.sum(F.col("w") * F.pow(F.col(value) - F.col("m"), F.lit(2))).over(by) / F.sum("w").over(by)))
    bound = threshold * F.col("sd")
    up, down = (F.col(value) >= bound).cast("int"), (F.col(value) <= -bound).cast("int")
    s = v.select("panel", "t", F.col(key).alias("k"), "w", (up - down).alias("s"))
    p = s.select("panel", "t", "w", F.col("k").alias("a"), F.col("s").alias("sa")).join(s.select("panel", "t", F.col("k").alias("b"), F.col("s").alias("sb")), ["panel", "t"]).where("a < b")
    net = F.sum(F.col("w") * F.col("sa") * F.col("sb"))
    moved = F.sum(F.when((F.col("sa") != 0) | (F.col("sb") != 0), F.col("w")).otherwise(0.0))
    p = p.groupBy("panel", "a", "b").agg(F.count(F.lit(1)).alias("n"), net.alias("net"), moved.alias("moved"))
    rho = F.when(F.col("moved") > 0, F.least(F.lit(1.0), F.greatest(F.lit(-1.0), F.col("net") / F.nullif(F.col("moved"), F.lit(0.0))))).otherwise(0.0)
    return p.select("panel", "a", "b", "n", rho.alias("rho"))


def ewm_correlation(df: DataFrame, key: str, value: str, span: float, is_corr: bool = True) -> DataFrame:
    """Last state of the covariance recursion from zero, for series without gaps: a weighted sum of products."""
    decay = span_decay(span)
    v = aged(df).withColumn("w", F.pow(F.lit(decay), F.col("age")) * (1 - decay))
    one = v.select("panel", "t", "w", F.col(key).alias("a"), F.col(value).alias("va"))
    two = v.select("panel", "t", F.col(key).alias("b"), F.col(value).alias("vb"))
    c = one.join(two, ["panel", "t"]).where("a <= b").groupBy("panel", "a", "b").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("w") * F.col("va") * F.col("vb")).alias("cov"))
    if not is_corr:
        return c
    var = c.where("a = b").select("panel", F.col("a").alias("k"), F.col("cov").alias("v"))
    j = c.join(var.select("panel", F.col("k").alias("a"), F.col("v").alias("v1")), ["panel", "a"]).join(var.select("panel", F.col("k").alias("b"), F.col("v").alias("v2")), ["panel", "b"])
    ok = (F.col("v1") > 1e-12) & (F.col("v2") > 1e-12)
    return j.where("a < b").select("panel", "a", "b", "n", F.when(ok, F.col("cov") / F.sqrt(F.col("v1") * F.col("v2"))).otherwise(0.0).alias("rho"))


def dependence(df: DataFrame, measure: Dependence, key: str = "asset", value: str = "y", span: float | None = None, threshold: float = 0.5) -> DataFrame:
    if measure == Dependence.GERBER:
        return gerber(df, key, value, span, threshold)
    df = ranked(df, key, value) if measure == Dependence.SPEARMAN else df
    if span is None:
        return pearson(df, key, value)
    return ewm_correlation(demean(df, key, value), key, value, span)


def distance(rho: Column, kind: Distance = Distance.LINEAR) -> Column:
    r = F.least(F.lit(1.0), F.greatest(F.lit(-1.0), F.coalesce(rho, F.lit(0.0))))
    if kind == Distance.LINEAR:
        return 1 - r
    return F.sqrt(2 * (1 - r)) if kind == Distance.ROOT else F.acos(r)


def off_diagonal_mass(corr: DataFrame) -> DataFrame:
    return corr.groupBy("panel").agg(F.sum(F.col("rho") * F.col("rho")).alias("mass"), F.count("rho").alias("pairs"))


def marchenko_pastur_edge(n_series: int, nu: float) -> float:
    """Largest eigenvalue that pure noise would show."""
    if nu <= 0:
        raise ValueError("degrees of freedom must be positive")
    return (1 + math.sqrt(n_series / nu)) ** 2
