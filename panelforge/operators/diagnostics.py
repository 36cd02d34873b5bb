"""What residuals and coefficients say about a fit."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .dependence import marchenko_pastur_edge, pearson


def gamma_q(a: float, x: float) -> float:
    """Upper regularised incomplete gamma function, by its series or its continued fraction."""
    if x <= 0:
        return 1.0
    front = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        n = a
        while abs(term) > abs(total) * 1e-16:
            n += 1
            term *= x / n
            total += term
        return 1 - total * front
    tiny, b = 1e-300, x + 1 - a
    c, d = 1 / tiny, 1 / b
    h = d
    for i in range(1, 100_000):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b or tiny)
        c = b + an / c or tiny
        h *= d * c
        if abs(d * c - 1) < 1e-16:
            break
    return front * h


def null_threshold(pairs: int, significance: float = 0.05) -> float:
    """Upper quantile of chi-squared with so many degrees of freedom."""
    lo, hi = 0.0, pairs + 20 * math.sqrt(2 * pairs) + 50
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if gamma_q(pairs / 2, mid / 2) > significance else (lo, mid)
    return (lo + hi) / 2


def _matrix(names: list[str], pairs) -> np.ndarray:
    at, m = {n: i for i, n in enumerate(names)}, np.eye(len(names))
    for p in pairs if pairs is not None else ():
        v = p["rho"]
        m[at[p["a"]], at[p["b"]]] = m[at[p["b"]], at[p["a"]]] = 0.0 if v is None or np.isnan(v) else v
    return m


def _per_panel(resid: DataFrame, min_periods: int) -> DataFrame:
    names = resid.where("y is not null").groupBy("panel", "asset").agg(F.count("y").alias("n")).groupBy("panel").agg(F.sort_array(F.collect_list("asset")).alias("names"), F.min("n").alias("least"))
    rho = pearson(resid, min_periods=min_periods).groupBy("panel").agg(F.collect_list(F.struct("a", "b", "rho")).alias("pairs"), F.sum(F.col("rho") * F.col("rho")).alias("mass"), F.count("rho").alias("n_pairs"))
    return names.join(rho, "panel")


def diagnose(resid: DataFrame, n_fitted: int = 0, significance: float = 0.05, min_periods: int = 30) -> DataFrame:
    """panel, nu, n_series, n_pairs, statistic, threshold, top_eigenvalue, edge, passes of residuals (panel, t, asset, y)."""
    schema = "panel string, nu double, n_series int, n_pairs int, statistic double, threshold double, top_eigenvalue double, edge double, passes boolean"

    def run(frames):
        for pdf in frames:
            out = []
            for r in pdf.itertuples():
                nu = r.least - n_fitted - 1
                if nu <= 1:
                    raise ValueError(f"too few rows to judge the residuals of {r.panel}")
                mass = 0.0 if r.mass is None or np.isnan(r.mass) else r.mass
                top = float(np.linalg.eigvalsh(_matrix(r.names, r.pairs))[-1])
                limit, edge = null_threshold(int(r.n_pairs), significance), marchenko_pastur_edge(len(r.names), nu)
                out.append((r.panel, nu, len(r.names), int(r.n_pairs), nu * mass, limit, top, edge, bool(nu * mass <= limit and top <= edge)))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in schema.split(", ")])

    return _per_panel(resid, min_periods).mapInPandas(run, schema)


def missing_factors(resid: DataFrame, n_fitted: int = 0, floor: float = 0.25, min_periods: int = 30) -> DataFrame:
    """panel, component, eigenvalue, asset, loading: components above the noise edge and the assets that load on them; the largest loading is positive."""
    schema = "panel string, component int, eigenvalue double, asset string, loading double"

    def run(frames):
        for pdf in frames:
            out = []
            for r in pdf.itertuples():
                values, vectors = np.linalg.eigh(_matrix(r.names, r.pairs))
                edge = marchenko_pastur_edge(len(r.names), max(1, r.least - n_fitted - 1))
                for k in range(len(values)):
                    v, w = values[-1 - k], vectors[:, -1 - k]
                    if v <= edge:
                        break
                    w = w * np.sign(w[np.argmax(np.abs(w))])
                    out += [(r.panel, k, float(v), a, float(x)) for a, x in zip(r.names, w, strict=True) if abs(x) >= floor]
            yield pd.DataFrame(out, columns=[c.split()[0] for c in schema.split(", ")])

    return _per_panel(resid, min_periods).mapInPandas(run, schema)


def suggest_tolerance(coef: DataFrame) -> DataFrame:
    """panel, tolerance: the middle, on a log scale, of the widest gap between sizes of coefficients."""
    b = coef.where("beta is not null and beta <> 0").select("panel", F.abs("beta").alias("b"))
    low = F.lag("b").over(Window.partitionBy("panel").orderBy("b"))
    g = b.withColumn("low", low).where("low is not null").withColumn("gap", F.log10("b") - F.log10("low"))
    return g.groupBy("panel").agg(F.max(F.struct(F.round("gap", 12).alias("gap"), (-F.col("b")).alias("o"), F.sqrt(F.col("b") * F.col("low")).alias("tolerance")))["tolerance"].alias("tolerance"))


def effective_sparsity(coef: DataFrame, tolerance: float = 0.0, relative: float = 1e-4) -> DataFrame:
    """panel, n_assets, n_factors, n_nonzero, n_missing, empty_assets, empty_factors: what stands out from 0 by max(tolerance, relative * largest)."""
    top = coef.groupBy("panel").agg(F.greatest(F.lit(tolerance), relative * F.max(F.abs("beta"))).alias("cut"))
    c = coef.join(F.broadcast(top), "panel").withColumn("on", F.coalesce(F.abs("beta") > F.col("cut"), F.lit(False)).cast("int"))
    total = c.groupBy("panel").agg(F.count_distinct("asset").alias("n_assets"), F.count_distinct("factor").alias("n_factors"), F.sum("on").cast("long").alias("n_nonzero"), F.count_if(F.col("beta").isNull()).alias("n_missing"))

    def empty(key: str) -> DataFrame:
        return c.groupBy("panel", key).agg(F.max("on").alias("on")).groupBy("panel").agg(F.array_join(F.sort_array(F.collect_list(F.when(F.col("on") == 0, F.col(key)))), ",").alias(f"empty_{key}s"))

    return total.join(empty("asset"), "panel").join(empty("factor"), "panel")
