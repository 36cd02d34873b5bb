"""Choice of the penalty. Folds become panels, so one fit covers all folds and all penalties."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .diagnostics import diagnose, null_threshold
from .estimator import FactorModel, Fit, fit

GRID = np.logspace(-6, -1, 20).tolist()


def splits(n: int, folds: int) -> list[tuple[int, int, int]]:
    """(rows to train on, first and last + 1 row to test): growing trainings, tests of equal size; rows that don't divide are left at the end."""
    size = n // (folds + 1)
    if folds < 1 or size < 1:
        raise ValueError(f"{n} rows don't make {folds} folds")
    return [(size * (i + 1), size * (i + 1), size * (i + 2)) for i in range(folds)]


def _folds(df: DataFrame, folds: list[tuple[int, int, int]], part: str) -> DataFrame:
    """Copies of one panel, a fold each. t is the dense number of the row."""
    out = None
    for i, (train, a, b) in enumerate(folds):
        some = df.where(F.col("t") < train) if part == "train" else df.where((F.col("t") >= a) & (F.col("t") < b))
        some = some.withColumn("panel", F.lit(f"fold{i}"))
        out = some if out is None else out.union(some)
    return out


def _dense(x: DataFrame, y: DataFrame) -> tuple[DataFrame, DataFrame, int]:
    times = sorted(r.t for r in x.select("t").union(y.select("t")).distinct().collect())
    at = x.sparkSession.createDataFrame(list(enumerate(times)), "d int, t int")
    number = lambda df: df.join(F.broadcast(at), "t").withColumn("t", F.col("d")).select(df.columns)
    return number(x), number(y), len(times)


def cross_validate(model: FactorModel, x: DataFrame, y: DataFrame, lams: list[float] | None = None, folds: int = 5, clusters: DataFrame | None = None) -> tuple[DataFrame, float, Fit]:
    """(lam, mean_score, folds), the best penalty by mean R2 (the first of equals), and the fit with it."""
    lams = GRID if lams is None else lams
    xd, yd, n = _dense(x, y)
    f = splits(n, folds)
    cl = None if clusters is None else _folds(clusters.withColumn("t", F.lit(-1)), f, "train").drop("t")
    done = fit(model, _folds(xd, f, "train"), _folds(yd, f, "train"), cl, lams=lams)
    scores = done.score(_folds(xd, f, "test"), _folds(yd, f, "test")).groupBy("lam").agg(F.avg("score").alias("mean_score"), F.count("score").alias("folds")).orderBy("lam")
    rows = [r for r in scores.collect() if r.mean_score is not None]
    if not rows:
        raise ValueError("no penalty could be scored")
    best = max(rows, key=lambda r: r.mean_score).lam
    return scores, best, fit(model.with_params(lam=best), x, y, clusters)


def diagonality(model: FactorModel, x: DataFrame, y: DataFrame, lams: list[float] | None = None, folds: int = 5, significance: float = 0.05, min_periods: int = 5, clusters: DataFrame | None = None) -> tuple[DataFrame, float, Fit]:
    """The largest penalty whose residuals out of sample look uncorrelated: mean statistic and mean top eigenvalue over the folds within their limits; else the least statistic."""
    lams = GRID if lams is None else lams
    xd, yd, n = _dense(x, y)
    f = splits(n, folds)
    cl = None if clusters is None else _folds(clusters.withColumn("t", F.lit(-1)), f, "train").drop("t")
    done = fit(model, _folds(xd, f, "train"), _folds(yd, f, "train"), cl, lams=lams)
    test = _folds(yd, f, "test")
    resid = done.predict(_folds(xd, f, "test")).join(test, ["panel", "t", "asset"]).select(F.concat_ws("|", "panel", "lam").alias("panel"), "t", "asset", (F.col("y") - F.col("y_hat")).alias("y"))
    d = diagnose(resid, min_periods=min_periods, significance=significance)
    d = d.withColumn("lam", F.element_at(F.split("panel", r"\|"), 2).cast("double"))
    table = d.groupBy("lam").agg(*(F.avg(c).alias(c) for c in ("statistic", "threshold", "top_eigenvalue", "edge"))).withColumn("passes", (F.col("statistic") <= F.col("threshold")) & (F.col("top_eigenvalue") <= F.col("edge"))).orderBy("lam")
    rows = [r for r in table.collect() if r.statistic is not None]
    if not rows:
        raise ValueError("no penalty could be judged")
    good = [r.lam for r in rows if r.passes]
    best = max(good) if good else min(rows, key=lambda r: r.statistic).lam
    return table, best, fit(model.with_params(lam=best), x, y, clusters)


def lambda_grid(x: DataFrame, y: DataFrame, n: int = 15, least: float = 1e-3) -> list[float]:
    """Falling geometrically from the penalty that leaves nothing. Panels without means."""
    j = y.join(x, ["panel", "t"]).groupBy("panel", "asset", "factor").agg(F.sum(F.col("x") * F.col("y")).alias("xy"))
    rows = y.select("t").distinct().count()
    top = 2 * j.agg(F.max(F.abs("xy"))).first()[0] / rows
    return (top * np.logspace(0, np.log10(least), n)).tolist()


__all__ = ["GRID", "splits", "cross_validate", "diagonality", "lambda_grid", "null_threshold"]
