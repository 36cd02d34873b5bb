"""Sparse factor models of many responses.

Rows are only touched by aggregates: every response's weighted moments (M x M numbers) come from one groupBy with partial sums. A unit of work, a response or the responses of a cluster, then goes to a solver in array code, over all penalties of a path in one call. What a fit reports (alpha, R2, ...) follows from the same moments.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import Dependence, Distance, Model, span_decay
from . import cluster as C
from . import signs as S
from . import solvers
from .dependence import dependence
from .ewm import ewm_demean
from .weights import demean, solver_weights

LEAST_ROWS = 5
COEF = "panel string, asset string, lam double, betas array<double>, rests boolean"


@dataclass(frozen=True)
class FactorModel:
    """What to fit. See `fit`."""

    model: Model = Model.LASSO
    lam: float = 1e-3
    span: float | None = None
    demean: bool = True
    nonneg: bool = False
    l1_weight: float = 0.0
    group_weight: str = "balanced"  # sqrt(size / groups), or "size": sqrt(size)
    dependence: Dependence = Dependence.PEARSON
    cutoff_fraction: float = 0.5
    n_clusters: int | None = None
    linkage: str = "ward"
    distance: Distance = Distance.LINEAR
    remove_pc1: bool = False
    auto_signs: bool = False
    tau: float = 0.75
    mask: str = "fit_compat"
    adaptive_gamma: float | None = None
    adaptive_floor: float = 0.5
    warmup: int | None = 12
    loo: bool = True
    uni_nonneg: bool = True

    def __post_init__(self):
        if self.lam < 0:
            raise ValueError("lam must not be negative")
        if not 0 <= self.l1_weight <= 1:
            raise ValueError("l1_weight must be in [0, 1]")
        if self.span is not None and span_decay(self.span) == 0:
            raise ValueError("a span of 1 has no decay to fit with")
        if self.group_weight not in ("balanced", "size"):
            raise ValueError("group_weight must be balanced or size")
        if self.linkage not in C.LINKAGES:
            raise ValueError(f"unknown linkage {self.linkage!r}")
        if self.nonneg and self.auto_signs:
            import warnings

            warnings.warn("signs stand before nonneg", stacklevel=3)

    def params(self) -> dict:
        return {f: getattr(self, f) for f in self.__dataclass_fields__}

    def with_params(self, **changes) -> FactorModel:
        """A copy; its parameters are checked like those of a new one."""
        return replace(self, **changes)


@dataclass
class Fit:
    """Tables of a fit. coef: panel, lam, asset, factor, beta; stats: panel, lam, asset, alpha, ss_total, ss_res, r2, alpha_const, status; clusters: panel, asset, cluster; merges: panel, step, left, right, height, size; cutoffs: panel, cutoff; signs: panel, asset, factor, sign."""

    model: FactorModel
    coef: DataFrame
    stats: DataFrame
    clusters: DataFrame | None = None
    merges: DataFrame | None = None
    cutoffs: DataFrame | None = None
    signs: DataFrame | None = None
    factors: list[str] = field(default_factory=list)
    held: list[DataFrame] = field(default_factory=list, repr=False)

    def release(self) -> None:
        """Drop what the fit keeps in memory; its tables are computed anew if read again."""
        for df in self.held:
            df.unpersist()

    def predict(self, x: DataFrame) -> DataFrame:
        """panel, lam, t, asset, y_hat."""
        p = x.join(self.coef, ["panel", "factor"]).groupBy("panel", "lam", "t", "asset").agg(F.sum(F.coalesce("x", F.lit(0.0)) * F.col("beta")).alias("y_hat"))
        if not self.model.demean:
            return p
        a = self.stats.select("panel", "lam", "asset", F.coalesce("alpha_const", F.lit(0.0)).alias("a"))
        return p.join(a, ["panel", "lam", "asset"]).withColumn("y_hat", F.col("y_hat") + F.col("a")).drop("a")

    def score(self, x: DataFrame, y: DataFrame) -> DataFrame:
        """panel, lam, score: mean over the responses of 1 - SSR / SST."""
        j = self.predict(x).join(y.where("y is not null"), ["panel", "t", "asset"]).groupBy("panel", "lam", "asset")
        r = j.agg(F.sum(F.pow(F.col("y") - F.col("y_hat"), F.lit(2))).alias("ssr"), (F.var_pop("y") * F.count("y")).alias("sst"))
        return r.groupBy("panel", "lam").agg(F.avg(1 - F.col("ssr") / F.nullif(F.col("sst"), F.lit(0.0))).alias("score"))

    def summary(self) -> DataFrame:
        n = self.coef.groupBy("panel", "lam").agg(F.count_if(F.abs("beta") > 1e-8).alias("nonzero"), F.count("beta").alias("cells"))
        return n.join(self.stats.groupBy("panel", "lam").agg(F.avg("r2").alias("mean_r2"), F.count(F.lit(1)).alias("assets")), ["panel", "lam"])


def wide(x: DataFrame, factors: list[str]) -> DataFrame:
    """(panel, t, x0, x1, ...): one row a time."""
    return x.groupBy("panel", "t").agg(*(F.max(F.when(F.col("factor") == f, F.col("x"))).alias(f"x{i}") for i, f in enumerate(factors)))


def moments(x: DataFrame, y: DataFrame, factors: list[str]) -> DataFrame:
    """(panel, asset, rows, n, g, c, yy, sw, sy, sx): sums with weights w2 of y. g is the upper triangle by rows. x is one row a time and small beside y, so Spark broadcasts it where its size allows."""
    m = len(factors)
    j = y.join(wide(x, factors), ["panel", "t"])
    xs = [F.coalesce(F.col(f"x{i}"), F.lit(0.0)) for i in range(m)]
    none = F.lit(True)
    for i in range(m):
        none = none & F.col(f"x{i}").isNull()
    j = j.withColumn("w2", F.when(none | F.col("y").isNull(), 0.0).otherwise(F.col("w2"))).withColumn("y", F.coalesce("y", F.lit(0.0)))
    w, v = F.col("w2"), F.col("y")
    total = lambda e: F.sum(e)
    out = j.groupBy("panel", "asset").agg(
        F.count_if(w > 0).alias("n"),
        F.array(*(total(w * xs[i] * xs[k]) for i in range(m) for k in range(i, m))).alias("g"),
        F.array(*(total(w * xs[i] * v) for i in range(m))).alias("c"),
        total(w * v * v).alias("yy"),
        total(w).alias("sw"),
        total(w * v).alias("sy"),
        F.array(*(total(w * xs[i]) for i in range(m))).alias("sx"),
    )
    rows = y.groupBy("panel").agg(F.count_distinct("t").alias("rows"))
    return out.join(rows, "panel")


def _square(packed, m: int) -> np.ndarray:
    g = np.zeros((m, m))
    g[np.triu_indices(m)] = packed
    return g + np.triu(g, 1).T


def group_arrays(model: FactorModel, y: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(clusters, merges, cutoffs) of the demeaned responses of each panel."""
    names = y.groupBy("panel").agg(F.sort_array(F.collect_set("asset")).alias("names"))
    rho = dependence(y, model.dependence, span=model.span).groupBy("panel").agg(F.collect_list(F.struct("a", "b", "rho")).alias("pairs"))
    schema = "panel string, names array<string>, labels array<int>, merges array<array<double>>, cutoff double"

    def run(frames):
        for pdf in frames:
            rows = []
            for r in pdf.itertuples():
                at = {n: i for i, n in enumerate(r.names)}
                corr = np.eye(len(at))
                for p in r.pairs if r.pairs is not None else ():
                    v = p["rho"]
                    corr[at[p["a"]], at[p["b"]]] = corr[at[p["b"]], at[p["a"]]] = 0.0 if v is None or np.isnan(v) else v
                if model.remove_pc1 and len(corr) > 1:
                    corr, _ = C.remove_first_component(corr)
                labels, merges, at_height = C.clusters(corr, model.cutoff_fraction, model.linkage, str(model.distance), model.n_clusters)
                rows.append((r.panel, list(r.names), labels.tolist(), merges.tolist(), at_height))
            yield pd.DataFrame(rows, columns=["panel", "names", "labels", "merges", "cutoff"])

    out = names.join(rho, "panel", "left").mapInPandas(run, schema).persist()
    labels = out.select("panel", F.explode(F.arrays_zip("names", "labels")).alias("z")).select("panel", F.col("z.names").alias("asset"), F.col("z.labels").cast("string").alias("cluster"))
    merges = out.select("panel", F.posexplode("merges").alias("step", "m")).select("panel", "step", *(F.get("m", i).alias(n) for i, n in enumerate(("left", "right", "height", "size"))))
    return labels, merges, out.select("panel", "cutoff")


def fit(model: FactorModel, x: DataFrame, y: DataFrame, clusters: DataFrame | None = None, signs: DataFrame | None = None, prior: DataFrame | None = None, lams: list[float] | None = None) -> Fit:
    """Fit every panel. clusters: (panel, asset, cluster), needed by GROUP and used instead of own ones by the others; signs: (panel, asset, factor, given), null for free; prior: (panel, asset, factor, prior); lams: a path of penalties instead of one."""
    lams = [model.lam] if lams is None else list(lams)
    if not lams or min(lams) < 0:
        raise ValueError("penalties must be given and not negative")
    # the panels are read by every step below; they go with Fit.release()
    raw_x, raw_y = x.select("panel", "t", "factor", "x").persist(), y.select("panel", "t", "asset", "y").persist()
    held = [raw_x, raw_y]
    factors = sorted(r.factor for r in raw_x.select("factor").distinct().collect())
    m = len(factors)
    kind = model.model
    if not model.demean:
        xd, yd = raw_x, raw_y
    elif model.span is None:
        xd, yd = demean(raw_x, "factor", "x"), demean(raw_y, "asset", "y")
    else:
        xd, yd = ewm_demean(raw_x, "factor", "x", model.span), ewm_demean(raw_y, "asset", "y", model.span)
    if model.demean:
        xd, yd = xd.persist(), yd.persist()
        held += [xd, yd]
    merges = cutoffs = None
    if kind in (Model.HCGL, Model.FCGL, Model.COOPERATIVE) and clusters is None:
        clusters, merges, cutoffs = group_arrays(model, yd)
    if kind == Model.GROUP and clusters is None:
        raise ValueError("groups are needed")
    if kind in (Model.LASSO, Model.UNILASSO):
        clusters = None
    derived = None
    if model.auto_signs or model.adaptive_gamma is not None:
        tests = S.slope_tests(xd, yd, clusters, model.tau, model.mask)
        derived = tests.select("panel", "asset", "factor", "slope", "sign") if clusters is None else S.to_assets(tests, clusters)
        if signs is not None:
            derived = S.override(derived, signs)
    weighted = solver_weights(yd, model.span)
    if kind == Model.UNILASSO:
        coef = _fit_unilasso(model, xd, yd, factors, lams)
        mom = moments(xd, weighted, factors)
    else:
        mom = moments(xd, weighted, factors).persist()
        held.append(mom)
        unit = F.col("asset") if clusters is None else F.col("cluster")
        data = mom if clusters is None else mom.join(clusters, ["panel", "asset"])
        data = data.withColumn("unit", unit)
        if clusters is not None:
            size = clusters.groupBy("panel", "cluster").agg(F.count(F.lit(1)).alias("size"))
            groups = size.groupBy("panel").agg(F.count(F.lit(1)).alias("groups"))
            data = data.join(size, ["panel", "cluster"]).join(groups, "panel")
        else:
            data = data.withColumn("size", F.lit(1)).withColumn("groups", F.lit(1))
        cells = data.select("panel", "asset", F.explode(F.array(*map(F.lit, factors))).alias("factor"))
        given = derived.select("panel", "asset", "factor", F.col("sign").cast("double").alias("sign"), "slope") if derived is not None and model.auto_signs else None
        if given is None and signs is not None:
            given = signs.select("panel", "asset", "factor", F.col("given").cast("double").alias("sign"), F.lit(None).cast("double").alias("slope"))
        if given is None:
            given = cells.select("*", F.lit(None).cast("double").alias("sign"), F.lit(None).cast("double").alias("slope"))
        cells = cells.join(given, ["panel", "asset", "factor"], "left")
        if model.adaptive_gamma is not None:
            slopes = derived.select("panel", "asset", "factor", F.col("slope").alias("s"), F.col("sign").alias("g"))
            w = S.cell_weight(F.col("s"), F.col("g"), model.adaptive_gamma, model.adaptive_floor)
            cells = cells.join(slopes.select("panel", "asset", "factor", "g", w.alias("w")), ["panel", "asset", "factor"], "left")
        else:
            cells = cells.withColumn("w", F.lit(1.0)).withColumn("g", F.lit(1))
        if prior is not None:
            cells = cells.join(prior, ["panel", "asset", "factor"], "left")
        else:
            cells = cells.withColumn("prior", F.lit(0.0))
        packed = cells.groupBy("panel", "asset").agg(F.sort_array(F.collect_list(F.struct("factor", F.coalesce("sign", F.lit(float("nan"))).alias("sign"), F.coalesce("w", F.lit(1.0)).alias("w"), F.coalesce("g", F.lit(1)).alias("g"), F.coalesce("prior", F.lit(0.0)).alias("prior")))).alias("cells"))
        data = data.join(packed, ["panel", "asset"])
        solve = _solver(model, m, lams, given_signs=derived is not None and model.auto_signs or signs is not None)
        data = data.select("panel", "unit", "asset", "rows", "g", "c", "size", "groups", "cells")
        # responses of a lasso are apart from each other: a batch of rows is solved as it comes, without a shuffle
        coef = data.mapInPandas(lambda frames: map(solve, frames), COEF) if kind == Model.LASSO else data.groupBy("panel", "unit").applyInPandas(solve, COEF)
    coef = coef.persist()
    held.append(coef)
    counts = raw_y.groupBy("panel", "asset").agg(F.count("y").alias("n_valid"))
    coef = coef.join(counts, ["panel", "asset"])
    if model.warmup is not None:
        young = F.col("n_valid") < model.warmup
        coef = coef.withColumn("betas", F.when(young, F.array_repeat(F.lit(0.0), m)).otherwise(F.col("betas"))).withColumn("young", young)
        if clusters is not None:
            clusters = clusters.join(counts.where(F.col("n_valid") >= model.warmup), ["panel", "asset"], "left_semi")
    else:
        coef = coef.withColumn("young", F.lit(False))
    stats = _statistics(coef, mom, m)
    stats = stats.join(_alpha_const(coef, raw_x, solver_weights(raw_y, model.span), factors), ["panel", "lam", "asset"], "left").join(coef.select("panel", "lam", "asset", "young", "rests"), ["panel", "lam", "asset"])
    for c in ("alpha", "ss_total", "ss_res", "r2", "alpha_const"):
        stats = stats.withColumn(c, F.when(~F.col("young"), F.col(c)))
    stats = stats.withColumn("status", F.when(F.col("young"), "warm-up").when(F.col("alpha").isNull(), "too few rows").when(~F.col("rests"), "not converged").otherwise("ok")).drop("young", "rests")
    long = coef.select("panel", "lam", "asset", F.posexplode("betas").alias("i", "beta")).select("panel", "lam", "asset", F.element_at(F.array(*map(F.lit, factors)), F.col("i") + 1).alias("factor"), "beta")
    return Fit(model, long, stats, clusters, merges, cutoffs, derived, factors, held)


def _solver(model: FactorModel, m: int, lams: list[float], given_signs: bool):
    """Responses to their coefficients at every penalty, from large to small with warm starts: the rows of one cluster, or for a lasso any rows."""
    kind = model.model
    names = ["panel", "asset", "lam", "betas", "rests"]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        few = pdf["rows"] < LEAST_ROWS
        none = [(p, a, x, [None] * m, True) for x in lams for p, a in zip(pdf["panel"][few], pdf["asset"][few], strict=True)]
        pdf = pdf[~few].sort_values(["panel", "asset"])
        if pdf.empty:
            return pd.DataFrame(none, columns=names)
        k, rows = len(pdf), pdf["rows"].to_numpy(float)
        gs = np.stack([_square(g, m) for g in pdf["g"]]) / rows[:, None, None]
        cs = np.stack([np.asarray(c, float) for c in pdf["c"]]) / rows[:, None]
        cell = [[(c["sign"], c["w"], c["g"], c["prior"]) for c in cs_] for cs_ in pdf["cells"]]
        sign, w, gate, prior = (np.array([[c[i] for c in row] for row in cell], float) for i in range(4))
        plain = kind == Model.COOPERATIVE
        lo, hi = solvers.bounds(sign if given_signs and not plain else None, model.nonneg and not plain, (k, m))
        size, groups = float(pdf["size"].iloc[0]), float(pdf["groups"].iloc[0])
        weight = np.sqrt(size / groups) if model.group_weight == "balanced" else np.sqrt(size)
        adaptive = model.adaptive_gamma is not None
        rms = lambda ax: np.sqrt(np.divide((w * w * (gate != 0)).sum(ax), (gate != 0).sum(ax), out=np.ones(w.shape[1 - ax]), where=(gate != 0).sum(ax) > 0))
        out, start = [], None
        for lam in sorted(lams, reverse=True):
            if kind == Model.LASSO:
                b, rests = solvers.lasso_many(gs, cs, lam, lo, hi, prior, w if adaptive else None, start)
            else:
                mode = {Model.FCGL: "block", Model.COOPERATIVE: "cooperative"}.get(kind, "row")
                b, rest = solvers.group_lasso(gs, cs, lam, weight, lo, hi, prior, model.l1_weight, mode, rms(1) if adaptive and mode == "row" else None, rms(0) if adaptive and mode == "block" else None, w if adaptive else None, start)
                rests = np.full(k, rest)
            start = b
            out += zip(pdf["panel"], pdf["asset"], [lam] * k, b.tolist(), rests.tolist(), strict=True)
        return pd.DataFrame(none + out, columns=names)

    return run


def _fit_unilasso(model: FactorModel, xd: DataFrame, yd: DataFrame, factors: list[str], lams: list[float]) -> DataFrame:
    m = len(factors)
    j = yd.join(wide(xd, factors), ["panel", "t"])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        x, y = pdf[[f"x{i}" for i in range(m)]].to_numpy(float), pdf["y"].to_numpy(float)
        y = np.where(np.isfinite(x).any(1), y, np.nan)
        p, a = pdf["panel"].iloc[0], pdf["asset"].iloc[0]
        none = [None] * m
        return pd.DataFrame([(p, a, lam, none if len(pdf) < LEAST_ROWS else solvers.unilasso(x, y, lam, model.loo, model.uni_nonneg).tolist(), True) for lam in lams], columns=["panel", "asset", "lam", "betas", "rests"])

    return j.groupBy("panel", "asset").applyInPandas(run, COEF)


def _statistics(coef: DataFrame, mom: DataFrame, m: int) -> DataFrame:
    """Weighted mean of the residuals, sums of squares and R2 from the moments."""
    j = coef.join(mom, ["panel", "asset"])
    b = [F.get("betas", i) for i in range(m)]
    at = {}
    for i in range(m):
        for k in range(i, m):
            at[i, k] = len(at)
    quad = sum((b[i] * b[k] * F.get("g", at[i, k]) * (1 if i == k else 2) for i, k in at), F.lit(0.0))
    cross = sum((b[i] * F.get("c", i) for i in range(m)), F.lit(0.0))
    mean = sum((b[i] * F.get("sx", i) for i in range(m)), F.lit(0.0))
    sw = F.nullif(F.col("sw"), F.lit(0.0))
    ybar = F.col("sy") / sw
    j = j.select("panel", "lam", "asset", ((F.col("sy") - mean) / sw).alias("alpha"), (F.col("yy") / sw - ybar * ybar).alias("ss_total"), ((F.col("yy") - 2 * cross + quad) / sw).alias("ss_res"))
    return j.withColumn("r2", 1 - F.when(F.col("ss_total") > 0, F.col("ss_res") / F.col("ss_total")).otherwise(F.when(F.col("ss_res").isNotNull(), 0.0)))


def _alpha_const(coef: DataFrame, x: DataFrame, y: DataFrame, factors: list[str]) -> DataFrame:
    """Weighted mean of y less that of x times beta, over rows with a value, of the panels as they were given."""
    m = len(factors)
    mom = moments(x, y, factors).select("panel", "asset", "sw", "sy", "sx")
    mean = sum((F.coalesce(F.get("betas", i), F.lit(0.0)) * F.get("sx", i) for i in range(m)), F.lit(0.0))
    return coef.join(mom, ["panel", "asset"]).select("panel", "lam", "asset", ((F.col("sy") - mean) / F.nullif(F.col("sw"), F.lit(0.0))).alias("alpha_const"))
