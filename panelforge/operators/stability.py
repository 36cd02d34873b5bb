"""How stable clusters are over time. partitions: (panel, as_of INT, asset, cluster), as_of being the number of the date."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..config import span_decay


def together(partitions: DataFrame) -> DataFrame:
    """(panel, as_of, asset, peer, same): for every two assets of a date whether they share a cluster."""
    a = partitions.where("cluster is not null").select("panel", "as_of", "asset", "cluster")
    b = a.select("panel", "as_of", F.col("asset").alias("peer"), F.col("cluster").alias("other"))
    return a.join(b, ["panel", "as_of"]).where("asset <> peer").select("panel", "as_of", "asset", "peer", (F.col("cluster") == F.col("other")).cast("double").alias("same"))


def _now(partitions: DataFrame) -> DataFrame:
    """Members of each date with their peers in the cluster."""
    a = partitions.where("cluster is not null").select("panel", "as_of", "asset", "cluster")
    b = a.select("panel", "as_of", "cluster", F.col("asset").alias("peer"))
    return a.join(b, ["panel", "as_of", "cluster"]).where("asset <> peer").select("panel", "as_of", "asset", "peer")


def _finish(partitions: DataFrame, w: DataFrame, min_history: int) -> DataFrame:
    """1 for who stands alone and for the first dates."""
    i = F.dense_rank().over(Window.partitionBy("panel").orderBy("as_of"))
    a = partitions.where("cluster is not null").select("panel", "as_of", "asset", i.alias("i"))
    out = a.join(w, ["panel", "as_of", "asset"], "left")
    return out.select("panel", "as_of", "asset", F.when(F.col("i") < min_history, 1.0).otherwise(F.coalesce("w", F.lit(1.0))).alias("w"))


def co_association(partitions: DataFrame, window: int = 6, min_history: int = 1) -> DataFrame:
    """(panel, as_of, asset, w): over the last `window` dates and the peers of now, how often they were together; dates and peers count alike."""
    now, past = _now(partitions), together(partitions)
    j = now.alias("n").join(past.alias("h"), (F.col("n.panel") == F.col("h.panel")) & (F.col("n.asset") == F.col("h.asset")) & (F.col("n.peer") == F.col("h.peer")) & (F.col("h.as_of") <= F.col("n.as_of")) & (F.col("h.as_of") > F.col("n.as_of") - window))
    return _finish(partitions, j.groupBy("n.panel", "n.as_of", "n.asset").agg(F.avg("same").alias("w")), min_history)


def ewma_co_association(partitions: DataFrame, span: float, adjust: bool = True, min_history: int = 1) -> DataFrame:
    """The same with the mean over peers first, then an exponentially weighted mean over the dates so far. adjust: with weights that sum to 1; else by the recursion that begins with the first date."""
    lam = span_decay(span)
    now, past = _now(partitions), together(partitions)
    j = now.alias("n").join(past.alias("h"), (F.col("n.panel") == F.col("h.panel")) & (F.col("n.asset") == F.col("h.asset")) & (F.col("n.peer") == F.col("h.peer")) & (F.col("h.as_of") <= F.col("n.as_of")))
    per = j.groupBy("n.panel", "n.as_of", "n.asset", F.col("h.as_of").alias("at")).agg(F.avg("same").alias("s"))
    age = F.pow(F.lit(lam), F.col("as_of") - F.col("at"))
    if adjust:
        w = per.groupBy("panel", "as_of", "asset").agg((F.sum(age * F.col("s")) / F.sum(age)).alias("w"))
    else:
        first = F.min("at").over(Window.partitionBy("panel", "as_of", "asset"))
        w = per.withColumn("k", age * F.when(F.col("at") == first, 1.0).otherwise(1 - lam)).groupBy("panel", "as_of", "asset").agg((F.sum(F.col("k") * F.col("s")) / F.sum("k")).alias("w"))
    return _finish(partitions, w, min_history)


def cluster_weights(partitions: DataFrame, w: DataFrame) -> DataFrame:
    return partitions.join(w, ["panel", "as_of", "asset"]).groupBy("panel", "as_of", "cluster").agg(F.avg("w").alias("w"), F.count(F.lit(1)).alias("size"))


def coverage(partitions: DataFrame, w: DataFrame) -> DataFrame:
    """Per date: assets, those in a cluster, those with a weight, clusters, shares."""
    j = partitions.join(w, ["panel", "as_of", "asset"], "left").groupBy("panel", "as_of").agg(F.count(F.lit(1)).alias("assets"), F.count("cluster").alias("clustered"), F.count("w").alias("weighted"), F.count_distinct("cluster").alias("clusters"))
    return j.withColumn("clustered_ratio", F.col("clustered") / F.col("assets")).withColumn("weighted_ratio", F.col("weighted") / F.nullif(F.col("clustered"), F.lit(0)))


def size_correlation(partitions: DataFrame, w: DataFrame) -> DataFrame:
    """Per date the correlation of cluster size and weight, from two clusters on."""
    g = cluster_weights(partitions, w).groupBy("panel", "as_of").agg(F.count(F.lit(1)).alias("clusters"), F.when(F.count(F.lit(1)) >= 2, F.nanvl(F.corr("size", "w"), F.lit(None))).alias("size_w_correlation"))
    return g.withColumn("above_half", F.coalesce(F.abs("size_w_correlation") > 0.5, F.lit(False)))


def dispersion(partitions: DataFrame, w: DataFrame, min_history: int = 1) -> DataFrame:
    i = F.dense_rank().over(Window.partitionBy("panel").orderBy("as_of"))
    j = partitions.withColumn("i", i).where(F.col("i") >= min_history).join(w, ["panel", "as_of", "asset"])
    return j.groupBy("panel", "as_of", "cluster").agg(F.count(F.lit(1)).alias("cluster_size"), F.nanvl(F.stddev_samp("w"), F.lit(None)).alias("w_asset_std"))


def boundary(partitions: DataFrame, w: DataFrame, membership: DataFrame) -> DataFrame:
    """How often the least and the most stable quarter change their derived cluster (panel, as_of, asset, derived), date to date."""
    before = F.lag("derived").over(Window.partitionBy("panel", "asset").orderBy("as_of"))
    last = F.lag("as_of").over(Window.partitionBy("panel", "asset").orderBy("as_of"))
    i = F.dense_rank().over(Window.partitionBy("panel").orderBy("as_of"))
    m = membership.withColumn("i", i)
    last = F.lag("i").over(Window.partitionBy("panel", "asset").orderBy("as_of"))
    m = m.withColumn("moved", F.coalesce((last == F.col("i") - 1) & (before != F.col("derived")), F.lit(False)).cast("double"))
    j = partitions.join(w, ["panel", "as_of", "asset"]).join(m.select("panel", "as_of", "asset", "moved"), ["panel", "as_of", "asset"], "left").withColumn("moved", F.coalesce("moved", F.lit(0.0)))
    some = F.max((F.col("w") < 1).cast("int")).over(Window.partitionBy("panel"))
    e = j.withColumn("some", some).where((F.col("some") == 0) | (F.col("w") < 1))
    cuts = e.groupBy("panel").agg(F.percentile("w", F.lit(0.25)).alias("bottom_cut"), F.percentile("w", F.lit(0.75)).alias("top_cut"))
    return e.join(cuts, "panel").groupBy("panel", "bottom_cut", "top_cut").agg(
        F.avg(F.when(F.col("moved") == 1, F.col("w"))).alias("mean_w_moved"), F.avg(F.when(F.col("moved") == 0, F.col("w"))).alias("mean_w_stable"),
        F.avg(F.when(F.col("w") <= F.col("bottom_cut"), F.col("moved"))).alias("bottom_rate"), F.avg(F.when(F.col("w") >= F.col("top_cut"), F.col("moved"))).alias("top_rate"),
    )


def frequency(months: list[int]) -> str:
    """ME or QE from the steps between dates, in months."""
    steps = set(np.diff(sorted(months)).tolist())
    if steps == {1}:
        return "ME"
    if steps == {3}:
        return "QE"
    raise ValueError("the dates are neither monthly nor quarterly")


def as_of(left: DataFrame, right: DataFrame, by: list[str], time: str, value: str) -> DataFrame:
    """left with the last value of right at or before its time. One sort of both sides by key and time; no join of ranges."""
    a = left.withColumn("_left", F.lit(1)).withColumn("_v", F.lit(None).cast(right.schema[value].dataType))
    rest = [c for c in left.columns if c not in (*by, time)]
    b = right.select(*by, time, *(F.lit(None).cast(left.schema[c].dataType).alias(c) for c in rest), F.lit(0).alias("_left"), F.col(value).alias("_v"))
    w = Window.partitionBy(*by).orderBy(time, "_left").rowsBetween(Window.unboundedPreceding, 0)
    both = a.unionByName(b).withColumn(value, F.last("_v", ignorenulls=True).over(w))
    return both.where("_left = 1").select(*left.columns, value)


def pooled_score(signal: DataFrame, partitions: DataFrame, w: DataFrame, min_cluster_size: int = 3, pool_by: str = "cluster") -> DataFrame:
    """(panel, ts, asset, score): signals less their cluster's mean, over a deviation between the cluster's and the whole cross-section's as the cluster (or the asset) is stable.

    Clusters of min_cluster_size or fewer use the cross-section; so does a date with fewer than two clusters. Before the first partition scores are 0.
    """
    dates = partitions.select("panel", "as_of").distinct().select("panel", F.col("as_of").alias("ts"), F.col("as_of").alias("cut"))
    at = as_of(signal.select("panel", "ts").distinct(), dates, ["panel"], "ts", "cut")
    s = signal.join(at, ["panel", "ts"]).join(partitions.select("panel", F.col("as_of").alias("cut"), "asset", "cluster"), ["panel", "cut", "asset"], "left")
    weight = w if pool_by == "asset" else partitions.join(w, ["panel", "as_of", "asset"]).select("panel", "as_of", "asset", F.avg("w").over(Window.partitionBy("panel", "as_of", "cluster")).alias("w"))
    s = s.join(weight.select("panel", F.col("as_of").alias("cut"), "asset", "w"), ["panel", "cut", "asset"], "left")
    day, own = Window.partitionBy("panel", "ts"), Window.partitionBy("panel", "ts", "cluster")
    v = F.col("raw")
    kinds = F.size(F.collect_set("cluster").over(day))
    g_n, g_mean, g_sd = F.count(v).over(day), F.avg(v).over(day), F.stddev_samp(v).over(day)
    c_n, c_mean, c_sd = F.count(v).over(own), F.avg(v).over(own), F.stddev_samp(v).over(own)
    members = F.count(F.lit(1)).over(own)
    s = s.select("*", kinds.alias("kinds"), g_n.alias("gn"), g_mean.alias("gm"), F.coalesce(g_sd, F.lit(0.0)).alias("gs"), c_n.alias("cn"), c_mean.alias("cm"), F.coalesce(c_sd, F.lit(0.0)).alias("cs"), members.alias("members"))
    whole = F.when((F.col("gn") < 2) | (F.col("gs") <= 0), 0.0).otherwise((v - F.col("gm")) / F.nullif(F.col("gs"), F.lit(0.0)))
    k = F.coalesce("w", F.lit(1.0))
    sd = F.sqrt(k * F.col("cs") * F.col("cs") + (1 - k) * F.col("gs") * F.col("gs"))
    pooled = F.when((F.col("cn") < 2) | (sd <= 0), 0.0).otherwise((v - F.col("cm")) / F.nullif(sd, F.lit(0.0)))
    score = F.when(F.col("cut").isNull(), 0.0).when(F.col("kinds") < 2, F.coalesce(whole, F.lit(0.0))).when(v.isNull() | F.col("cluster").isNull(), None).when(F.col("members") <= min_cluster_size, whole).otherwise(pooled)
    return s.select("panel", "ts", "asset", score.alias("score"))


def smooth_similarity(corr: np.ndarray, before: np.ndarray | None, decay: float) -> np.ndarray:
    """(1 - decay) * corr + decay * before, pairs that are new as they are."""
    if before is None:
        return corr
    out = np.where(np.isfinite(before), (1 - decay) * corr + decay * before, corr)
    np.fill_diagonal(out, 1.0)
    return out


def partition_bonus(distance: np.ndarray, before: list, delta: float) -> np.ndarray:
    """Distances less delta, not below 0, for who shared a cluster before."""
    b = np.array([None if x is None else x for x in before], dtype=object)
    same = (b[:, None] == b[None, :]) & np.array([x is not None for x in b])[:, None]
    out = np.where(same, np.maximum(distance - delta, 0.0), distance)
    np.fill_diagonal(out, 0.0)
    return out


def rolling_clusters(corrs: DataFrame, smoother: str = "none", fraction: float = 0.5, method: str = "ward", kind: str = "linear", n_clusters: int | None = None, delta: float = 0.1, decay: float = 0.5, anchors: DataFrame | None = None, remove_pc1: bool = False) -> DataFrame:
    """(panel, as_of, asset, cluster, cutoff) from the correlations of each date (panel, as_of, a, b, rho), in order of the dates.

    anchors: (panel, as_of) of the dates that cluster anew; between them the partition is held and who is new joins the cluster to which its mean correlation is highest. Every date is a pass over one matrix; panels are independent.
    """
    from . import cluster as C

    data = corrs.groupBy("panel", "as_of").agg(F.collect_list(F.struct("a", "b", "rho")).alias("pairs"))
    data = data.withColumn("anchor", F.lit(True)) if anchors is None else data.join(anchors.select("panel", "as_of", F.lit(True).alias("anchor")), ["panel", "as_of"], "left").withColumn("anchor", F.coalesce("anchor", F.lit(False)))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out, held, similar = [], None, {}
        for r in pdf.sort_values("as_of").itertuples():
            names = sorted({p["a"] for p in r.pairs} | {p["b"] for p in r.pairs})
            at = {n: i for i, n in enumerate(names)}
            corr = np.eye(len(names))
            for p in r.pairs:
                v = 0.0 if p["rho"] is None or np.isnan(p["rho"]) else p["rho"]
                corr[at[p["a"]], at[p["b"]]] = corr[at[p["b"]], at[p["a"]]] = v
            if remove_pc1 and len(names) > 1:
                corr, _ = C.remove_first_component(corr)
            if held is not None and not r.anchor:
                cutoff = held[1]
                labels = {n: held[0].get(n) for n in names}
                for n in [n for n in names if labels[n] is None]:
                    means = {c: np.mean([corr[at[n], at[m]] for m in names if held[0].get(m) == c]) for c in sorted({x for m, x in held[0].items() if m in at})}
                    labels[n] = max(means, key=means.get) if means else 1
            else:
                if smoother == "similarity_ewma":
                    before = np.array([[similar.get((a, b), np.nan) for b in names] for a in names]) if similar else None
                    corr = smooth_similarity(corr, before, decay)
                    similar = {(a, b): corr[at[a], at[b]] for a in names for b in names}
                if len(names) == 1:
                    found, cutoff = np.array([1]), 0.0
                else:
                    d = C.to_distance(corr, kind)
                    if smoother == "partition_bonus" and held is not None:
                        d = partition_bonus(d, [held[0].get(n) for n in names], delta)
                    found, _, cutoff = C.cluster_distance(d, fraction, method, n_clusters)
                labels = dict(zip(names, found.tolist(), strict=True))
            held = ({**labels}, cutoff)
            out += [(r.panel, r.as_of, n, str(labels[n]), cutoff) for n in names]
        return pd.DataFrame(out, columns=["panel", "as_of", "asset", "cluster", "cutoff"])

    return data.groupBy("panel").applyInPandas(run, "panel string, as_of int, asset string, cluster string, cutoff double")


#: Rows older than two of these, in units of the time in which a weight falls by e, have no weight any more.
EPOCH = 300.0
#: Variance below this share of the mean square is rounding of a series that doesn't move.
FLAT = 1e-13


def correlations_at(y: DataFrame, dates: DataFrame, span: float | None = None) -> DataFrame:
    """(panel, as_of, a, b, rho): what was known at each date of pairs that have common rows by then; null where a series did not move.

    Products of a pair are summed once, between one date and the next, and the sums run over the dates; with a span they decay. Rows later than the last date don't count. With a span, rows older than 300 to 600 times the time in which weights fall by e don't either.
    """
    from .dependence import pairs
    from .weights import demean

    dates = dates.select("panel", "as_of").distinct()
    # a mean of the whole series keeps the sums of squares small; with a span the products are those of the values given
    p = pairs(demean(y, "asset", "y") if span is None else y, "asset", "y")
    times = y.select("panel", "t").distinct()
    known = times.join(dates, "panel").where("t <= as_of").groupBy("panel", "t").agg(F.min("as_of").alias("as_of"))
    a, b = F.col("va"), F.col("vb")
    parts = {"ab": a * b, "aa": a * a, "bb": b * b} | ({"n": F.lit(1.0), "a1": a, "b1": b} if span is None else {})
    lam = 1.0 if span is None else span_decay(span)
    k = F.pow(F.lit(lam), F.col("as_of") - F.col("t"))
    sums = p.join(known, ["panel", "t"]).groupBy("panel", "a", "b", "as_of").agg(*(F.sum(e if span is None else k * e).alias(f"s_{n}") for n, e in parts.items()))
    grid = sums.groupBy("panel", "a", "b").agg(F.min("as_of").alias("_first")).join(dates, "panel").where("as_of >= _first").select("panel", "a", "b", "as_of")
    j = grid.join(sums, ["panel", "a", "b", "as_of"], "left")
    by, scale, own = ["panel", "a", "b"], F.lit(1.0), F.lit(True)
    if span is not None:
        # weights are taken from the end of an epoch, else those of a long panel would leave the range of a double; a date needs its epoch and the one before
        rate = -math.log(lam)
        j = j.withColumn("_now", F.floor(F.col("as_of") * rate / EPOCH)).withColumn("_epoch", F.explode(F.array("_now", F.col("_now") + 1)))
        scale = F.exp((F.col("as_of") * rate - (F.col("_epoch") + 1) * EPOCH))
        by, own = [*by, "_epoch"], F.col("_epoch") == F.col("_now")
    w = Window.partitionBy(*by).orderBy("as_of").rowsBetween(Window.unboundedPreceding, 0)
    run = j.select("panel", "as_of", "a", "b", own.alias("_own"), *(F.sum(F.coalesce(f"s_{n}", F.lit(0.0)) * scale).over(w).alias(f"r_{n}") for n in parts)).where("_own")
    ab, aa, bb = (F.col(f"r_{n}") for n in ("ab", "aa", "bb"))
    if span is None:
        n, a1, b1 = (F.col(f"r_{x}") for x in ("n", "a1", "b1"))
        va, vb = aa - a1 * a1 / n, bb - b1 * b1 / n
        rho = F.when((va > FLAT * aa) & (vb > FLAT * bb), (ab - a1 * b1 / n) / (F.sqrt(va) * F.sqrt(vb)))
    else:
        rho = F.when((aa > 0) & (bb > 0), ab / (F.sqrt(aa) * F.sqrt(bb)))
    return run.select("panel", "as_of", "a", "b", rho.alias("rho"))


def last_before(freq_months: int) -> Column:
    """The number of the period that a month is in; the last date of each is an anchor."""
    return F.floor(F.col("as_of") / freq_months)


def anchors(dates: DataFrame, freq_months: int) -> DataFrame:
    return dates.groupBy("panel", last_before(freq_months).alias("p")).agg(F.max("as_of").alias("as_of")).select("panel", "as_of")
