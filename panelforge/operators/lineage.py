"""What becomes of clusters over time. Fingerprints and candidate links are relational; the matching of a panel is one unit of array code.

fingerprints: (panel, idx, label, members, beta, factor_var, idio_var, dominant), idx being the number of the date and beta an array in the order of the factors.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import covariance as V


def fingerprints(partitions: DataFrame, betas: DataFrame, sigma: DataFrame, specific: DataFrame, weighting: str = "equal") -> DataFrame:
    """From (panel, idx, asset, cluster), (.., asset, factor, beta), (.., f, g, cov), (.., asset, var). Members are the assets with betas; weights are equal or the inverse of an asset's total volatility (equal again in a cluster where none has any)."""
    key = ["panel", "idx"]
    p = partitions.join(betas.select(*key, "asset").distinct(), [*key, "asset"], "left_semi")
    p = p.join(specific.select(*key, "asset", "var"), [*key, "asset"], "left").withColumn("var", F.coalesce("var", F.lit(0.0)))
    one = F.lit(1.0)
    if weighting == "inverse_vol":
        dated = [df.withColumnRenamed("idx", "as_of") for df in (betas, sigma, specific)]
        vol = V.variances(*dated).select("panel", F.col("as_of").alias("idx"), "asset", "total_vol")
        p = p.join(vol, [*key, "asset"], "left")
        one = F.when(F.col("total_vol") > 0, 1 / F.nullif(F.col("total_vol"), F.lit(0.0))).otherwise(0.0)
    all_of = Window.partitionBy(*key, "cluster")
    p = p.withColumn("w", one)
    p = p.withColumn("w", F.when(F.sum("w").over(all_of) > 0, F.col("w") / F.nullif(F.sum("w").over(all_of), F.lit(0.0))).otherwise(1 / F.count(F.lit(1)).over(all_of)))
    own = p.groupBy(*key, "cluster").agg(F.sort_array(F.collect_list("asset")).alias("members"), F.sum(F.col("w") * F.col("w") * F.col("var")).alias("idio_var"))
    b = p.join(betas, [*key, "asset"]).groupBy(*key, "cluster", "factor").agg(F.sum(F.col("w") * F.coalesce("beta", F.lit(0.0))).alias("beta"))
    load = b.join(sigma.withColumnRenamed("g", "factor"), [*key, "factor"]).groupBy(*key, "cluster", "f").agg(F.sum(F.col("beta") * F.col("cov")).alias("load")).withColumnRenamed("f", "factor")
    part = b.join(load, [*key, "cluster", "factor"]).withColumn("c", F.col("beta") * F.col("load"))
    f = part.groupBy(*key, "cluster").agg(F.transform(F.sort_array(F.collect_list(F.struct("factor", "beta"))), lambda x: x["beta"]).alias("beta"), F.sum("c").alias("factor_var"), F.min(F.struct((-F.round("c", 12)).alias("c"), "factor")).alias("top"))
    out = own.join(f, [*key, "cluster"])
    return out.select(*key, F.col("cluster").alias("label"), "members", "beta", "factor_var", "idio_var", F.when(F.col("top.c") < 0, F.col("top.factor")).otherwise("Idio").alias("dominant"))


def overlap(a: Column, b: Column, common: Column, jaccard: bool = False) -> Column:
    """Of two member lists among assets that both dates have."""
    x, y = F.array_intersect(a, common), F.array_intersect(b, common)
    both = F.size(F.array_intersect(x, y))
    other = F.size(F.array_union(x, y)) if jaccard else F.least(F.size(x), F.size(y))
    return F.coalesce(both / F.nullif(other, F.lit(0)), F.lit(0.0))


def quadratic(d: Column, s: Column) -> Column:
    """d' S d of a vector and a matrix by rows, not below 0."""
    m = F.size(d)
    form = F.aggregate(F.sequence(F.lit(0), m * m - 1), F.lit(0.0), lambda acc, k: acc + F.get(d, F.floor(k / m).cast("int")) * F.get(d, (k % m).cast("int")) * F.get(s, k))
    return F.greatest(form, F.lit(0.0))


def _flat(sigma: DataFrame, name: str) -> DataFrame:
    return sigma.groupBy("panel", "idx").agg(F.transform(F.sort_array(F.collect_list(F.struct("f", "g", "cov"))), lambda x: x["cov"]).alias(name))


def links(fp: DataFrame, sigma: DataFrame, window: int = 1, band: tuple[float, float] = (0.3, 0.6), cut: float = 0.05, share: float = 0.5, blend: bool = False, jaccard: bool = False, decay: float = 0.5) -> DataFrame:
    """(panel, i, a, j, b, ov, spread, weight): clusters of two dates at most window + 1 apart that may be one. The gap is exploded, so the join is on equal dates."""
    here = fp.select("panel", F.col("idx").alias("i"), F.col("label").alias("a"), F.col("members").alias("ma"), F.col("beta").alias("ba"), F.explode(F.array(*(F.lit(g) for g in range(1, window + 2)))).alias("gap")).withColumn("j", F.col("i") + F.col("gap"))
    there = fp.select("panel", F.col("idx").alias("j"), F.col("label").alias("b"), F.col("members").alias("mb"), F.col("beta").alias("bb"))
    all_of = fp.groupBy("panel", "idx").agg(F.array_distinct(F.flatten(F.collect_list("members"))).alias("every"))
    at = all_of.join(_flat(sigma, "s"), ["panel", "idx"])
    j = here.join(there, ["panel", "j"]).join(at.select("panel", F.col("idx").alias("i"), F.col("every").alias("ea"), F.col("s").alias("sa")), ["panel", "i"]).join(at.select("panel", F.col("idx").alias("j"), F.col("every").alias("eb"), F.col("s").alias("sb")), ["panel", "j"])
    d = F.zip_with("ba", "bb", lambda x, y: y - x)
    mean = F.zip_with("sa", "sb", lambda x, y: (x + y) / 2)
    j = j.withColumn("d", d).withColumn("s", mean)
    j = j.withColumn("ov", overlap(F.col("ma"), F.col("mb"), F.array_intersect("ea", "eb"), jaccard)).withColumn("spread", F.sqrt(quadratic(F.col("d"), F.col("s"))))
    near = F.exp(-F.pow("spread", F.lit(2)) / (2 * cut * cut))
    mixed = share * F.col("ov") + (1 - share) * near
    if blend:
        weight = F.when(mixed >= 0.5, mixed)
    else:
        weight = F.when(F.col("ov") >= band[1], F.col("ov") + near).when((F.col("ov") >= band[0]) & (F.col("spread") <= cut), mixed)
    j = j.withColumn("weight", weight).where("weight is not null")
    return j.select("panel", "i", "a", "j", "b", "ov", "spread", (F.col("weight") * F.pow(F.lit(decay), F.col("gap") - 1)).alias("weight"))


def _assign(cost: np.ndarray) -> np.ndarray:
    """The column of each row in the cheapest assignment of all rows; n rows, at least n columns. One shortest augmenting path a row, with potentials."""
    n, m = cost.shape
    u, v = np.zeros(n), np.zeros(m)
    row_of = np.full(m, -1)
    for row in range(n):
        least, via, open_ = np.full(m, np.inf), np.full(m, -1), np.ones(m, bool)
        at, col = row, -1
        while at >= 0:
            reduced = cost[at] - u[at] - v
            better = open_ & (reduced < least)
            least[better], via[better] = reduced[better], col
            step = np.where(open_, least, np.inf)
            nxt = int(np.argmin(step))
            delta = step[nxt]
            reached = ~open_
            u[row_of[reached]] += delta
            v[reached] -= delta
            u[row] += delta
            least[open_] -= delta
            open_[nxt] = False
            col, at = nxt, int(row_of[nxt])
        while col >= 0:
            before = int(via[col])
            row_of[col] = row_of[before] if before >= 0 else row
            col = before
    out = np.empty(n, int)
    out[row_of[row_of >= 0]] = np.flatnonzero(row_of >= 0)
    return out


def match(n_left: int, n_right: int, edges: list[tuple[int, int, float]]) -> dict[int, int]:
    """Bipartite matching of greatest weight in which nobody has to be matched; among equals, earlier edges win. Parts that no edge connects are solved apart."""
    seen = set()
    for a, b, w in edges:
        if not (0 <= a < n_left and 0 <= b < n_right) or not np.isfinite(w) or w <= 0 or (a, b) in seen:
            raise ValueError(f"bad edge {(a, b, w)}")
        seen.add((a, b))
    if not edges:
        return {}
    top = max(w for _, _, w in edges)
    root = list(range(n_left + n_right))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for a, b, _ in edges:
        root[find(a)] = find(n_left + b)
    parts: dict[int, list] = {}
    for k, (a, b, w) in enumerate(edges):
        parts.setdefault(find(a), []).append((a, b, w / top - k * 1e-12))
    out = {}
    for part in parts.values():
        rows, cols = sorted({e[0] for e in part}), sorted({e[1] for e in part})
        at_r, at_c = {x: i for i, x in enumerate(rows)}, {x: i for i, x in enumerate(cols)}
        cost = np.full((len(rows), len(cols) + len(rows)), 1e3)
        cost[np.arange(len(rows)), len(cols) + np.arange(len(rows))] = 0.0  # a way out for each
        for a, b, w in part:
            if w > 0:
                cost[at_r[a], at_c[b]] = -w
        for i, j in enumerate(_assign(cost)):
            if j < len(cols) and cost[i, j] < 0:
                out[rows[i]] = cols[j]
    return dict(sorted(out.items()))


def _chains(nodes, edges, scale: int):
    """One matching over all dates: every cluster has at most one successor and one predecessor; chains are tracks."""
    number = {n: i for i, n in enumerate(nodes)}
    weighted = [(number[u], number[v], float(round(w * scale))) for u, v, w in edges if round(w * scale) > 0]
    after = {nodes[a]: nodes[b] for a, b in match(len(nodes), len(nodes), weighted).items()}
    before = {v: u for u, v in after.items()}
    track: dict = {}
    for n in sorted(nodes, key=lambda x: (x[0], str(x[1]))):
        track[n] = track[before[n]] if n in before else f"d{len(set(track.values())) + 1:03d}"
    best_in, best_out = {}, {}
    for u, v, w in edges:
        if v not in best_in or w > best_in[v][1]:
            best_in[v] = (u, w)
        if u not in best_out or w > best_out[u][1]:
            best_out[u] = (v, w)
    events = []
    for n in nodes:
        if n in before:
            events.append((track[before[n]], track[n], n[0], "continue" if n[0] - before[n][0] == 1 else "bridge"))
        elif n in best_in:
            events.append((track[best_in[n][0]], track[n], n[0], "split"))
        else:
            events.append((None, track[n], n[0], "birth"))
        if n not in after:
            if n in best_out:
                v = best_out[n][0]
                events.append((track[n], track[v], v[0], "merge"))
            else:
                events.append((track[n], None, n[0], "death"))
    return track, events


def _steps(nodes, edges, window: int):
    """Date by date: a matching of neighbours, then splits, tracks that come back within the window, births, merges, deaths."""
    dates = sorted({n[0] for n in nodes})
    weight = {(u, v): w for u, v, w in edges}
    track, events, asleep, count = {}, [], {}, 0

    def new():
        nonlocal count
        count += 1
        return f"d{count:03d}"

    for k, date in enumerate(dates):
        now = [n for n in nodes if n[0] == date]
        old = [n for n in nodes if k and n[0] == dates[k - 1]]
        near = [(old.index(u), now.index(v), w) for u, v, w in edges if u in old and v in now]
        got = {now[b]: old[a] for a, b in match(len(old), len(now), near).items()}
        used = set(got.values())
        for v, u in got.items():
            track[v] = track[u]
            events.append((track[u], track[u], date, "continue"))
        for v in now:
            if v in track:
                continue
            parents = sorted((u for u in old if (u, v) in weight), key=lambda u: -weight[u, v])
            back = max(((weight[u, v], t) for t, u in asleep.items() if (u, v) in weight and k - dates.index(u[0]) <= window + 1), default=None, key=lambda x: x[0])
            if parents and parents[0] not in used:
                track[v] = track[parents[0]]
                used.add(parents[0])
                events.append((track[v], track[v], date, "continue"))
            elif parents:
                track[v] = new()
                events.append((track[parents[0]], track[v], date, "split"))
            elif back:
                track[v] = back[1]
                del asleep[back[1]]
                events.append((track[v], track[v], date, "continue"))
            else:
                track[v] = new()
                events.append((None, track[v], date, "birth"))
        for u in old:
            if u in used:
                continue
            heirs = sorted((v for v in now if (u, v) in weight), key=lambda v: -weight[u, v])
            if heirs:
                events.append((track[u], track[heirs[0]], date, "merge"))
            else:
                asleep[track[u]] = u
                events.append((track[u], None, date, "death"))
    return track, events


EVENTS = "panel string, kind string, idx int, label string, track string, parent string, child string, event string"


def tracks(fp: DataFrame, candidate: DataFrame, method: str = "chains", window: int = 1, scale: int = 10_000) -> DataFrame:
    """Rows of kind 'label' (idx, label, track) and 'event' (idx, parent, child, event). candidate: see `links`."""
    nodes = fp.select("panel", "idx", "label")
    edges = candidate.select(F.col("panel").alias("p"), "i", "a", "j", "b", "weight")

    def run(n: pd.DataFrame, e: pd.DataFrame) -> pd.DataFrame:
        panel = n["panel"].iloc[0]
        points = sorted(((int(r.idx), r.label) for r in n.itertuples()), key=lambda x: (x[0], str(x[1])))
        lines = sorted((((int(r.i), r.a), (int(r.j), r.b), float(r.weight)) for r in e.itertuples()), key=lambda x: (x[0][0], x[1][0], str(x[0][1]), str(x[1][1])))
        track, events = _chains(points, lines, scale) if method == "chains" else _steps(points, lines, window)
        out = [(panel, "label", i, label, t, None, None, None) for (i, label), t in track.items()]
        out += [(panel, "event", i, None, None, p, c, k) for p, c, i, k in events]
        return pd.DataFrame(out, columns=[c.split()[0] for c in EVENTS.split(", ")])

    return nodes.groupBy("panel").cogroup(edges.groupBy("p")).applyInPandas(run, EVENTS)


@dataclass(frozen=True)
class Taxonomy:
    """Limits that name a track."""

    # fixed values
    equity: str = "Equity"
    high_beta: float = 0.70
    low_beta: float = 0.30
    mixed: float = 0.50
    stable: float = 0.015
    drifting: float = 0.030
    core: float = 0.70
    transient: float = 0.30
    vol_low: float = 0.05
    vol_high: float = 0.12


TRACK = ["panel", "track"]


def track_panel(tracked: DataFrame, fp: DataFrame) -> DataFrame:
    """(panel, track, idx, label, members, beta, factor_vol, idio_vol, total_vol, r2, size, dominant): the fingerprint of a track at each of its dates."""
    t = tracked.where("kind = 'label'").select("panel", "idx", "label", "track").join(fp, ["panel", "idx", "label"])
    total = F.col("factor_var") + F.col("idio_var")
    vol = lambda c: F.sqrt(F.greatest(c, F.lit(0.0)))
    return t.select(*TRACK, "idx", "label", "members", "beta", vol(F.col("factor_var")).alias("factor_vol"), vol(F.col("idio_var")).alias("idio_vol"), vol(total).alias("total_vol"), F.when(total > 0, F.col("factor_var") / F.nullif(total, F.lit(0.0))).otherwise(0.0).alias("r2"), F.size("members").alias("size"), "dominant")


def _mean_of(df: DataFrame, array: str, name: str) -> DataFrame:
    """Mean array of each track."""
    each = df.select(*TRACK, F.posexplode(array).alias("k", "v")).groupBy(*TRACK, "k").agg(F.avg("v").alias("v"))
    return each.groupBy(*TRACK).agg(F.transform(F.sort_array(F.collect_list(F.struct("k", "v"))), lambda x: x["v"]).alias(name))


def spreads(panel: DataFrame, sigma: DataFrame) -> DataFrame:
    """(panel, track, idx, spread): the distance of a date's beta from the track's mean, as a volatility under the mean factor covariance of the track's dates."""
    s = _mean_of(panel.select(*TRACK, "idx").join(_flat(sigma, "s"), ["panel", "idx"]), "s", "s")
    j = panel.select(*TRACK, "idx", "beta").join(_mean_of(panel, "beta", "mean").join(s, TRACK), TRACK)
    d = j.withColumn("d", F.zip_with("beta", "mean", lambda x, y: x - y))
    return d.select(*TRACK, "idx", F.sqrt(quadratic(F.col("d"), F.col("s"))).alias("spread"))


def beta_breaks(spread: DataFrame, taxonomy: Taxonomy = Taxonomy()) -> DataFrame:
    """(panel, track, idx, event, detail): dates at which a track is as far from its mean as a drifting one."""
    return spread.where(F.col("spread") >= taxonomy.drifting).select(*TRACK, "idx", F.lit("beta_break").alias("event"), F.format_string("spread_vol=%.3f", "spread").alias("detail"))


def classify(panel: DataFrame, spread: DataFrame, dates: DataFrame, factors: list[str], taxonomy: Taxonomy = Taxonomy()) -> DataFrame:
    """(panel, track, kind, stability, stability_label, coverage, lifetime, persistence, mean_factor_vol, vol_regime, vol_trend, modal, modal_share).

    panel: see `track_panel`; spread: see `spreads`; dates: (panel, idx) of all dates; factors in the order of beta. Of equally frequent dominant factors the earliest is modal.
    """
    x = taxonomy
    seen = panel.groupBy(*TRACK, "dominant").agg(F.count(F.lit(1)).alias("k"), F.min("idx").alias("first"))
    modal = seen.groupBy(*TRACK).agg(F.min(F.struct((-F.col("k")).alias("k"), "first", "dominant"))["dominant"].alias("modal"), (F.max("k") / F.sum("k")).alias("modal_share"))
    place = F.row_number().over(Window.partitionBy(*TRACK).orderBy("idx")) - 1
    equity = F.get("beta", factors.index(x.equity)) if x.equity in factors else F.lit(0.0)
    life = panel.withColumn("i", place).groupBy(*TRACK).agg(F.count(F.lit(1)).alias("lifetime"), F.avg("factor_vol").alias("mean_factor_vol"), F.when(F.count(F.lit(1)) >= 3, F.regr_slope("factor_vol", "i")).otherwise(0.0).alias("vol_trend"), F.avg(equity).alias("equity"))
    far = spread.groupBy(*TRACK).agg(F.median("spread").alias("stability"))
    all_dates = dates.groupBy("panel").agg(F.count_distinct("idx").alias("dates"))
    out = life.join(modal, TRACK).join(far, TRACK).join(all_dates, "panel").withColumn("coverage", F.col("lifetime") / F.col("dates"))
    three = lambda low, a, high, b, c: F.when(low, a).when(high, b).otherwise(c)
    bucket = three(F.col("equity") >= x.high_beta, "Equity-HighBeta", F.col("equity") <= x.low_beta, "Equity-Defensive", "Equity-Core")
    return out.select(
        *TRACK, F.when(F.col("modal_share") < x.mixed, "Mixed").when(F.col("modal") == x.equity, bucket).otherwise(F.col("modal")).alias("kind"),
        "stability", three(F.col("stability") <= x.stable, "Stable", F.col("stability") >= x.drifting, "Drifting", "Transitioning").alias("stability_label"),
        "coverage", "lifetime", three(F.col("coverage") >= x.core, "Core", F.col("coverage") < x.transient, "Transient", "Episodic").alias("persistence"),
        "mean_factor_vol", three(F.col("mean_factor_vol") < x.vol_low, "Low", F.col("mean_factor_vol") > x.vol_high, "High", "Mid").alias("vol_regime"),
        "vol_trend", "modal", "modal_share",
    )


def factor_labels(panel: DataFrame, sigma: DataFrame, factors: list[str], second: float = 0.35, taxonomy: Taxonomy = Taxonomy()) -> DataFrame:
    """(panel, track, label): the factor with most of a track's variance (and the next from a share on), what its mean beta says, and the level of its volatility. sigma: (panel, f, g, cov), one for all dates. Of equal shares the later factor goes first."""
    names = F.array(*(F.lit(f) for f in factors))
    b = panel.select(*TRACK, F.posexplode("beta").alias("k", "v")).groupBy(*TRACK, "k").agg(F.avg("v").alias("beta")).withColumn("factor", F.get(names, F.col("k")))
    load = b.join(sigma.withColumnRenamed("g", "factor"), ["panel", "factor"]).groupBy(*TRACK, "f").agg(F.sum(F.col("beta") * F.col("cov")).alias("load")).withColumnRenamed("f", "factor")
    c = b.join(load, [*TRACK, "factor"]).withColumn("c", F.greatest(F.col("beta") * F.col("load"), F.lit(0.0)))
    top = c.groupBy(*TRACK).agg(F.sum("c").alias("all"), F.sort_array(F.collect_list(F.struct("c", "k", "factor", "beta")), asc=False).alias("by"))
    j = top.join(panel.groupBy(*TRACK).agg(F.avg("factor_vol").alias("vol")), TRACK)
    first, beta = F.get("by", 0)["factor"], F.get("by", 0)["beta"]
    # fixed values
    said = F.when(first == "Equity", F.when(beta >= taxonomy.high_beta, " high-β").when(beta <= taxonomy.low_beta, " defensive").otherwise(" core"))
    said = said.when(first == "Rates", F.when(beta > 0, " long-duration").otherwise(" short-duration")).when(beta < 0, " short").otherwise("")
    level = F.when(F.col("vol") < taxonomy.vol_low, "low-vol").when(F.col("vol") > taxonomy.vol_high, "high-vol").otherwise("mid-vol")
    other = F.when(F.get("by", 1)["c"] >= second * F.col("all"), F.concat(F.lit(" + "), F.get("by", 1)["factor"])).otherwise("")
    return j.select(*TRACK, F.when(F.col("all") <= 0, "Idiosyncratic").otherwise(F.concat(first, said, other, F.lit(" · "), level)).alias("label"))


def label_panel(tracked: DataFrame, partitions: DataFrame) -> DataFrame:
    """(panel, idx, asset, track)."""
    t = tracked.where("kind = 'label'").select("panel", "idx", F.col("label").alias("cluster"), "track")
    return partitions.join(t, ["panel", "idx", "cluster"]).select("panel", "idx", "asset", "track")


def labels_at(labelled: DataFrame, idx: int, names: DataFrame | None = None) -> DataFrame:
    """(panel, asset, label) at a date, or at the last one before it; labelled: see `label_panel`, names: see `factor_labels`, tracks without."""
    last = labelled.where(F.col("idx") <= idx).groupBy("panel").agg(F.max("idx").alias("idx"))
    at = labelled.join(last, ["panel", "idx"])
    if names is None:
        return at.select("panel", "asset", F.col("track").alias("label"))
    return at.join(names, TRACK).select("panel", "asset", "label")


def analyze(partitions: DataFrame, betas: DataFrame, sigma: DataFrame, specific: DataFrame, factors: list[str], method: str = "chains", weighting: str = "equal", window: int = 1, taxonomy: Taxonomy = Taxonomy(), **affinity) -> dict[str, DataFrame]:
    """The whole report as tables: fingerprints, tracked, panel, classes, breaks, labels (of assets). Arguments as of `fingerprints`, `links` and `tracks`; factors in order of their names. Fingerprints and tracks (a row for each cluster and date) stay persisted until they are unpersisted; a lost one is computed again."""
    fp = fingerprints(partitions, betas, sigma, specific, weighting).persist()
    tracked = tracks(fp, links(fp, sigma, window, **affinity), method, window).persist()
    panel = track_panel(tracked, fp)
    far = spreads(panel, sigma)
    return {"fingerprints": fp, "tracked": tracked, "panel": panel, "classes": classify(panel, far, fp, factors, taxonomy), "breaks": beta_breaks(far, taxonomy), "labels": label_panel(tracked, partitions)}
