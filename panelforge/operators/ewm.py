"""Exponentially weighted recursions. A recursion over one series runs in array code, many series to a task; without gaps the last state is a weighted sum and needs no recursion."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import Gap, Init, span_decay, valid_decay


def initial(values: np.ndarray, init: Init) -> float:
    """State before the first row; a missing first value, mean or variance gives 0."""
    there = values[np.isfinite(values)]
    if init == Init.ZERO or not len(values):
        return 0.0
    if init == Init.FIRST:
        return float(values[0]) if np.isfinite(values[0]) else 0.0
    if not len(there):
        return 0.0
    return float(there.mean()) if init == Init.MEAN else float(((there - there.mean()) ** 2).mean())


def ewm(values: np.ndarray, decay: float, init: float = 0.0, gap: Gap = Gap.FFILL, from_first: bool = False) -> np.ndarray:
    """state = decay * state + (1 - decay) * value, the first row being the initial state.

    A missing value holds the state (FFILL), lets it decay (DEFLATED), makes it 0 (ZERO, NAN) or gives a null and holds it (NULL). from_first: rows before the first value are null, and the state begins with that value.
    """
    values = np.where(np.isfinite(values), values, np.nan)
    out, state, begun = np.empty(len(values)), init, not from_first
    for i, v in enumerate(values):
        missing = np.isnan(v)
        if not begun:
            if missing:
                out[i] = np.nan
                continue
            state, begun = v, True
        elif i == 0:
            state = init
        elif not missing:
            state = decay * state + (1 - decay) * v
        elif gap == Gap.DEFLATED:
            state = decay * state
        elif gap in (Gap.ZERO, Gap.NAN):
            state = 0.0
        out[i] = np.nan if gap == Gap.NULL and missing else state
    return out


def _decay(span: float | None, decay: float) -> float:
    return span_decay(span) if span is not None else valid_decay(decay)


def ewm_mean(df: DataFrame, key: str, value: str, span: float | None = None, decay: float = 0.94, init: Init = Init.FIRST, gap: Gap = Gap.FFILL, name: str = "ewm") -> DataFrame:
    """panel, key, t, value, name: every series through its recursion."""
    lam = _decay(span, decay)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("t")
        v = pdf[value].to_numpy(float)
        pdf[name] = ewm(v, lam, initial(v, init), gap)
        return pdf

    cols = df.select("panel", key, "t", F.col(value).cast("double").alias(value))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in cols.schema) + f", `{name}` double"
    return cols.groupBy("panel", key).applyInPandas(run, schema)


def ewm_last(df: DataFrame, key: str, value: str, span: float) -> DataFrame:
    """Last state of series without gaps, in closed form: decay**(T-1) of the first value and (1 - decay) * decay**age of the others."""
    lam = span_decay(span)
    j = df.join(df.groupBy("panel", key).agg(F.min("t").alias("t0"), F.max("t").alias("t1")), ["panel", key])
    w = F.pow(F.lit(lam), F.col("t1") - F.col("t")) * F.when(F.col("t") == F.col("t0"), 1.0).otherwise(1 - lam)
    return j.groupBy("panel", key).agg(F.sum(w * F.col(value)).alias("ewm"))


def ewm_demean(df: DataFrame, key: str, value: str, span: float) -> DataFrame:
    """Less the running mean; the first time of each panel goes."""
    m = ewm_mean(df, key, value, span, name="_m").join(df.groupBy("panel").agg(F.min("t").alias("_first")), "panel")
    return m.withColumn(value, F.col(value) - F.col("_m")).where(F.col("t") > F.col("_first")).drop("_m", "_first")


def ewm_covariance_series(df: DataFrame, key: str, value: str, span: float | None = None, decay: float = 0.94, gap: Gap = Gap.FFILL) -> DataFrame:
    """panel, a, b (a <= b), t, cov: the recursion on products of two series, from 0 before the first; one unit for each pair. A null leg follows the gap rule; a missing row is no step."""
    lam = _decay(span, decay)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("t")
        pdf["cov"] = ewm(np.concatenate([[0.0], pdf["cov"].to_numpy(float)]), lam, 0.0, gap)[1:]
        return pdf

    one = df.select("panel", "t", F.col(key).alias("a"), F.col(value).cast("double").alias("u"))
    two = df.select("panel", "t", F.col(key).alias("b"), F.col(value).cast("double").alias("v"))
    both = one.join(two, ["panel", "t"]).where("a <= b").select("panel", "a", "b", "t", (F.col("u") * F.col("v")).alias("cov"))
    kinds = dict(both.dtypes)
    return both.groupBy("panel", "a", "b").applyInPandas(run, ", ".join(f"{c} {kinds[c]}" for c in both.columns))


def ewm_covariance(a: np.ndarray, decay: float, gap: Gap = Gap.FFILL, start: np.ndarray | None = None, is_corr: bool = False) -> np.ndarray:
    """T x N x N states of the recursion on products of a T x N array; a pair with a missing leg follows the gap rule."""
    a = np.where(np.isfinite(a), a, np.nan)
    n = a.shape[1]
    state = np.zeros((n, n)) if start is None else start.astype(float).copy()
    out = np.empty((len(a), n, n))
    for i, row in enumerate(a):
        p = np.outer(row, row)
        there = np.isfinite(p)
        new = decay * state + (1 - decay) * np.where(there, p, 0.0)
        held = {Gap.FFILL: state, Gap.DEFLATED: decay * state, Gap.NULL: state}.get(gap, np.zeros((n, n)))
        state = np.where(there, new, held)
        out[i] = normalise(state) if is_corr else state
    return out


def normalise(cov: np.ndarray) -> np.ndarray:
    v = np.diag(cov)
    if v.sum() <= 1e-10:
        return np.eye(len(v))
    ok = v > 1e-12
    s = np.where(ok, 1 / np.sqrt(np.where(ok, v, 1)), 0.0)
    out = cov * np.outer(s, s)
    np.fill_diagonal(out, 1.0)
    return out
