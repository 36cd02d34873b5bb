"""The recursions over streams of rows (panel, asset, ts, y): an extension, since the batch operators read whole panels.

A recursion can't take a row that comes late, so rows older than the watermark are dropped; within a batch rows are put in order of time first.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..config import span_decay


def ewm_stream(rows: DataFrame, span: float, late: str = "1 hour") -> DataFrame:
    """(panel, asset, ts, ewm) as rows come; the state of a series is its last value and time."""
    lam = span_decay(span)

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        value, last = state.get if state.exists else (None, None)
        pdf = pd.concat(list(frames)).dropna(subset=["y"]).sort_values("ts")
        if last is not None:
            pdf = pdf[pdf["ts"] > pd.Timestamp(last)]
        out = []
        for r in pdf.itertuples():
            value = r.y if value is None else lam * value + (1 - lam) * r.y
            out.append((*key, r.ts, value))
        if out:
            state.update((value, out[-1][2].isoformat()))
        yield pd.DataFrame(out, columns=["panel", "asset", "ts", "ewm"])

    seen = rows.withWatermark("ts", late)
    return seen.groupBy("panel", "asset").applyInPandasWithState(step, "panel string, asset string, ts timestamp, ewm double", "value double, last string", "append", GroupStateTimeout.NoTimeout)


def moment_stream(x: DataFrame, y: DataFrame, window: str = "1 day", late: str = "1 day") -> DataFrame:
    """Sums for slopes of y on x per window of event time, from two streams joined on time: (panel, asset, factor, window, n, xy, xx, yy)."""
    a, b = x.withWatermark("ts", late), y.withWatermark("ts", late)
    j = a.select("panel", "ts", "factor", "x").join(b, ["panel", "ts"])
    return j.groupBy("panel", "asset", "factor", F.window("ts", window)).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("x") * F.col("y")).alias("xy"), F.sum(F.col("x") * F.col("x")).alias("xx"), F.sum(F.col("y") * F.col("y")).alias("yy"))
