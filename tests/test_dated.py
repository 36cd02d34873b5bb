"""Weights by age and correlations at dates against plain loops."""

import math

import numpy as np
import pytest

from panelforge.operators import dependence, stability
from panelforge.operators.weights import solver_weights


def rows(seed: int, times: list[int], names: str = "abc") -> list[tuple]:
    rng = np.random.default_rng(seed)
    out = [("p", t, n, None if rng.random() < 0.2 else float(rng.standard_normal() + 3)) for t in times for n in names]
    return out + [("p", t, "still", 0.3) for t in times] + [("q", t, n, 1.0 * (i + t)) for t in times[-2:] for i, n in enumerate("ab")]


def plain(data, dates, span):
    lam, out = 1 - 2 / (span + 1) if span else 1.0, {}
    for p in "pq":
        at = {}
        for _, t, n, v in (r for r in data if r[0] == p):
            if v is not None:
                at.setdefault(n, {})[t] = v
        for d in (d for q, d in dates if q == p):
            for a in at:
                for b in (b for b in at if a < b):
                    both = sorted(t for t in at[a] if t in at[b] and t <= d)
                    if not both:
                        continue
                    x, y = np.array([at[a][t] for t in both]), np.array([at[b][t] for t in both])
                    if span:
                        w = lam ** (np.array(both[-1]) - np.array(both, float))
                        out[p, d, a, b] = float((w * x * y).sum() / np.sqrt((w * x * x).sum() * (w * y * y).sum()))
                    else:
                        out[p, d, a, b] = float(np.corrcoef(x, y)[0, 1]) if len(both) > 1 and np.ptp(x) > 0 and np.ptp(y) > 0 else None
    return out


@pytest.mark.parametrize("span", [None, 5, 40])
@pytest.mark.parametrize("times", [list(range(1, 25)), [3, 4, 9, 40, 41, 400, 402, 700, 1500, 1501, 4000, 4001, 4003]])
def test_correlations_at_dates(spark, span, times):
    data = rows(len(times), times)
    dates = [("p", t) for t in (times[0] - 1, times[1], times[4], times[4] + 1, times[-2])] + [("q", times[-1])]
    y = spark.createDataFrame(data, "panel string, t int, asset string, y double")
    got = {(r.panel, r.as_of, r.a, r.b): r.rho for r in stability.correlations_at(y, spark.createDataFrame(dates + dates[:1], "panel string, as_of int"), span).collect()}
    want = plain(data, dates, span)
    # pairs without a row for 300 time constants are gone with a span
    assert set(got) == set(want) if span is None else set(got) <= set(want) and {d for _, d, _, _ in got} == {d for _, d, _, _ in want}
    for k, v in got.items():
        assert (v is None and want[k] is None) or math.isclose(v, want[k], abs_tol=1e-9), (k, v, want[k])


def test_ages_are_numbers_of_times(spark):
    y = spark.createDataFrame([("p", t, n, v) for t, n, v in ((1, "a", 1.0), (1, "b", 2.0), (5, "a", None), (9, "b", 1.0))] + [("q", 2, "a", 1.0)], "panel string, t int, asset string, y double")
    got = {(r.panel, r.t, r.asset): r.w2 for r in solver_weights(y, 3).collect()}
    assert got == {("p", 1, "a"): 0.25, ("p", 1, "b"): 0.25, ("p", 5, "a"): 0.0, ("p", 9, "b"): 1.0, ("q", 2, "a"): 1.0}
    with pytest.raises(ValueError):
        solver_weights(y, 1)
    plan = solver_weights(y, 3)._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" in plan and "Aggregate [panel" in plan.split("Window", 1)[1]  # only distinct times reach the window


def test_no_rows(spark):
    y = spark.createDataFrame([], "panel string, t int, asset string, y double")
    dates = spark.createDataFrame([("p", 1)], "panel string, as_of int")
    for span in (None, 5):
        assert stability.correlations_at(y, dates, span).collect() == []
    assert dependence.gerber(y, span=5).collect() == [] and solver_weights(y, 5).collect() == []
