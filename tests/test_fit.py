"""Fits over Spark against known numbers and closed forms."""

import numpy as np
import pandas as pd
import pytest

from panelforge.config import Model
from panelforge.operators.estimator import FactorModel, fit
from panelforge.sources.panels import from_pandas, strict


def toy(seed=7, t=240, n=6, m=3):
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((t, m))
    beta = rng.standard_normal((n, m)) * 0.5
    return x, x @ beta.T + 0.5 * rng.standard_normal((t, n)), beta


# Alpha and R2 that are known for this panel at a span of 36.
ALPHA = [0.0197832870, 0.0018608743, -0.0215583890, -0.0227264702, 0.0343118111, -0.0430948538]
R2 = [0.8949652205, 0.7820504852, 0.8984938714, 0.7147544367, 0.7209072291, 0.6502924471]


@pytest.fixture(scope="module")
def panels(spark):
    x, y, _ = toy()
    return from_pandas(spark, x, "factor", "x").persist(), from_pandas(spark, y, "asset", "y").persist()


def test_known_alpha_and_r2(panels):
    s = fit(FactorModel(Model.LASSO, 1e-6, span=36), *panels).stats.orderBy("asset").toPandas()
    assert np.allclose(s["alpha"], ALPHA, atol=1e-7) and np.allclose(s["r2"], R2, atol=1e-7)


def test_missing_values_young_series_and_least_squares(spark):
    x, y, _ = toy(3, 60, 3, 2)
    y[:30, 1] = np.nan
    y[:55, 2] = np.nan
    f = fit(FactorModel(Model.LASSO, 0.0), from_pandas(spark, x, "factor", "x"), from_pandas(spark, y, "asset", "y"))
    b = f.coef.toPandas().pivot(index="asset", columns="factor", values="beta").to_numpy()
    s = f.stats.orderBy("asset").toPandas()
    xd = (x - x.mean(0))[30:]
    yd = y[30:, 1] - y[30:, 1].mean()
    assert np.allclose(b[1], np.linalg.lstsq(xd, yd, rcond=None)[0], atol=1e-8)
    assert b[2].tolist() == [0, 0] and s["status"].tolist() == ["ok", "ok", "warm-up"] and pd.isna(s["r2"][2])
    assert np.isclose(s["alpha_const"][0], (y[:, 0] - x @ b[0]).mean())


def test_groups_signs_and_prior(spark):
    x, y, beta = toy(5, 80, 4, 2)
    xs, ys = from_pandas(spark, x, "factor", "x"), from_pandas(spark, y, "asset", "y")
    groups = spark.createDataFrame([("p", f"y{i}", str(i // 2)) for i in range(4)], "panel string, asset string, cluster string")
    given = spark.createDataFrame([("p", "y0", "x0", 0), ("p", "y1", "x1", int(-np.sign(beta[1, 1])))], "panel string, asset string, factor string, given int")
    b = fit(FactorModel(Model.GROUP, 1e-4), xs, ys, groups, signs=given).coef.toPandas().pivot(index="asset", columns="factor", values="beta").to_numpy()
    assert b[0, 0] == 0 and b[1, 1] * beta[1, 1] <= 0
    prior = spark.createDataFrame([("p", f"y{i}", f"x{j}", 0.7) for i in range(4) for j in range(2)], "panel string, asset string, factor string, prior double")
    b = fit(FactorModel(Model.GROUP, 1e4), xs, ys, groups, prior=prior).coef.toPandas()["beta"]
    assert np.allclose(b, 0.7)


def test_panels_must_share_their_times(spark):
    x, y, _ = toy(1, 10, 2, 2)
    with pytest.raises(ValueError):
        strict(from_pandas(spark, x, "factor", "x"), from_pandas(spark, y[:9], "asset", "y"))


def test_bad_parameters():
    for bad in ({"lam": -1.0}, {"l1_weight": 2.0}, {"span": 1}, {"linkage": "none"}, {"group_weight": "x"}):
        with pytest.raises(ValueError):
            FactorModel(**bad)
    assert FactorModel().with_params(lam=0.5).params()["lam"] == 0.5


def test_running_means_drop_the_first_time_of_each_panel(spark):
    from panelforge.operators.ewm import ewm_demean

    rows = [("p", "a", t, float(t * t)) for t in range(1, 6)] + [("q", "a", t, float(t)) for t in range(4, 9)]
    got = ewm_demean(spark.createDataFrame(rows, "panel string, asset string, t int, y double"), "asset", "y", 3).collect()
    assert sorted((r.panel, r.t) for r in got) == [("p", t) for t in range(2, 6)] + [("q", t) for t in range(5, 9)]
    state, want = {"p": 1.0, "q": 4.0}, {}
    for p, _, t, y in rows:
        state[p] += 0.5 * (y - state[p])
        want[p, t] = y - state[p]
    assert all(abs(r.y - want[r.panel, r.t]) < 1e-12 for r in got)
