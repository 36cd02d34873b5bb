"""Snapshots, tracks and their report against DuckDB, and edge cases of the report."""

from pathlib import Path

import pytest

from panelforge.operators import ewm as E
from panelforge.operators import lineage as L
from panelforge.plans import queries as Q

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["as_of_lookup", "ewm_covariance_series", "cluster_fingerprints", "cluster_fingerprints_inverse_vol", "lineage_links", "track_panel", "track_breaks", "track_classes", "track_labels", "track_members_at", "covariance_snapshot", "latest_betas"])
def test_same_rows_as_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    if not Path(SF).exists():
        pytest.skip("no tables here")
    d = duckdb.connect()
    for f in Path(SF).glob("*.parquet"):
        d.sql(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    got = Q.QUERIES[name](spark, SF)
    cols = sorted(got.columns)
    want = d.sql(f"SELECT {', '.join(cols)} FROM ({Q.SQL[name]})").fetchall()
    rows = [tuple(r) for r in got.select(*cols).collect()]
    key = lambda r: tuple((v is None, str(v)) for v in r)
    assert sorted(rows, key=key) == sorted(want, key=key)


def _panel(spark, rows):
    return spark.createDataFrame(rows, "panel string, track string, idx int, beta array<double>, factor_vol double, dominant string")


def test_classes_of_a_short_track_and_of_equal_modes(spark):
    panel = _panel(spark, [("p", "d1", 0, [0.8, 0.0], 0.2, "Equity"), ("p", "d1", 1, [0.6, 0.0], 0.2, "Rates"), ("p", "d2", 3, [0.0, 1.0], 0.01, "Idio")])
    sigma = spark.createDataFrame([("p", i, f, g, 0.04 if f == g else 0.0) for i in range(4) for f in ("Equity", "Rates") for g in ("Equity", "Rates")], "panel string, idx int, f string, g string, cov double")
    far = L.spreads(panel, sigma)
    assert {(r.track, r.idx): round(r.spread, 9) for r in far.collect()} == {("d1", 0): 0.02, ("d1", 1): 0.02, ("d2", 3): 0.0}
    dates = spark.createDataFrame([("p", i) for i in range(4)], "panel string, idx int")
    got = {r.track: r for r in L.classify(panel, far, dates, ["Equity", "Rates"]).collect()}
    assert (got["d1"].modal, got["d1"].kind, got["d1"].stability_label, got["d1"].persistence, got["d1"].vol_regime, got["d1"].vol_trend) == ("Equity", "Equity-HighBeta", "Transitioning", "Episodic", "High", 0.0)
    assert (got["d2"].kind, got["d2"].stability_label, got["d2"].persistence, got["d2"].vol_regime) == ("Idio", "Stable", "Transient", "Low")
    assert L.beta_breaks(far).count() == 0
    one = sigma.where("idx = 0").select("panel", "f", "g", "cov")
    assert {r.track: r.label for r in L.factor_labels(panel, one, ["Equity", "Rates"]).collect()} == {"d1": "Equity high-β · high-vol", "d2": "Rates long-duration · low-vol"}


def test_no_tracks_no_classes(spark):
    panel = _panel(spark, [])
    far = spark.createDataFrame([], "panel string, track string, idx int, spread double")
    dates = spark.createDataFrame([], "panel string, idx int")
    assert L.classify(panel, far, dates, ["Equity"]).count() == 0 and L.beta_breaks(far).count() == 0


def test_labels_at_a_date_between_and_before(spark):
    labelled = spark.createDataFrame([("p", 1, "a", "d1"), ("p", 4, "a", "d2")], "panel string, idx int, asset string, track string")
    assert [r.label for r in L.labels_at(labelled, 3).collect()] == ["d1"]
    assert L.labels_at(labelled, 0).count() == 0


def test_covariance_series_over_a_null_leg(spark):
    rows = [("p", t, k, v) for t, pair in enumerate([(1.0, 2.0), (None, 1.0), (3.0, 1.0)]) for k, v in zip("ab", pair)]
    got = E.ewm_covariance_series(spark.createDataFrame(rows, "panel string, t int, k string, v double"), "k", "v", decay=0.5)
    assert [round(r.cov, 9) for r in got.where("a = 'a' and b = 'b'").orderBy("t").collect()] == [1.0, 1.0, 2.0]
