"""The registry, with and without the corpus operators."""

import subprocess
import sys
from pathlib import Path

import pytest

import __spark_entry__ as entry

SMALL = "/root/testdata/sf0.001"
REPO = Path(__file__).resolve().parents[1]


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_flagship(spark):
    if not Path(SMALL).exists():
        pytest.skip("no tables here")
    df = entry.entry(spark)
    assert df.columns == ["asset", "factor", "n", "slope", "t_stat", "sign"] and df.count() > 0


def test_registry_stands_without_the_corpus_part(tmp_path):
    for p in ("__spark_entry__.py", "panelforge"):
        target = tmp_path / p
        if (REPO / p).is_dir():
            import shutil

            shutil.copytree(REPO / p, target, ignore=shutil.ignore_patterns("llm", "__pycache__"))
        else:
            target.write_text((REPO / p).read_text())
    said = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), any(n.startswith('op') for n in e.queries()))"], cwd=tmp_path, capture_output=True, text=True, env={"PATH": "/usr/bin:/bin"})
    assert said.stdout.split()[1] == "False", said.stderr


def test_rolling_clusters_take_every_date_of_the_table(spark):
    from panelforge.plans import queries as P

    sf = "/root/testdata/sf0.001"
    want = {r.t for r in P.panels(spark, sf)[1].select("t").distinct().collect()}
    for q in (P.rolling_clusters, P.rolling_clusters_smoothed):
        got = {r.as_of for r in q(spark, sf).select("as_of").distinct().collect()}
        assert got == want, (q.__name__, sorted(want - got), len(got), len(want))
