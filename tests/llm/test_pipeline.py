import random

import corpus_pipeline
from panelforge.llm import decontaminate, mixing, near_dup, quality, token_files


def test_stages_and_their_order():
    assert [f for _, f in corpus_pipeline.STAGES] == [quality.stage, near_dup.stage, decontaminate.stage, mixing.stage, token_files.stage]


def test_every_decision_takes_effect(spark, tmp_path):
    rng = random.Random(1)
    vocabulary = ["".join(rng.choice("aeiou" if j % 2 else "bcdfgst") for j in range(rng.randint(2, 8))) for _ in range(500)]
    text = lambda n=120: " ".join(rng.choice(vocabulary) for _ in range(n))
    clean = {i: text() for i in range(80)}
    item = text(30)
    docs = list(clean.items()) + [(100, clean[3]), (101, clean[4] + " extra"), (102, "too short"), (103, text(60) + " " + item + " " + text(60)), (104, " ".join("".join(rng.choice("#%&@!|") for _ in range(6)) for _ in range(90)))]
    spark.createDataFrame([(d, t, "xx", f"s{d % 2}", len(t)) for d, t in docs], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    frames, now = [], spark.read.parquet(str(tmp_path / "documents.parquet"))
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, now, str(tmp_path)).write.parquet(str(tmp_path / f"out{i}"))
        now = spark.read.parquet(str(tmp_path / f"out{i}"))
        frames.append(now)
    ids = [sorted(r.doc_id for r in f.select("doc_id").collect()) for f in frames]
    assert ids[0] == sorted({d for d, _ in docs} - {102, 104})
    assert ids[1] == sorted(set(ids[0]) - {100, 101})
    assert ids[2] == sorted(set(ids[1]) - {103})
    assert set(ids[3]) <= set(ids[2]) and frames[3].columns == ["doc_id", "text", "lang", "source", "n_chars"]
    rows = sorted((r.start, r.doc_id, r.n_tokens) for r in frames[4].collect())
    assert [r[1] for r in rows] == ids[3] and rows[0][0] == 0
    assert all(a[0] + a[2] == b[0] for a, b in zip(rows, rows[1:], strict=False))
