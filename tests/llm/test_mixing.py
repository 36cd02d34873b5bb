import random
import re

from pyspark.sql import functions as F

from panelforge.llm.mixing import mix, stage

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def targets(sizes):
    """Share by weight, and what a source can't take again, until all fit."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    out, open_, left = {}, set(order), float(sum(sizes.values()))
    while open_:
        per = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if per * weight[s] > 3 * sizes[s]}
        if not full:
            return out | {s: per * weight[s] for s in open_}
        for s in full:
            out[s] = 3.0 * sizes[s]
            left -= out[s]
        open_ -= full
    return out


def corpus(seed, sources=7, docs=700):
    rng = random.Random(seed)
    return [(i, " ".join("w" * rng.randint(1, 5) for _ in range(min(4000, int(rng.lognormvariate(4, 1))))), None if i % 50 == 7 else f"s{int(rng.random() ** 2 * sources)}") for i in range(docs)]


def test_sources_meet_their_targets(spark):
    rows = corpus(1)
    out = mix(spark.createDataFrame([(*r, 4) for r in rows], "doc_id long, text string, source string, size int")).collect()
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len(WORD.findall(t))
    want, taken = targets(sizes), {}
    for r in out:
        assert 0 <= r.taken <= 3 * r.size and r.taken == r.copies * r.size
        assert abs(r.target - want[r.source]) < 1e-6 * want[r.source] and r.source_size == sizes[r.source]
        taken[r.source] = taken.get(r.source, 0) + r.taken
    for s, w in want.items():
        assert abs(taken[s] - w) <= 0.01 * w, (s, taken[s], w)


def test_rates_tilt_one_way_with_size_and_reruns_agree(spark):
    df = spark.createDataFrame(corpus(2), "doc_id long, text string, source string")
    a, b = (sorted((r.doc_id, r.source or "", r.size, r.rate, r.copies) for r in mix(df.repartition(n)).collect()) for n in (3, 5))
    assert a == b
    for s in {r[1] for r in a}:
        rates = [x[3] for x in sorted((r for r in a if r[1] == s), key=lambda r: r[2])]
        assert rates == sorted(rates) or rates == sorted(rates, reverse=True)


def test_special_cases(spark):
    rows = [(1, None, "a"), (2, "", "a"), (3, " \n", "b"), (4, "one two three", None), (4, "one two three", None), (None, "x " * 30_000, "c"), (5, "y", "c")]
    out = mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    assert len(out) == len(rows) and sum(r.taken for r in out if r.source in ("a", "b")) == 0
    assert {r.target for r in out if r.source == "a"} == {0.0} and {r.target for r in out if r.source is None} == {18.0}
    assert mix(spark.createDataFrame([], "doc_id long, text string, source string")).collect() == []


def test_stage_repeats_documents(spark):
    rows = corpus(3, 4, 120)
    df = spark.createDataFrame([(*r, "en") for r in rows], "doc_id long, text string, source string, lang string")
    copies = {r.doc_id: r.copies for r in mix(df).collect()}
    got = stage(spark, df, "").groupBy("doc_id").count().collect()
    assert {r["doc_id"]: r["count"] for r in got} == {d: c for d, c in copies.items() if c}


def test_repeated_rows_of_any_sizes(spark):
    """Equal rows whose copies differ: a step moves one copy, and the mix is no further off than one document's size."""
    rng = random.Random(8)
    for trial, other in enumerate((100, 160, 190, 220, None, None)):
        rows = [(1, "w " * 3, "a")] * 20 + [(2, "w " * 40, "a"), (3, "w " * (other or 1), "b")]
        if other is None:
            rows = [(rng.randint(0, 5), "w " * rng.choice([1, 3, 3, 3, 17, 40]), rng.choice("abc")) for _ in range(150 * trial)]
        out = mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
        assert len(out) == len(rows) and all(0 <= r.copies <= 3 and r.taken == r.copies * r.size for r in out)
        want = targets({s: sum(r.size for r in out if r.source == s) for s in {r.source for r in out}})
        for s, w in want.items():
            sizes = [r.size for r in out if r.source == s]
            assert abs(sum(r.taken for r in out if r.source == s) - w) <= max(0.01 * w, min(sizes)), (trial, s, w)


def test_stage_takes_what_the_mix_says(spark):
    rng = random.Random(12)
    rows = [(rng.randint(0, 3), "w " * rng.choice([1, 3, 3, 17]), rng.choice("ab"), 0, 0, 0) for _ in range(200)]
    rows += [(None, None, None, 1, 1, 1)] * 3
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, copies int, row int, _hash int").withColumn("row_", F.lit("x"))
    got = stage(spark, df, "")
    assert got.columns == df.columns
    taken, want = (sorted(((r[0], r[1], r[2]), r[3]) for r in x) for x in (
        [(str(r.doc_id), r.text, str(r.source), 1) for r in got.collect()],
        [(str(r.doc_id), "w " * r.size, str(r.source), 1) for r in mix(df).collect() for _ in range(r.copies) if r.size],
    ))
    assert [x for x in taken if x[0][1]] == want
