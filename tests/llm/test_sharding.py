import random
import zlib
from itertools import accumulate

from pyspark.sql import functions as F

from panelforge.llm.sharding import KEY_BITS, _fits, cut_points, shard_documents


def least_capacity(sizes, shards):
    """By trying every contiguous partition, best first sums."""
    ends = [0, *accumulate(sizes)]
    best = {0: {0: 0}}
    for j in range(1, shards + 1):
        best[j] = {}
        for e in range(len(ends)):
            best[j][e] = min(max(best[j - 1][s], ends[e] - ends[s]) for s in best[j - 1] if s <= e)
    return best[shards][len(sizes)]


def test_capacity_is_the_least(spark):
    rng = random.Random(2)
    for n, shards in ((40, 4), (300, 8), (5, 8)):
        rows = sorted((rng.randrange(1 << KEY_BITS) if i % 3 else rng.randrange(1 << 30), rng.randint(1, 50) ** 2) for i in range(n))
        cuts, capacity = cut_points(spark.createDataFrame(rows, "key long, size long"), shards)
        assert capacity == least_capacity([s for _, s in rows], shards)
        loads = [sum(s for k, s in rows if sum(k >= c for c in cuts) == j) for j in range(shards)]
        assert max(loads) == capacity or max(loads) <= capacity
    assert _fits([3, 5], 3, 3, 2) and not _fits([3, 5], 3, 2, 2)


def check(rows, out):
    assert len(out) == len(rows)
    by_text, slots = {}, {}
    for r in out:
        slots.setdefault(r.shard, []).append(r.slot)
    for s in slots.values():
        assert sorted(s) == list(range(len(s)))
    texts = {(d, zlib.crc32((t or "").encode()), len((t or "").encode()) + 1) for d, t in rows}
    assert {(r.doc_id, r.text_crc32, r.size) for r in out} == texts
    for r in out:
        by_text.setdefault((r.text_crc32, r.size), set()).add(r.shard)
    return by_text


def test_groups_stay_together_and_slots_have_no_gaps(spark):
    rng = random.Random(1)
    rows = [(i, "hot text" if i % 3 == 0 else "t" * rng.randint(0, 60) + str(rng.randint(0, 150))) for i in range(600)]
    df = spark.createDataFrame([(d, t, 9) for d, t in rows], "doc_id long, text string, shard int")
    by_text = check(rows, shard_documents(df, 4, cell_rows=20).collect())
    assert all(len(s) == 1 for s in by_text.values())


def test_special_cases(spark):
    rows = [(1, None), (2, ""), (None, "a"), (3, "b" * 100_000), (3, "b" * 100_000), (4, "é")]
    check(rows, shard_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert shard_documents(spark.createDataFrame([], "doc_id long, text string")).agg(F.count("*")).first()[0] == 0
