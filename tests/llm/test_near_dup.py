import itertools
import random
import re

import pytest

from panelforge.llm.near_dup import near_duplicates

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text, k):
    w = WORD.findall((text or "").translate(LOW))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


def brute(rows, k, per_cent):
    sets = [(i, shingles(t, k)) for i, t in rows]
    root = {i: i for i, _ in rows}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    by = {}
    for i, s in sets:
        if s and i is not None:
            by.setdefault(frozenset(s), []).append(i)
    for ids in by.values():
        for i in ids[1:]:
            a, b = sorted((find(ids[0]), find(i)))
            root[b] = a
    for (s, x), (t, y) in itertools.combinations(by.items(), 2):
        n = len(s & t)
        if 100 * n >= per_cent * (len(s) + len(t) - n):
            a, b = sorted((find(x[0]), find(y[0])))
            root[b] = a
    return sorted(((i, len(s), find(i), find(i) == i) if i is not None else (None, len(s), None, True) for i, s in sets), key=str)


def result(spark, rows, k, per_cent):
    df = near_duplicates(spark.createDataFrame([(i, t, 5, 1) for i, t in rows], "doc_id long, text string, component long, n int"), k, per_cent)
    return sorted((tuple(r) for r in df.collect()), key=str)


def chain(seed, groups=6, members=25):
    """Groups of copies of a text with 0 to 12 words changed: many similar to none but a few of the others."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 7)))
    out = []
    for _ in range(groups):
        base = [word() for _ in range(rng.choice([4, 30, 110]))]
        for _ in range(members):
            w = list(base)
            for _ in range(rng.randint(0, 12)):
                w[rng.randrange(len(w))] = word()
            out.append(" ".join(w))
    rng.shuffle(out)
    return list(enumerate(out))


@pytest.mark.parametrize(("k", "per_cent"), [(3, 85), (5, 80)])
def test_equals_brute_force(spark, k, per_cent):
    rows = chain(k)
    assert result(spark, rows, k, per_cent) == brute(rows, k, per_cent)


def test_special_cases(spark):
    rows = [(1, None), (2, ""), (3, "  \n"), (4, "One"), (5, "one"), (6, "one two"), (None, "one two"), (7, "A b  c\td e"), (7, "A b  c\td e"), (8, "a B c d E"), (9, "word " * 40_000)]
    assert result(spark, rows, 3, 85) == brute(rows, 3, 85)


def test_one_hot_group(spark):
    rows = [(i, "the same text of eight words in all" + (" x%d" % i if i > 400 else "")) for i in range(500)]
    assert result(spark, rows, 3, 85) == brute(rows, 3, 85)


def test_empty_table(spark):
    assert result(spark, [], 3, 85) == []


def test_texts_that_polynomial_hashes_confuse(spark):
    a, b = "a", "b"
    for _ in range(11):
        a, b = a + b, b + a
    rows = [(1, a), (2, b), (3, f"x {a} y"), (4, f"x {b} y")]
    assert result(spark, rows, 3, 85) == brute(rows, 3, 85) == [(i, 1, i, True) for i in range(1, 5)]


def test_one_id_with_several_texts(spark):
    rows = [(i % 60, t) for i, t in chain(11, groups=3, members=40)]
    assert result(spark, rows, 3, 85) == brute(rows, 3, 85)


def test_few_pairs_miss_every_band():
    """Pairs of sets at the least similarity that must be found: the share without a common bucket is no more than (1 - s**ROWS)**BANDS."""
    import numpy as np

    from panelforge.llm import near_dup as N

    rng = np.random.default_rng(3)
    for common, own, most in ((170, 15, 1e-3), (160, 20, 1e-3)):  # 85 and 80 per cent
        missed = 0
        for _ in range(2000):
            x = rng.integers(0, 1 << 63, common + 2 * own, dtype=np.uint64) * np.uint64(2)
            a, b = np.sort(x[: common + own]), np.sort(x[own:])
            ka, kb = (N.band_keys(N.signature(s, N.BANDS * N.ROWS), N.BANDS, N.ROWS) for s in (a, b))
            missed += not (ka == kb).any()
        assert missed <= most * 2000
