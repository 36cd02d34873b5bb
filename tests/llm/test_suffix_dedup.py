import hashlib
import random
from collections import Counter

import numpy as np

from panelforge.llm import suffix_dedup as S
from panelforge.llm.suffix_dedup import LENGTH, repeated, substring_dedup


def brute(rows):
    raw = [(t or "").encode() for _, t in rows]
    seen = Counter(b[i : i + LENGTH] for b in raw for i in range(len(b) - LENGTH + 1))
    out = []
    for (d, _), b in zip(rows, raw, strict=True):
        gone = bytearray(len(b) + 1)
        for i in range(len(b) - LENGTH + 1):
            if seen[b[i : i + LENGTH]] > 1:
                gone[i : i + LENGTH] = b"\1" * LENGTH
        spans = sum(gone[i] and not gone[i + 1] for i in range(len(b)))
        out.append((d, len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone, strict=False) if not g)).hexdigest()))
    return sorted(out, key=str)


def result(spark, rows):
    df = substring_dedup(spark.createDataFrame([(d, t, 1, "x") for d, t in rows], "doc_id long, text string, k1 int, anchor string"))
    return sorted((tuple(r) for r in df.drop("removed").collect()), key=str)


def corpus(seed):
    rng = random.Random(seed)
    line = lambda n: "".join(rng.choice("abcé d") for _ in range(n))
    shared = [line(rng.randint(120, 420)) for _ in range(8)]
    rows = []
    for i in range(120):
        rows.append((i, "".join(rng.choice(shared) if rng.random() < 0.4 else line(rng.randint(1, 150)) for _ in range(rng.randint(0, 8)))))
    for i in range(120, 150):  # near copies of one text, cut at different places
        rows.append((i, shared[0][rng.randint(0, 30) :] + shared[1] + shared[2][: rng.randint(10, 260)]))
    return rows


def test_equals_brute_force(spark):
    rows = corpus(1)
    assert result(spark, rows) == brute(rows)


def test_special_cases(spark):
    long = "x" * 150 + "y" * 150
    rows = [(1, None), (2, ""), (3, "ab" * 300), (4, "z" * 1000), (5, long), (5, long), (None, long[1:]), (6, long[:199]), (7, "q" + long[60:260] + "r"), (8, "unique " + "".join(map(chr, range(200, 600))))]
    assert result(spark, rows) == brute(rows)


def test_one_passage_in_many_texts(spark):
    rng = random.Random(3)
    passage = "".join(rng.choice("abcdefgh ") for _ in range(330))
    rows = [(i, "".join(rng.choice("abcdefgh ") for _ in range(rng.randint(0, 90))) + passage + str(i) * 30) for i in range(400)]
    assert result(spark, rows) == brute(rows)


def test_empty_table(spark):
    assert result(spark, []) == []


def test_sort_finds_all_equal_windows():
    rng = np.random.default_rng(5)
    for alphabet in (2, 5):
        pool = rng.integers(97, 97 + alphabet, 3000).astype(np.uint8)
        for _ in range(30):
            a, b, n = *rng.integers(0, 2600, 2), rng.integers(40, 400)
            pool[b : b + n] = pool[a : a + n][: len(pool[b : b + n])].copy()
        starts = rng.choice(2900, 1500, replace=False)
        seen = Counter(pool[i : i + 57].tobytes() for i in starts)
        assert repeated(pool, starts, 57, 16).tolist() == [seen[pool[i : i + 57].tobytes()] > 1 for i in starts]


def test_anchors_of_many_sections_go_by_digests_of_windows(spark, monkeypatch):
    monkeypatch.setattr(S, "HEAVY", 3)
    rows = corpus(2)
    assert result(spark, rows) == brute(rows)


def test_sections_depend_on_their_text_alone():
    """Ties among the grams, and pieces of any size: the same anchors and digests."""
    rng = random.Random(4)
    texts = ["".join(rng.choice("ab") for _ in range(rng.randint(150, 900))).encode() for _ in range(30)] + [b"a" * 700, b"ab" * 300]

    def of(some):
        data = np.frombuffer(b"".join(some), np.uint8)
        offs = np.concatenate([[0], np.cumsum([len(x) for x in some])])
        start, n, anchor, digest = S.sections(data, offs)
        text = np.searchsorted(offs, start, "right") - 1
        return [(int(t), int(s - offs[t]), int(k), int(a), d) for t, s, k, a, d in zip(text, start, n, anchor, digest, strict=True)]

    alone = [(i, *x[1:]) for i, t in enumerate(texts) for x in of([t])]
    assert alone == of(texts)
    for h in (rng.choices(range(5), k=400), [1] * 400):
        h = np.array(h, np.uint64)
        assert S.leftmost_least(h, 153).tolist() == [i + int(np.argmin(h[i : i + 153])) for i in range(len(h) - 152)]
