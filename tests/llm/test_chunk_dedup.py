import random
from collections import defaultdict

import numpy as np

from panelforge.llm.chunk_dedup import LEAST, MOST, RUN, chunks, dedup


def split(text):
    b = np.frombuffer(text.encode(), np.uint8)
    s, e = chunks(b, np.array([0, len(b)]))
    return list(zip(s.tolist(), e.tolist(), strict=True))


def brute(rows):
    """rows with distinct (doc_id, text)."""
    first, where, cut = {}, defaultdict(set), {}
    for d, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        cut[d, t] = [(a, b, (t or "").encode()[a:b]) for a, b in split(t or "")]
        for a, _, c in cut[d, t]:
            first.setdefault(c, (d, a))
            where[c].add((d, a))
    out = []
    for (d, t), cs in cut.items():
        copied, gone, run = 0, 0, []
        for x in [*cs, None]:
            if x and len(where[x[2]]) > 1 and (not run or run[-1][1] == x[0]):
                run.append(x)
                continue
            if run and run[-1][1] - run[0][0] >= RUN:
                copied += run[-1][1] - run[0][0]
                gone += sum(b - a for a, b, c in run if first[c] != (d, a))
            run = [x] if x and len(where[x[2]]) > 1 else []
        out.append((d, len((t or "").encode()), copied, gone, copied > 0))
    return sorted(out, key=str)


def result(spark, rows):
    return sorted((tuple(r)[:5] for r in dedup(spark.createDataFrame([(d, t, 3) for d, t in rows], "doc_id long, text string, key int")).collect()), key=str)


def word(rng):
    return "".join(rng.choice("abcdefghijklmnopé") for _ in range(rng.randint(1, 9)))


def test_equals_brute_force_and_finds_shared_passages(spark):
    rng = random.Random(4)
    shared = [" ".join(word(rng) for _ in range(60)) for _ in range(5)]
    rows = [(i, " ".join([word(rng) for _ in range(rng.randint(0, 40))] + ([rng.choice(shared)] if i % 3 == 0 else []) + [word(rng) for _ in range(rng.randint(0, 40))])) for i in range(120)]
    got = result(spark, rows)
    assert got == brute(rows)
    assert {r[0] for r in got if r[4]} == set(range(0, 120, 3))


def test_cuts_resist_insertions_and_keep_their_bounds():
    rng = random.Random(5)
    text = " ".join(word(rng) for _ in range(2000))
    there = {text.encode()[a:b] for a, b in split(text)}
    moved = text[:300] + "inserted" + text[300:]
    kept = [(a, b) for a, b in split(moved) if moved.encode()[a:b] in there]
    assert sum(b - a for a, b in kept) > len(moved.encode()) - 4 * MOST
    sizes = [b - a for a, b in split(text)][:-1]
    assert min(sizes) >= LEAST and max(sizes) <= MOST and 30 < sum(sizes) / len(sizes) < 70


def test_special_cases(spark):
    rng = random.Random(6)
    t = " ".join(word(rng) for _ in range(200))
    rows = [(1, None), (2, ""), (3, "short"), (None, t), (7, t), (8, "z" * 2000)]
    assert result(spark, rows) == brute(rows)
    n = len(t.encode())
    assert result(spark, [(5, t), (5, t)]) == [(5, n, 0, 0, False)] * 2  # one text of one id
    assert result(spark, []) == []


def test_passages_of_51_words_are_found(spark):
    """Against the places where they were set in: all are found, and most of their bytes."""
    rng = random.Random(7)
    rows, size = [], []
    for i in range(400):
        passage = " ".join(word(rng) for _ in range(51))
        for j in (0, 1):
            rows.append((2 * i + j, " ".join([*(word(rng) for _ in range(rng.randint(5, 30))), passage, *(word(rng) for _ in range(rng.randint(5, 30)))])))
            size.append(len(passage.encode()))
    rows += [(10_000 + i, " ".join(word(rng) for _ in range(100))) for i in range(100)]
    got = {r[0]: r for r in result(spark, rows)}
    found = [got[i][2] / n for i, n in enumerate(size)]
    assert sum(x > 0 for x in found) >= 0.99 * len(found) and sum(found) / len(found) > 0.7
    assert not any(got[10_000 + i][4] for i in range(100))


def test_texts_that_polynomial_hashes_confuse(spark):
    a, b = "a", "b"
    for _ in range(11):
        a, b = a + b, b + a
    rows = [(1, a), (2, b)]
    assert result(spark, rows) == brute(rows)
