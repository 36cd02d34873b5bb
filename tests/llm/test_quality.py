import math
import re
from collections import Counter
from statistics import NormalDist

import numpy as np

from panelforge.llm import quality as Q

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    w = WORD.findall(text or "")
    lines, dup = set(), 0
    for x in (text or "").split("\n"):
        if WORD.search(x):
            dup += x in lines
            lines.add(x)
    tri = Counter(zip(w, w[1:], w[2:], strict=False))
    hit = {j for i in range(len(w) - 2) if tri[tuple(w[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(hit)


TEXTS = [None, "", " \n ", "a", "a\nb\na\n a\na", "one two three one two three", "x y z x y z x y z", "été # <b> $\n\n\nété # <b> $\r\nété", "last\nlast", "w " * 500, "a b c d. a b c", "日本 語 日本 語 日本 語"]


def test_counts_equal_brute_force(spark):
    df = Q.judge(spark.createDataFrame([(i, t, None if i % 3 else "en", 1) for i, t in enumerate(TEXTS)], "doc_id long, text string, lang string, nll int"))
    got = {r.doc_id: tuple(r[n] for n in Q.NAMES) for r in df.collect()}
    assert got == {i: brute(t) for i, t in enumerate(TEXTS)}


def test_verdicts_keep_clean_text_and_drop_noise(spark):
    rng = np.random.default_rng(1)
    vocabulary = ["".join(rng.choice(list("aeiou" if j % 2 else "bcdfgst")) for j in range(rng.integers(2, 8))) for _ in range(400)]
    rows = [(i, " ".join(rng.choice(vocabulary, 150)), "xx") for i in range(200)]
    rows += [(1000, " ".join("".join(rng.choice(list("#%&@!xzqjw9|"), 6)) for _ in range(150)), "xx"), (1001, " ".join(["aaaa"] * 2 + [f"b{'a' * (i % 40)}" for i in range(150)]), "xx"), (1002, "short", "xx")]
    kept = {r.doc_id for r in Q.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect() if r.kept}
    assert kept == set(range(200))


def colliding():
    """Two texts of one length that every polynomial hash modulo 2**64 takes for one."""
    a, b = "a", "b"
    for _ in range(11):
        a, b = a + b, b + a
    return a, b


def test_lines_and_words_are_compared_by_their_bytes(spark):
    a, b = colliding()
    rows = [(0, f"{a}\n{b}", "en"), (1, f"{a}\n{b}\n{a}", "en"), (2, f"x {a} y x {b} y", "en"), (3, f"x {a} y x {a} y", "en")]
    got = {r.doc_id: (r.n_dup_lines, r.n_repeat_words) for r in Q.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert got == {0: (0, 0), 1: (1, 0), 2: (0, 0), 3: (0, 6)}


def test_edge_rows(spark):
    """Null in every column, a very long text, repeated rows, ties, and columns whose names clash with those made inside."""
    rng = np.random.default_rng(8)
    text = clean_texts(rng, 1)[0]
    rows = [(None, None, None, "k"), (None, text, None, None), (1, text, "xx", "k"), (1, text, "xx", "k"), (2, text, "yy", None), (3, " ".join(clean_texts(rng, 400)), "xx", "k"), (4, "", "xx", "k")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, key string").withColumn("_h", Q.F.lit(7)).withColumn("block", Q.F.lit(1)).withColumn("v", Q.F.lit("d"))
    got = Q.judge(docs).collect()
    assert sorted((str(r.doc_id), r.n_words) for r in got) == sorted((str(i), len((t or "").split())) for i, t, _, _ in rows)
    kept = Q.stage(spark, docs, "")
    assert kept.columns == docs.columns and {r["_h"] for r in kept.collect()} <= {7}
    assert {r.doc_id for r in kept.collect()} <= {None, 1, 2, 3}


def test_empty_table(spark):
    assert Q.judge(spark.createDataFrame([], "doc_id long, text string, lang string")).collect() == []


def plain_model(texts):
    """The formula over dictionaries: (probability of the last character of a string given those before it, characters)."""
    top = Q.LENGTH
    held = Counter(g for t in texts for g in {(Q.BEFORE + t)[i : i + top] for i in range(len(t))})
    n = {top: Counter({g: c - 1 for g, c in held.items() if c > 1})}
    for k in range(top - 1, 0, -1):
        n[k] = Counter(g[1:] for g in n[k + 1])
    d = {k: Q.discounts_of([0, *(sum(c == i for c in x.values()) for i in (1, 2, 3, 4))]) for k, x in n.items()}
    base = 1 / (len(n[1]) + 1)

    def p(g):
        k = len(g)
        if not k:
            return base
        same = [x for y, x in n[k].items() if y[:-1] == g[:-1]]
        if not same:
            return p(g[1:])
        c = n[k][g]
        return (c - d[k][min(3, c)] + sum(d[k][min(3, x)] for x in same) * p(g[1:])) / sum(same)

    return p, set(n[1])


def plain_nll(texts):
    p, _ = plain_model(texts)
    top = Q.LENGTH
    return [-sum(math.log(p((Q.BEFORE + t)[j : j + top])) for j in range(len(t))) / len(t) for t in texts]


def test_probabilities_sum_to_one():
    rng = np.random.default_rng(0)
    p, known = plain_model([" ".join(rng.choice(["the", "cat", "sat", "on", "mat"], 9)) for _ in range(20)])
    for context in ("the ", "\n\n\n\n", "xxxx", " sat"):
        assert abs(sum(p(context + c) for c in known) + p(context + "\0") - 1) < 1e-9


def test_a_text_is_no_witness_for_itself():
    rng = np.random.default_rng(6)
    texts = clean_texts(rng, 20)
    p, _ = plain_model([*texts, "qqqq qqqq " * 50])
    q, _ = plain_model([*texts, "zzzzzz"])
    assert p("\nqqqq"[-Q.LENGTH :]) == q("\nqqqq"[-Q.LENGTH :])


def test_likelihood_of_whole_characters_equals_the_formula(spark, monkeypatch):
    monkeypatch.setattr(Q, "BLOCK", 300)  # several blocks
    monkeypatch.setattr(Q, "PIECE", 200)
    rng = np.random.default_rng(2)
    words = ["Дом", "дом", "The", "the", "日本", "語", "née", "cat", "😀"]
    texts = [" ".join(rng.choice(words, 25)) for _ in range(12)] + ["Zq"]
    rows = [(i, t, "xx") for i, t in enumerate(texts)]
    got = {r.doc_id: r.nll for r in Q.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    for i, want in enumerate(plain_nll(texts)):
        assert abs(got[i] - want) < 1e-9


def clean_texts(rng, n):
    vocabulary = ["".join(rng.choice(list("aeiou" if j % 2 else "bcdfgst")) for j in range(rng.integers(2, 8))) for _ in range(400)]
    return [" ".join(rng.choice(vocabulary, 150)) for _ in range(n)]


def noise(rng):
    return " ".join("".join(rng.choice(list("#%&@!xzqjw9|"), 6)) for _ in range(150))


def test_copies_move_no_band_and_lone_junk_has_none(spark):
    rng = np.random.default_rng(3)
    clean = clean_texts(rng, 200)
    rows = [(i, t, "xx") for i, t in enumerate(clean)] + [(1000 + i, clean[0], "yy" if i % 2 else "xx") for i in range(300)]
    rows += [(2000, noise(rng), None), (2001, noise(rng), "zz")]
    kept = {r.doc_id for r in Q.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect() if r.kept}
    assert kept == {i for i, _, _ in rows if i < 2000}


def test_copies_of_junk_do_not_vouch_for_it(spark):
    rng = np.random.default_rng(4)
    rows = [(i, t, "xx") for i, t in enumerate(clean_texts(rng, 200))]
    for i, copies in enumerate((1, 20, 200)):
        text = noise(np.random.default_rng(10 + i)).translate(str.maketrans("#%&@!xzqjw9|", "".join(chr(0x3B1 + 12 * i + j) for j in range(12))))
        rows += [(1000 * (i + 1) + j, text, "xx") for j in range(copies)]
    kept = {r.doc_id for r in Q.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect() if r.kept}
    assert kept == set(range(200))


def test_band_follows_the_tail_rule(spark):
    rng = np.random.default_rng(5)
    rows = [("ab"[i % 2], 300, float(x)) for i, x in enumerate(rng.normal(1.5, 0.1, 4000))] + [("c", 300, 1.5)]
    got = {(r["pool"], r["lang"]): r for r in Q.bands(spark.createDataFrame(rows, "lang string, n_chars long, nll double")).collect() if r["class"] == 8}
    assert set(got) == {(False, "a"), (False, "b"), (True, None)}
    for r in got.values():
        assert abs(r["mid"] - 1.5) < 0.01
        outside = 2 - 2 * NormalDist(0, 0.1).cdf(r["half"])
        assert Q.TAIL / 3 < outside < Q.TAIL * 3
