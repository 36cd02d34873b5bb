import hashlib
import random
import re

from panelforge.llm import decontaminate as module
from panelforge.llm.decontaminate import decontaminate

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(t):
    return WORD.findall((t or "").translate(LOW))


def brute(docs, items, window=10):
    win = {}
    for i, t in items:
        w = words(t)
        for s in range(max(1, len(w) - window + 1) if w else 0):
            win.setdefault(tuple(w[s : s + window]), set()).add(str(i))
    sizes = {len(k) for k in win}
    out = []
    for d, t in docs:
        w, hit, found = words(t), set(), set()
        for n in sizes:
            for s in range(len(w) - n + 1):
                if ids := win.get(tuple(w[s : s + n])):
                    hit |= set(range(s, s + n))
                    found |= ids
        names = sorted(found)
        out.append((d, len(w), len(hit), len(names), hashlib.sha256(",".join(names).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def result(spark, docs, items):
    d = spark.createDataFrame([(i, t, 1, "x") for i, t in docs], "doc_id long, text string, at int, s string")
    b = spark.createDataFrame([(i, t, 2) for i, t in items], "item_id long, text string, k int")
    return sorted((tuple(r) for r in decontaminate(d, b).drop("h").collect()), key=str)


def test_equals_brute_force(spark):
    rng = random.Random(3)
    some = lambda n: [rng.choice("aa b cc d e Ff ü".split()) for _ in range(n)]  # noqa: E731  few words: windows repeat and overlap
    items = [(i, " ".join(some(rng.choice([1, 2, 3, 7, 10, 11, 25])))) for i in range(25)]
    docs = []
    for i in range(60):
        w = some(rng.randint(0, 40))
        for _ in range(rng.randint(0, 3)):
            at = rng.randint(0, len(w))
            w[at:at] = words(rng.choice(items)[1])[rng.randint(0, 3) :]
        docs.append((i, rng.choice([" ", ", ", "\n"]).join(w)))
    assert result(spark, docs, items) == brute(docs, items)


def test_special_cases(spark):
    items = [(1, "One two, three four five six seven eight nine TEN eleven"), (2, None), (3, "..."), (4, "solo"), (10, "One two three four five six seven eight nine ten")]
    hot = "one two three four five six seven eight nine ten"
    docs = [(1, None), (2, ""), (3, hot), (3, hot), (4, "x " + hot + " eleven. " + hot), (None, "Solo solo"), (5, "filler " * 30_000 + hot), (6, hot[:-3] + "tenth")]
    assert result(spark, docs, items) == brute(docs, items)


def test_empty_tables(spark):
    assert result(spark, [], [(1, "a b")]) == []
    assert result(spark, [(1, "a b")], []) == brute([(1, "a b")], [])


def test_items_without_an_id(spark):
    docs = spark.createDataFrame([(1, "x one two y"), (None, "one two"), (2, "y")], "doc_id long, text string")
    items = spark.createDataFrame([(None, "one two"), (None, "two"), ("a", "one two")], "item_id string, text string")
    got = {r.doc_id: (r.n_hit, r.n_items, r.contaminated) for r in decontaminate(docs, items).collect()}
    assert got == {1: (2, 2, True), None: (2, 2, True), 2: (0, 0, False)}


def test_every_text_is_read_and_split_once(spark):
    """Items of one word, two words and more need shingles of three sizes, and the words are counted: all in one pass."""
    items = [(1, "One"), (2, "two three"), (3, "four five six seven eight nine ten eleven twelve thirteen fourteen"), (4, "x y z")]
    docs = [(i, t) for i, t in enumerate([None, "", "one", "Two", "two, three", "x y z", "x y", "one two three four five six seven eight nine ten eleven twelve thirteen", "nothing, at all. ÄÖ"])]
    read = spark.sparkContext.accumulator(0)

    def count(frames):
        for f in frames:
            read.add(len(f))
            yield f

    d = spark.createDataFrame(docs, "doc_id long, text string").mapInPandas(count, "doc_id long, text string")
    b = spark.createDataFrame(items, "item_id long, text string")
    assert sorted((tuple(r) for r in decontaminate(d, b).drop("h").collect()), key=str) == brute(docs, items)
    assert read.value == len(docs)


def test_equals_brute_force_without_broadcast(spark, monkeypatch):
    monkeypatch.setattr(module, "BROADCAST_BYTES", -1)
    monkeypatch.setattr(module, "MARKS", 2, raising=False)
    items = [(1, "a"), (2, "b c"), (3, "a b c d e f g h i j k"), (4, "k l m")]
    docs = [(1, None), (1, None), (2, ""), (3, "a"), (None, "b c"), (None, "B, c"), (4, "x a b c d e f g h i j k l m a"), (4, "x a b c d e f g h i j k l m a"), (5, " 0"), (6, "0 1 2 -1 k l m")]
    auto = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert result(spark, docs, items) == brute(docs, items)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", auto)
