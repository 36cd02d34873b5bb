"""Quality rules: counts of each text, and the perplexity of its characters under a modified Kneser-Ney model of the other texts, with a lower and an upper bound for each language.

The model counts n-grams of LENGTH whole characters, without folding. The count of an n-gram is the number of distinct texts that hold it, less one: a text is never a witness for its own n-grams (nor are its copies), whatever its length, so one table serves all texts and still judges each by the others alone. Counts of lower orders follow as usual, from the kinds of characters that stand before. A text begins as a line does.

Distinct texts are dealt into blocks of about BLOCK bytes. Each block counts its n-grams once; Spark sums them, and computes the probabilities order by order with joins on the n-gram itself, so no process holds the model whole and it grows with the corpus. A block gets the rows of its own n-grams back, as a sorted array of hashes with their values, and looks its texts up in it.

A language's band is centred on the median negative log-likelihood per character of its distinct texts that pass the base rules. Spread follows length: the median absolute deviation of each length class (powers of two), over all languages, times the language's own median of deviations so measured (at least LEAST_SCALE, so that near copies can't shrink it to nothing). The band ends where a normal spread leaves TAIL of the texts outside. Languages and length classes of fewer than FEW distinct texts take what all texts together give. No label enters. Medians are of values rounded to 1/1000, so reruns agree.

Results in special cases: null and empty texts have zero counts, fail the base rules and are not kept; a null language is a language of its own; rows that repeat a doc_id each get their row; columns beyond doc_id, text, lang are not read; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from statistics import NormalDist

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bytescan as B
from .common import Scratch, only, table, text_key

#: Characters of the longest n-gram; bytes of text in a block, and the least where there are cores without one; bytes that are worked on at a time.
LENGTH, BLOCK, LEAST_BLOCK, PIECE = 5, 32 << 20, 4 << 20, 1 << 19
#: Share of the texts outside the band were they spread normally; the least deviation; the least scale of a language; how few texts have no band of their own.
TAIL, FLOOR, LEAST_SCALE, FEW = 1e-4, 0.005, 0.5, 50
#: The band's half width in median absolute deviations.
WIDTH = NormalDist().inv_cdf(1 - TAIL / 2) / NormalDist().inv_cdf(0.75)
MARKS = np.isin(np.arange(256), list(b"#*$%&|<>"))
NAMES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
#: What stands before a text.
BEFORE = "\n" * (LENGTH - 1)


def measures(data: np.ndarray, offs: np.ndarray) -> dict[str, np.ndarray]:
    """Counts of each text."""
    inside = ~B.SPACE[data]
    w = B.Words(data, offs, inside)
    texts = len(offs) - 1
    out = {"n_words": w.counts, "word_chars": B.sums_by_text(inside & ((data & 0xC0) != 0x80), offs), "n_symbols": B.sums_by_text(MARKS[data], offs)}
    # lines with a word, and those among them that stood in the text before
    starts, ends = B.runs(data != 0x0A, offs)
    has = np.zeros(len(data) + 1, np.int64)
    np.cumsum(inside, out=has[1:])
    with_word = has[ends] > has[starts]
    starts, ends = starts[with_word], ends[with_word]
    text = np.searchsorted(offs, starts, "right") - 1
    _, first = np.unique(B.pair(text, w.bytes.names(starts, ends)), return_index=True)
    again = np.ones(len(starts), bool)
    again[first] = False
    out["n_dup_lines"] = np.bincount(text[again], minlength=texts)
    out["n_repeat_words"] = np.bincount(w.text[w.repeated(3)], minlength=texts)
    return out


def discounts_of(m) -> list[float]:
    """Discounts of counts 0, 1, 2, 3 and more, from how many n-grams have count 1, 2, 3 and 4 (m[0] is not used); 0.5, 1, 1.5 where those are too few to tell."""
    if min(m[1:5]) == 0:
        return [0.0, 0.5, 1.0, 1.5]
    y = m[1] / (m[1] + 2 * m[2])
    d = [i - (i + 1) * y * m[i + 1] / m[i] for i in (1, 2, 3)]
    return [0.0, *(min(max(x, 0.05), i - 0.05) for i, x in enumerate(d, 1))]


_MULTIPLIERS = np.random.default_rng(9).integers(1, 1 << 63, LENGTH, dtype=np.uint64) * B.U64(2) + B.U64(1)


def characters(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The characters of the texts (their UTF-8 bytes as a number), their first bytes, and where each text begins among them."""
    at = np.flatnonzero((data & 0xC0) != 0x80)
    size = np.diff(np.append(at, len(data)))
    chars = data[at].astype(B.U64)
    for j in range(1, 4):
        i = np.flatnonzero(size > j)
        chars[i] = chars[i] << B.U64(8) | data[at[i] + j]
    return chars, at, np.searchsorted(at, offs)


def with_start(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The texts, each behind BEFORE."""
    n = len(offs) - 1
    new = offs + len(BEFORE) * np.arange(n + 1)
    out = np.full(new[-1], ord(BEFORE[0]), np.uint8)
    out[np.arange(len(data)) + len(BEFORE) * np.repeat(np.arange(1, n + 1), np.diff(offs))] = data
    return out, new


def hashes(chars: np.ndarray) -> np.ndarray:
    """Of each character but the first LENGTH - 1: the hash of the LENGTH that end with it."""
    part, n = B.mix(chars + B.U64(1)), len(chars) - LENGTH + 1
    if n <= 0:
        return np.zeros(0, B.U64)
    h = np.zeros(n, B.U64)
    for k in range(LENGTH):
        h += part[LENGTH - 1 - k : LENGTH - 1 - k + n] * _MULTIPLIERS[k]
    return B.mix(h)


def positions(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash of the n-gram that ends with each character of the texts, its text, first byte and byte after the last of the n-gram in the texts with BEFORE)."""
    padded, poffs = with_start(data, offs)
    chars, at, coffs = characters(padded, poffs)
    h = hashes(chars)
    text = np.repeat(np.arange(len(offs) - 1), np.diff(coffs))
    own = np.flatnonzero(text[: len(h)] == text[LENGTH - 1 :]) if len(h) else np.zeros(0, np.int64)
    ends = np.append(at[1:], len(padded))
    return h[own], text[own], at[own], ends[own + LENGTH - 1]


def _strings(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Ranges of bytes as strings."""
    size = ends - starts
    offs = np.concatenate([[0], np.cumsum(size)])
    flat = data[np.arange(offs[-1]) + np.repeat(starts - offs[:-1], size)]
    return pa.StringArray.from_buffers(len(starts), pa.py_buffer(offs.astype(np.int32)), pa.py_buffer(flat))


_EMPTY = pa.schema([("key", pa.binary()), ("text", pa.string())]).empty_table()
_GRAMS = pa.schema([("block", pa.int32()), ("g", pa.string()), ("m", pa.int64())])


def _distinct(t: pa.Table) -> pa.RecordBatch:
    """(key, text) of a block, each text once, in the order of the keys."""
    t = pa.concat_tables([_EMPTY, *(pa.ipc.open_stream(zstandard.ZstdDecompressor().decompress(x.as_py())).read_all() for x in t["packed"])])
    keys, first = t["key"].to_pylist(), {}
    for i, key in enumerate(keys):
        first.setdefault(key, i)
    t = t.take(pa.array([first[k] for k in sorted(first)], pa.int64()))
    return pa.RecordBatch.from_arrays([pa.concat_arrays(c.chunks) if c.num_chunks else pa.array([], c.type) for c in t.columns], names=["key", "text"])


def _grams(key: tuple, t: pa.Table) -> pa.Table:
    """The distinct n-grams of a block, and how many of its texts hold each."""
    known, counts, rows = np.zeros(0, B.U64), np.zeros(0, np.int64), [pa.array([], pa.string())]
    for _, _, data, offs in B.texts(_distinct(t), piece=PIECE):
        h, text, starts, ends = positions(data, offs)
        if not len(h):
            continue
        one, which = B.groups(h)
        pairs = B.distinct(B.pair(which, text))
        m = np.bincount(pairs // (int(text.max()) + 1), minlength=len(one))
        h = h[one]
        at = np.searchsorted(known, h)
        old = np.zeros(len(h), bool)
        old[at < len(known)] = known[at[at < len(known)]] == h[at < len(known)]
        counts[at[old]] += m[old]
        new = np.flatnonzero(~old)
        rows = [pa.concat_arrays([*rows, _strings(with_start(data, offs)[0], starts[one[new]], ends[one[new]])])] if len(new) else rows
        everything = np.concatenate([known, h[new]])
        o = np.argsort(everything)
        known, counts, rows = everything[o], np.concatenate([counts, m[new]])[o], [rows[0].take(pa.array(o))]
    out = pa.Table.from_arrays([pa.array(np.full(len(counts), key[0].as_py(), np.int32)), rows[0], pa.array(counts)], schema=_GRAMS)
    B.give_back()
    return out


class Known:
    """Log-probabilities of a block's n-grams, behind the sorted array of their hashes."""

    def __init__(self, grams: pa.Array, values: np.ndarray):
        _, offs, data = grams.buffers()
        offs = np.frombuffer(offs, np.int64 if pa.types.is_large_string(grams.type) else np.int32)[grams.offset : grams.offset + len(grams) + 1].astype(np.int64)
        data = np.frombuffer(data, np.uint8)[offs[0] : offs[-1]] if len(grams) else np.zeros(0, np.uint8)
        h = hashes(characters(data, offs - offs[0])[0])[::LENGTH]  # every n-gram has LENGTH characters
        o = np.argsort(h)
        self.h, self.values = h[o], values[o]

    def log_p(self, h: np.ndarray) -> np.ndarray:
        one, which = B.groups(h)
        return self.values[np.searchsorted(self.h, h[one])][which]


_SCORED = pa.schema([("key", pa.binary()), *((n, pa.int64()) for n in NAMES), ("n_chars", pa.int64()), ("nll", pa.float64())])


def _score(_, t: pa.Table, rows: pa.Table) -> pa.Table:
    grams = rows["g"].combine_chunks()
    known = Known(grams.chunk(0) if isinstance(grams, pa.ChunkedArray) and grams.num_chunks else grams if isinstance(grams, pa.Array) else pa.array([], pa.string()), rows["lp"].to_numpy())
    out, batch = [], _distinct(t)
    for lo, hi, data, offs in B.texts(batch, piece=PIECE):
        h, text, _, _ = positions(data, offs)
        n = np.bincount(text, minlength=hi - lo)
        total = np.bincount(text, -known.log_p(h), hi - lo) if len(h) else np.zeros(hi - lo)
        m = measures(data, offs)
        out.append(pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), *(pa.array(m[x].astype(np.int64)) for x in NAMES), pa.array(n), pa.array(total / np.maximum(n, 1))], schema=_SCORED))
    B.give_back()
    return pa.Table.from_batches(out, _SCORED)


def _pack(blocks: int):
    """(key, text) to (block, packed): the texts of a block together and compressed. A task sends a text once, so that copies don't meet in one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, waiting, size = set(), [], 0
        pack = zstandard.ZstdCompressor(level=3)

        def packed() -> Iterator[pa.RecordBatch]:
            t = pa.Table.from_batches(waiting)
            block = np.array([int.from_bytes(k[:8]) % blocks for k in t["key"].to_pylist()], np.int64)
            o = np.argsort(block, kind="stable")
            edges = np.flatnonzero(np.diff(block[o], prepend=-1, append=blocks))
            for lo, hi in zip(edges[:-1], edges[1:], strict=True):
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, t.schema) as w:
                    w.write_table(t.take(pa.array(o[lo:hi])))
                yield pa.RecordBatch.from_arrays([pa.array([block[o[lo]]], pa.int32()), pa.array([pack.compress(sink.getvalue().to_pybytes())], pa.binary())], names=["block", "packed"])

        for batch in batches:
            new = []
            for i, key in enumerate(batch.column(0).to_pylist()):
                if key not in seen:
                    seen.add(key)
                    new.append(i)
            if not new:
                continue
            waiting.append(batch.take(pa.array(new)).cast(_EMPTY.schema))
            size += waiting[-1].nbytes
            if size > 1 << 25:
                yield from packed()
                waiting, size = [], 0
        if waiting:
            yield from packed()
        B.give_back()

    return run


def train(grams: DataFrame, scratch: Scratch) -> DataFrame:
    """(g, lp): the log-probability of the last character of each n-gram that a text holds, given those before it. grams: (g, m), m texts hold g."""
    last = {LENGTH: scratch.save(grams.groupBy("g").agg((F.sum("m") - 1).alias("n")), "order")}
    for k in range(LENGTH - 1, 0, -1):  # in how many n-grams they are the end
        last[k] = scratch.save(last[k + 1].groupBy(F.substring("g", 2, k).alias("g")).agg(F.sum(F.when(F.col("n") > 0, 1).otherwise(0)).alias("n")), "order")
    sizes = [t.where("n > 0").groupBy(F.least("n", F.lit(5)).cast("int").alias("n")).agg(F.lit(k).alias("k"), F.count(F.lit(1)).alias("c"), F.sum(t["n"]).alias("s")) for k, t in last.items()]
    m, total = np.zeros((LENGTH + 1, 6)), np.zeros(LENGTH + 1)
    for n, k, c, s in reduce(DataFrame.union, sizes).collect():  # five rows an order
        m[k, n] = c
        total[k] += s
    d = {k: discounts_of(m[k]) for k in last}
    off = lambda k, n: F.when(n >= 3, d[k][3]).when(n == 2, d[k][2]).when(n == 1, d[k][1]).otherwise(0.0)
    # the first order has one context, whose sums are known
    base = 1 / (m[1].sum() + 1)
    back = (d[1][1] * m[1, 1] + d[1][2] * m[1, 2] + d[1][3] * m[1, 3:].sum()) / total[1] if total[1] else 1.0
    n = F.col("n")
    p = last[1].select("g", ((n - off(1, n)) / F.lit(float(max(total[1], 1))) + F.lit(float(back * base))).alias("p"))
    for k in range(2, LENGTH + 1):
        t = last[k]
        kinds = [F.sum(F.when(x, 1).otherwise(0)) * F.lit(d[k][i]) for i, x in ((1, n == 1), (2, n == 2), (3, n > 2))]
        of = t.where("n > 0").groupBy(F.substring("g", 1, k - 1).alias("context")).agg(F.sum("n").alias("total"), (kinds[0] + kinds[1] + kinds[2]).alias("off"))
        t = t.select("g", "n", F.substring("g", 1, k - 1).alias("context"), F.substring("g", 2, k - 1).alias("end")).join(of, "context", "left").join(p.select(F.col("g").alias("end"), F.col("p").alias("lower")), "end")
        own = (n - off(k, n)) / F.col("total") + F.col("off") / F.col("total") * F.col("lower")
        p = t.select("g", F.when(F.col("total").isNull(), F.col("lower")).otherwise(own).alias("p"))
        if k < LENGTH:
            p = scratch.save(p, "p")
    return p.select("g", F.log("p").alias("lp"))


def bands(good: DataFrame) -> DataFrame:
    """pool, lang, class, mid, half (the band's half width) from lang, n_chars, nll of distinct texts that pass the base rules. pool: of all texts together; a null class: of any length."""
    median = lambda c: F.median(F.round(c, 3))
    good = good.select("lang", "nll", length_class().alias("class"))
    rows = good.withColumn("pool", F.lit(False)).union(good.withColumn("lang", F.lit(None).cast("string")).withColumn("pool", F.lit(True)))
    mid = rows.groupBy("pool", "lang").agg(F.count(F.lit(1)).alias("c"), median("nll").alias("mid")).where(F.col("pool") | (F.col("c") >= FEW)).drop("c")
    same = (F.col("r.pool") == F.col("m.pool")) & F.col("r.lang").eqNullSafe(F.col("m.lang"))
    away = rows.alias("r").join(F.broadcast(mid).alias("m"), same).select("r.pool", "r.lang", "class", "mid", F.abs(F.col("nll") - F.col("mid")).alias("dev"))
    spread = away.cube("pool", "class").agg(F.count(F.lit(1)).alias("c"), F.greatest(median("dev"), F.lit(FLOOR)).alias("spread")).where("pool is not null").where(F.col("class").isNull() | (F.col("c") >= FEW)).drop("c")
    known = spread.where("class is not null")
    whole = spread.where("class is null").select(F.col("pool").alias("p"), F.col("spread").alias("whole"))
    z = away.join(F.broadcast(known), ["pool", "class"], "left").join(F.broadcast(whole), F.col("pool") == F.col("p"))
    scale = z.groupBy("pool", "lang").agg(F.first("mid").alias("mid"), F.greatest(median(F.col("dev") / F.coalesce("spread", "whole")), F.lit(LEAST_SCALE)).alias("scale"))
    return scale.join(spread, "pool").select("pool", "lang", "class", "mid", (F.lit(WIDTH) * F.col("scale") * F.col("spread")).alias("half"))


def length_class():
    return F.floor(F.log2(F.greatest("n_chars", F.lit(1)))).cast("int")


def judge(docs: DataFrame) -> DataFrame:
    """doc_id, lang, key (of the text), counts, nll, base_failed, lower, upper, kept."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "quality")
    d = only(docs, "doc_id", "lang", "text").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), text_key(F.col("text")).alias("key"), "text")
    size = docs.agg(F.sum(F.octet_length(F.col("text")))).first()[0] or 0
    blocks = max(1, -(-size // BLOCK), min(spark.sparkContext.defaultParallelism, -(-size // LEAST_BLOCK)))
    texts = d.where("text is not null").select("key", "text").mapInArrow(_pack(blocks), "block int, packed binary")
    grams = scratch.save(texts.groupBy("block").applyInArrow(_grams, "block int, g string, m long"), "grams")
    scratch.forget_shuffles()
    model = scratch.save(train(grams.select("g", "m"), scratch), "model")
    scratch.forget_shuffles()
    found = scratch.save(grams.select("block", "g").join(model, "g").select("block", "g", "lp"), "found")
    scratch.forget_shuffles()
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    schema = "key binary, " + ", ".join(f"{n} long" for n in NAMES) + ", n_chars long, nll double"
    scored = texts.groupBy("block").cogroup(found.groupBy("block")).applyInArrow(_score, schema)
    scored = scratch.save(scored.withColumn("nll", F.round("nll", 9)).withColumn("base_failed", failed), "scored")
    scratch.forget_shuffles()
    # each text once for each of its languages
    kinds = d.where("text is not null").select("key", "lang").distinct()
    pairs = scratch.save(kinds.join(scored, "key"), "pairs")
    v = scratch.save(_judged(pairs, scratch.save(bands(pairs.where("not base_failed")), "bands")), "verdicts")
    scratch.forget_shuffles()
    values = [*NAMES, "nll", "base_failed", "lower", "upper", "kept"]
    rows = d.select("doc_id", "lang", "key").alias("d").join(v.alias("v"), (F.col("d.key") == F.col("v.key")) & F.col("d.lang").eqNullSafe(F.col("v.lang"))).select("d.doc_id", "d.lang", "d.key", *(f"v.{c}" for c in values))
    null = {**{n: F.lit(0).cast("long") for n in NAMES}, "nll": F.lit(0.0), "base_failed": F.lit(True), "lower": F.lit(None).cast("double"), "upper": F.lit(None).cast("double"), "kept": F.lit(False)}
    none = d.where("text is null").select("doc_id", "lang", "key", *(null[c].alias(c) for c in values))
    return rows.union(none)


def _judged(pairs: DataFrame, b: DataFrame) -> DataFrame:
    """The texts with the narrowest band there is for each: of its language and length, of its language, of all texts of its length, of all texts. Bands are as many as languages times length classes."""
    v = pairs.withColumn("class", length_class())
    lang = F.col("lang").eqNullSafe(F.col("_lang"))
    found: list[Column] = []
    for pool, null in (("not pool", "not"), ("not pool", ""), ("pool", "not"), ("pool", "")):
        own = b.where(pool).where(f"class is {null} null").select(*(F.col(c).alias(f"_{c}") for c in ("lang", "class")), F.struct("mid", "half").alias(f"b{len(found)}"))
        on = ([lang] if pool != "pool" else []) + ([F.col("class") == F.col("_class")] if null else [])
        v = v.join(own, reduce(lambda x, y: x & y, on, F.lit(True)), "left").drop("_lang", "_class")
        found.append(F.col(f"b{len(found)}"))
    v = v.withColumn("b", F.coalesce(*found)).withColumn("lower", F.col("b.mid") - F.col("b.half")).withColumn("upper", F.col("b.mid") + F.col("b.half"))
    fits = F.coalesce(F.col("nll").between(F.col("lower"), F.col("upper")), F.lit(False))
    return v.select("key", "lang", *NAMES, "nll", "base_failed", "lower", "upper", (~F.col("base_failed") & fits).alias("kept"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = judge(table(spark, sf_dir, "documents"))
    return out.select("doc_id", *NAMES, "base_failed", "kept", F.exp("nll").alias("perplexity"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that are kept."""
    bad = judge(docs).where("not kept").select("doc_id", "key").distinct()
    return docs.join(bad, docs["doc_id"].eqNullSafe(bad["doc_id"]) & text_key(docs["text"]).eqNullSafe(bad["key"]), "left_anti")
