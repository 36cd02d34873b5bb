"""Near duplicates by MinHash: one-permutation hashing with optimal densification, banded buckets, star-shaped candidate edges.

Each document's set of word shingles gives one number per bin of a single hash; an empty bin takes the number of the first full bin in an order that depends on the bin alone (optimal densification). Rows of a band make a bucket. In a bucket every document is a candidate with the smallest document only, so edges grow with documents and not with the square of a bucket. Candidates are confirmed on full sets, and links joined to components.

A star can miss a link of two documents that both differ from its centre. Buckets whose documents ended in more than one component are therefore gone over again, exactly: their documents that are outside the bucket's main component are joined with the rest by the rarest shingles of each (two sets that are similar enough must share one of those), under bounds on length and on the place of the shared shingle, and confirmed on full sets. What remains unseen is only a link that shares no bucket at all: with 32 bands of 4 rows less than one in 10**9 at a similarity of 0.85, 10**7 at 0.8.

Documents with equal sets are one node, the smallest id standing for them. Sets are equal if a BLAKE2b digest of them is; shingles are known by 64 bits that mix after every eight bytes of a word and every word.

Only documents that share a bucket are ever compared. Their sets are written once and all comparisons read them. A filter of 2**FILTER_BITS bits, made of their ids, keeps most other texts out of that step; it has one size whatever the corpus, and what it lets through in vain a join drops.

Results in special cases: null text and text without words have an empty set, are linked with nothing and kept; fewer words than a shingle make one shingle of the whole sequence; rows that repeat a doc_id count as one document and each get its row; a null doc_id is never linked (component null, kept); an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bytescan as B
from .common import Scratch, only, table

#: FILTER_BITS: 2**26 bits are 8 MB for each worker, and at most 2**20 rows to the driver.
BANDS, ROWS, FILTER_BITS = 32, 4, 26


@cache
def _donors(bins: int) -> np.ndarray:
    """For each bin the order in which it asks other bins for a number."""
    rng = np.random.default_rng(20)
    return np.stack([rng.permutation(bins) for _ in range(bins)])


def signature(hashes: np.ndarray, bins: int) -> np.ndarray:
    """One-permutation MinHash of sorted distinct 64-bit hashes, without empty bins."""
    at = ((hashes >> B.U64(32)) * B.U64(bins)) >> B.U64(32)
    first = np.ones(len(at), bool)
    first[1:] = at[1:] != at[:-1]
    out, full = np.zeros(bins, B.U64), np.zeros(bins, bool)
    out[at[first].astype(np.int64)] = hashes[first]
    full[at[first].astype(np.int64)] = True
    if not full.all():
        empty = np.flatnonzero(~full)
        asked = _donors(bins)[empty]
        out[empty] = out[asked[np.arange(len(empty)), full[asked].argmax(1)]]
    return out


def band_keys(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    k = np.arange(1, bands + 1, dtype=B.U64)
    for j in range(rows):
        k = B.mix(k * B.U64(0xA0761D6478BD642F) + sig[j * bands : (j + 1) * bands])
    return k


def _digests(sets: list[np.ndarray]) -> pa.Array:
    return pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets], pa.binary())


def _scan(words: int, batches: Iterator[pa.RecordBatch], chosen=None) -> Iterator[tuple[pa.Array, list[np.ndarray]]]:
    """(ids, sets of shingles) of the texts, of the chosen rows alone if there is a choice."""
    for batch in batches:
        batch = batch if chosen is None else batch.filter(chosen(batch))
        for lo, hi, data, offs in B.texts(batch):
            low = B.FOLD[data]
            yield batch.column(0).slice(lo, hi - lo), B.Words(low, offs, ~B.SPACE[low]).shingle_sets(words)
    B.give_back()


def _signed(words: int, bands: int, rows: int):
    schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("digest", pa.binary()), ("keys", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, sets in _scan(words, batches):
            size = np.array([len(s) for s in sets], np.int64)
            keys = [band_keys(signature(s, bands * rows), bands, rows) for s in sets if len(s)]
            flat = np.concatenate(keys).view(np.int64) if keys else np.zeros(0, np.int64)
            ends = np.concatenate([[0], np.cumsum(np.where(size > 0, bands, 0))]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([ids, pa.array(size), _digests(sets), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], schema=schema)

    return run


def _sets(words: int, bits):
    """Rows (doc_id, text, place in the filter) to (doc_id, digest, set), of those the filter has."""
    schema = pa.schema([("doc_id", pa.int64()), ("digest", pa.binary()), ("set", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filter_ = np.frombuffer(bits.value, np.uint64)

        def chosen(batch: pa.RecordBatch) -> pa.Array:
            at = batch.column(2).to_numpy()
            return pa.array(filter_[at >> 6] >> (at & 63).astype(np.uint64) & np.uint64(1) == 1)

        for ids, sets in _scan(words, batches, chosen):
            ends = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([ids, _digests(sets), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(sets).view(np.int64)))], schema=schema)

    return run


def _filter(ids: DataFrame):
    """A broadcast of 2**FILTER_BITS bits: those at the places of the ids are set."""
    at = ids.select(_place(F.col("doc_id")).alias("at"))
    words = at.groupBy(F.shiftright("at", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at & 63 as int))")).alias("x")).toArrow()
    out = np.zeros(1 << FILTER_BITS - 6, np.uint64)
    out[words["w"].to_numpy()] = words["x"].to_numpy().view(np.uint64)
    return ids.sparkSession.sparkContext.broadcast(out.tobytes())


def _place(doc_id: Column) -> Column:
    return F.pmod(F.xxhash64(doc_id), F.lit(1 << FILTER_BITS))


def _similar(common: Column, n: Column, m: Column, per_cent: int) -> Column:
    return common * 100 >= (n + m - common) * per_cent


def _confirm(edges: DataFrame, sets: DataFrame, per_cent: int) -> DataFrame:
    """The edges (a, b) whose sets are similar enough."""
    one, two = (sets.select(F.col("doc_id").alias(k), F.col("set").alias(f"set_{k}")) for k in "ab")
    e = edges.join(one, "a").join(two, "b")
    common = F.size(F.array_intersect("set_a", "set_b"))
    return e.where(_similar(common, F.size("set_a"), F.size("set_b"), per_cent)).select("a", "b").distinct()


def components(nodes: DataFrame, links: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, component): the smallest node that is reachable. Links point every node to ever smaller ones (large star, small star), so the rounds grow with the logarithm of a component's diameter."""
    e = scratch.save(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    seen = None
    while True:
        both = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        # large star: larger neighbours point to the least; small star: smaller neighbours and the node do
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = scratch.save(large.distinct(), "large")
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct(F.col("a"), F.col("m").alias("b")))).alias("x")).select("x.*").where("a <> b").distinct()
        e = scratch.save(small, "small")
        now = e.agg(F.count(F.lit(1)), F.sum(F.col("a").cast("decimal(38,0)")), F.sum(F.col("b").cast("decimal(38,0)")), F.count_distinct("a")).first()
        if now == seen or now[0] == 0:
            break
        seen = now
    least = e.groupBy("a").agg(F.min("b").alias("m"))
    return nodes.join(least, nodes["node"] == least["a"], "left").select("node", F.coalesce("m", "node").alias("component"))


def _rest(buckets: DataFrame, comp: DataFrame, sets: DataFrame, per_cent: int, scratch: Scratch) -> DataFrame | None:
    """Candidates (a, b) that the stars left out and that can't be ruled out, in buckets with more than one component."""
    # the hub's component against the members': a bucket is mixed if one of them is in another
    b = buckets.join(comp, buckets["doc_id"] == comp["node"]).select("key", "hub", "doc_id", "component")
    of_hub = comp.select(F.col("node").alias("hub"), F.col("component").alias("main"))
    mixed = b.join(of_hub, "hub").where("component <> main").select("key").distinct()
    docs = scratch.save(b.join(mixed, "key").select("doc_id", "component").distinct(), "mixed")
    if docs.isEmpty():
        return None
    s = scratch.save(sets.join(docs, "doc_id").select("doc_id", "digest", "component", F.size("set").cast("long").alias("n"), "set"), "sets")
    t = s.select("doc_id", "digest", "component", F.explode("set").alias("token"))
    df = t.groupBy("token").agg(F.count(F.lit(1)).alias("df"), F.min("component").alias("lo"), F.max("component").alias("hi"))
    # tokens of one document alone come first in its order and are only counted; the others follow, rarest first.
    # Of a set only the first n - ceil(n * share) + 1 can hold the first token that it shares with a similar one
    df = scratch.save(df.where("df > 1").select("token", "df", (F.col("lo") < F.col("hi")).alias("mixed")), "df")
    t = t.join(df, "token").groupBy("doc_id", "digest").agg(F.sort_array(F.collect_list(F.struct("df", "token", "mixed"))).alias("o")).join(s.drop("set"), ["doc_id", "digest"])
    keep = F.col("n") - F.ceil(F.col("n") * per_cent / 100.0 - 1e-9) + 1
    alone = F.col("n") - F.size("o")
    t = t.withColumn("alone", alone).where(keep > F.col("alone")).select("doc_id", "component", "n", "alone", F.posexplode(F.slice("o", F.lit(1), (keep - F.col("alone")).cast("int"))).alias("at", "x")).where("x.mixed")
    t = scratch.save(t.select("doc_id", "component", "n", (F.col("alone") + F.col("at")).alias("at"), F.col("x.token").alias("token")), "prefix")
    # the component that most of a token's documents are in needs no pairs within itself
    main = t.groupBy("token", "component").agg(F.count(F.lit(1)).alias("k")).groupBy("token").agg(F.max(F.struct("k", "component"))["component"].alias("main"), F.count(F.lit(1)).alias("kinds")).where("kinds > 1")
    main = scratch.save(main.drop("kinds"), "main")
    side = t.join(main, "token").where("component <> main").drop("main")
    x, y = side.alias("x"), t.alias("y")
    need = F.ceil((F.col("x.n") + F.col("y.n")) * per_cent / (100.0 + per_cent) - 1e-9)
    ok = (F.col("x.component") != F.col("y.component")) & (F.least("x.n", "y.n") >= need) & (F.least(F.col("x.n") - F.col("x.at"), F.col("y.n") - F.col("y.at")) >= need)
    pairs = x.join(y, (F.col("x.token") == F.col("y.token")) & ok)
    return pairs.select(F.greatest("x.doc_id", "y.doc_id").alias("a"), F.least("x.doc_id", "y.doc_id").alias("b")).distinct()


def near_duplicates(docs: DataFrame, words: int = 5, per_cent: int = 80, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """doc_id, n_shingles, component_id, kept; links have 100 * common >= per_cent * union of their shingles of `words` words."""
    scratch = Scratch(docs.sparkSession, "near")
    d = only(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    signed = scratch.save(d.mapInArrow(_signed(words, bands, rows), "doc_id long, n long, digest binary, keys array<long>"), "signed")
    whole = signed.where("n > 0 and doc_id is not null")
    reps = scratch.save(whole.groupBy("digest").agg(F.min("doc_id").alias("rep")), "reps")  # written before, so that Spark can split the join where a third of the rows have one digest
    same = scratch.save(whole.select("doc_id", "digest").join(reps, "digest").select("doc_id", "rep").distinct(), "same")
    nodes = whole.join(same.where("doc_id = rep").select("doc_id").distinct(), "doc_id")
    # a key holds its band; a bucket that only one document is in goes at once
    buckets = nodes.select("doc_id", F.explode("keys").alias("key"))
    hubs = buckets.groupBy("key").agg(F.min("doc_id").alias("hub"), F.max("doc_id").alias("last")).where("hub < last").drop("last")
    buckets = scratch.save(buckets.join(hubs, "key"), "buckets")
    scratch.forget_shuffles()
    stars = scratch.save(buckets.where("doc_id <> hub").select(F.col("doc_id").alias("a"), F.col("hub").alias("b")).distinct(), "stars")
    near = scratch.save(buckets.select("doc_id").distinct(), "near")
    bits = _filter(near)
    sets = d.select("doc_id", "text", _place(F.col("doc_id")).alias("at")).where("doc_id is not null").mapInArrow(_sets(words, bits), "doc_id long, digest binary, set array<long>")
    sets = scratch.save(sets.join(near, "doc_id", "left_semi").dropDuplicates(["doc_id", "digest"]), "sets")
    bits.unpersist()
    scratch.forget_shuffles()

    def linked(edges: DataFrame) -> DataFrame:
        out = scratch.save(_confirm(edges, sets, per_cent), "linked")
        scratch.forget_shuffles()
        return out

    # an id with several texts links what they link
    twice = same.groupBy("doc_id").agg(F.min("rep").alias("b"), F.collect_set("rep").alias("r")).where(F.size("r") > 1)
    links = linked(stars).union(twice.select(F.explode("r").alias("a"), "b").where("a <> b"))
    ids = nodes.select(F.col("doc_id").alias("node")).distinct()
    comp = scratch.save(components(ids, links, scratch), "components")
    more = _rest(buckets, comp, sets, per_cent, scratch)
    if more is not None:
        more = linked(scratch.save(more, "rest"))
        if not more.isEmpty():
            comp = scratch.save(components(ids, links.union(more), scratch), "components")
    of = same.join(comp, same["rep"] == comp["node"]).groupBy("doc_id").agg(F.min("component").alias("component"))
    out = signed.select("doc_id", F.col("n").alias("n_shingles")).join(of, "doc_id", "left")
    out = out.select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), words=3, per_cent=85)


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents but for those of a group whose smallest id is another."""
    gone = near_duplicates(docs).where("not kept").select("doc_id").distinct()
    return docs.join(gone, docs["doc_id"] == gone["doc_id"], "left_anti")


#: Shingles as lists of words; links by the number of shingles in common; components by walking the links.
ORACLE = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, CASE WHEN len(w) < 3 THEN w ELSE w[i : i + 2] END AS g FROM (SELECT doc_id, w, unnest(generate_series(1, greatest(1, len(w) - 2))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
walk AS (SELECT doc_id, doc_id AS node FROM n UNION SELECT walk.doc_id, e.b FROM walk JOIN e ON e.a = walk.node),
comp AS (SELECT doc_id, min(node) AS m FROM walk GROUP BY 1)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, coalesce(comp.m, d.doc_id)::BIGINT AS component_id, d.doc_id = coalesce(comp.m, d.doc_id) AS kept
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN comp USING (doc_id)
"""
