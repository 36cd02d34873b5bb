"""Benchmark decontamination as a prefix-filtered set join, in DataFrame functions only.

An item's windows of `window` words are sets of word shingles, and a document holds a window only if it holds all of them. So one shingle is a sufficient prefix: the rarest over all documents. One scan counts the words of the documents and finds their shingles that occur in the benchmark at all; these are counted, and each window then looks its rarest shingle up among them, at the one place in the document where the window could begin; what is found is confirmed by comparing all words of the window. Windows that need a shingle no document has are dropped unseen.

The benchmark's shingles are broadcast where their bytes, which are counted, are at most BROADCAST_BYTES; beyond it the join is a shuffle.

Results in special cases: a null text has no words; an item with fewer words than a window is one window, one without words none; rows that repeat a doc_id each get their row; a null doc_id is an id, and items whose id is null count as one item, written as nothing among the ids; empty tables give no rows and no hits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Scratch, ascii_lower, only, table

#: What separates words: ASCII but for digits and small letters.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BROADCAST_BYTES = 64 << 20
SHINGLE = 3
#: So many different strings mark the documents in the scan, so that a shuffle deals the marks out.
MARKS = 4096


def words(text: Column) -> Column:
    return F.array_remove(F.split(ascii_lower(text), SEPARATORS), "")


def _shingles(w: Column, k: int) -> Column:
    """The k words from each word, as one string."""
    if k == 1:
        return w
    return F.when(F.size(w) < k, F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(0), F.size(w) - k), lambda i: F.concat_ws(" ", *(F.get(w, i + j) for j in range(k)))))


def _windows(items: DataFrame, window: int) -> DataFrame:
    """item_id, the words and the shingles of each window."""
    w = items.select(F.col("item_id").cast("string").alias("item_id"), words(F.col("text")).alias("w")).where(F.size("w") > 0)
    w = w.select("item_id", F.explode(F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("w") - window + 1)), lambda i: F.slice("w", i, window))).alias("w"))
    k = F.least(F.lit(SHINGLE), F.size("w"))
    return w.select("item_id", F.array_join("w", " ").alias("wid"), k.alias("k"), F.when(k == 1, _shingles(F.col("w"), 1)).when(k == 2, _shingles(F.col("w"), 2)).otherwise(_shingles(F.col("w"), SHINGLE)).alias("s"))


def hits(docs: DataFrame, items: DataFrame, window: int = 10) -> tuple[DataFrame, DataFrame]:
    """(row: doc_id, h, n_words), (verified occurrences: doc_id, h, begin, end, item_id). h tells texts of one doc_id apart."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "leaks")
    win = scratch.save(_windows(only(items, "item_id", "text"), window), "windows")
    d = only(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("h"))
    known = scratch.save(win.select("k", F.explode("s").alias("s")).distinct(), "known")
    sizes = {r.k: r.b for r in known.groupBy("k").agg(F.sum(F.octet_length("s") + 32).alias("b")).collect()}
    # every document is split once: behind its shingles stands a mark, which the join keeps and which brings the number of words; no shingle begins with a space
    mark = F.concat(F.lit(" "), F.pmod(F.xxhash64("doc_id", "h"), F.lit(MARKS)).cast("string"))
    probe = known.select("k", "s").unionByName(spark.range(MARKS).select(F.lit(0).alias("k"), F.concat(F.lit(" "), F.col("id").cast("string")).alias("s")))
    probe = F.broadcast(probe) if sum(sizes.values()) <= BROADCAST_BYTES else probe
    # the words stand in a column of their own: an expression inside transform() would be run again for each word
    part = d.select("doc_id", "h", words(F.coalesce("text", F.lit(""))).alias("w")).select("doc_id", "h", "w", F.size("w").alias("n"), mark.alias("mark"))
    part = part.select("doc_id", "h", "n", F.posexplode(F.concat(*(_shingles(F.col("w"), k) for k in sorted(sizes)), F.array("mark"))).alias("place", "s")).join(probe, "s")
    # the shingles of k words stand behind those of fewer
    before, at = F.lit(0), F.col("place")
    for k in sorted(sizes):
        at = F.when(F.col("k") == k, F.col("place") - before).otherwise(at)
        before = before + F.greatest(F.lit(0), F.col("n") - (k - 1))
    seen = scratch.save(part.select("doc_id", "h", "k", "s", at.alias("at"), "n"), "seen")
    rows = seen.where("k = 0").select("doc_id", "h", F.col("n").cast("long").alias("n_words"))
    seen = seen.where("k > 0").select("doc_id", "h", "k", "s", "at").distinct()
    df = seen.groupBy("k", "s").agg(F.count(F.lit(1)).alias("df"))
    # each window's rarest shingle; none if a shingle has no place at all
    every = win.select("wid", "k", "s").distinct()
    token = every.select("wid", "k", F.size("s").alias("size"), F.posexplode("s").alias("at", "t"))
    token = token.join(df.withColumnRenamed("s", "t"), ["k", "t"]).groupBy("wid", "k", "size").agg(F.count(F.lit(1)).alias("found"), F.min(F.struct("df", "at", "t")).alias("rare"))
    prefix = token.where("found = size").select("wid", "k", F.col("rare.t").alias("s"), F.col("rare.at").alias("lead")).join(every.select("wid", F.col("s").alias("all")), "wid")
    order = Window.partitionBy("doc_id", "h", "k").orderBy("at")
    last = window - SHINGLE
    run = seen.withColumn("run", F.array(F.col("s"), *(F.when(F.lead("at", j).over(order) == F.col("at") + j, F.lead("s", j).over(order)) for j in range(1, last + 1))))
    run = scratch.save(run, "runs")
    # positional bound: the window begins where its rarest shingle says, at a place that exists
    found = run.select("doc_id", "h", "k", "s", "at").join(prefix, ["k", "s"]).select("doc_id", "h", "k", (F.col("at") - F.col("lead")).alias("begin"), "wid", "all").where("begin >= 0")
    same = F.col("f.doc_id").eqNullSafe(F.col("r.doc_id")) & (F.col("f.h") == F.col("r.h")) & (F.col("f.k") == F.col("r.k")) & (F.col("f.begin") == F.col("r.at"))
    sure = found.alias("f").join(run.alias("r"), same).where(F.slice("run", F.lit(1), F.size("all")) == F.col("all"))
    sure = sure.select("f.doc_id", "f.h", "begin", (F.col("begin") + F.size("all") + F.col("f.k") - 1).alias("end"), "wid").distinct()
    sure = scratch.save(sure, "sure")
    return rows, sure.join(win.select("wid", "item_id").distinct(), "wid").select("doc_id", "h", "begin", "end", "item_id")


def decontaminate(docs: DataFrame, items: DataFrame, window: int = 10) -> DataFrame:
    """doc_id, h, n_words, n_hit, n_items, items_sha256, contaminated."""
    rows, sure = hits(docs, items, window)
    spans = sure.groupBy("doc_id", "h", "begin").agg(F.max("end").alias("end"))
    before = F.max("end").over(Window.partitionBy("doc_id", "h").orderBy("begin").rowsBetween(Window.unboundedPreceding, -1))
    new = F.greatest(F.lit(0), F.col("end") - F.greatest(F.col("begin"), F.coalesce(before, F.lit(0))))
    hit = spans.withColumn("new", new).groupBy("doc_id", "h").agg(F.sum("new").cast("long").alias("n_hit"))
    of = sure.groupBy("doc_id", "h").agg(F.array_sort(F.collect_set(F.struct("item_id"))).alias("items"))
    on = lambda a, b: F.col(f"{a}.doc_id").eqNullSafe(F.col(f"{b}.doc_id")) & (F.col(f"{a}.h") == F.col(f"{b}.h"))
    out = rows.alias("d").join(hit.alias("i"), on("d", "i"), "left").join(of.alias("o"), on("d", "o"), "left")
    items_ = F.coalesce(F.transform("items", lambda x: F.coalesce(x["item_id"], F.lit(""))), F.array().cast("array<string>"))
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    return out.select("d.doc_id", "d.h", "n_words", n_hit.alias("n_hit"), F.size(items_).cast("long").alias("n_items"), F.sha2(F.array_join(items_, ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("h")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents without those that hold a window of an item."""
    _, sure = hits(docs, table(spark, sf_dir, "benchmark"))
    bad = sure.select("doc_id", "h").distinct()
    return docs.join(bad, docs["doc_id"].eqNullSafe(bad["doc_id"]) & (F.xxhash64(docs["text"]) == bad["h"]), "left_anti")


ORACLE = r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
b AS (SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(w[i : i + 9], ' ') AS s FROM (SELECT item_id, w, unnest(generate_series(1, greatest(1, len(w) - 9))) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT doc_id, i, n, array_to_string(w[i : i + n - 1], ' ') AS s FROM (SELECT doc_id, w, n, unnest(generate_series(1, len(w) - n + 1)) AS i FROM d, sizes WHERE len(w) >= n)),
hit AS (SELECT dw.doc_id, dw.i, dw.n, bw.item_id FROM dw JOIN bw USING (n, s)),
pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(generate_series(i, i + n - 1)) AS p FROM hit) GROUP BY 1),
it AS (SELECT doc_id, list_sort(list(DISTINCT item_id::VARCHAR)) AS items FROM hit GROUP BY 1)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(len(items), 0)::BIGINT AS n_items, sha256(coalesce(array_to_string(items, ','), '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN pos USING (doc_id) LEFT JOIN it USING (doc_id)
"""
