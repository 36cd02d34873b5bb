"""Substring dedup by content-defined chunks.

A gear hash rolls over the last WINDOW bytes of a text; where MASK's bits of it are 0 a chunk ends, if it has at least LEAST bytes, and at MOST bytes at the latest. Ends follow the content, so an insertion moves those near it and no others. Chunks with one digest (BLAKE2b, 128 bits) are copies; the one in the smallest doc_id, at its first place, stays. Only runs of copied chunks of RUN bytes or more in a text count, since short phrases meet by chance. A shared passage loses at most what lies before its first and after its last common cut, so chunks are short beside a passage of 50 words.

Results in special cases: null and empty texts have no chunks; a text without a run loses nothing; rows that repeat a doc_id with one text are one text and each get its row; a null doc_id comes before all others; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bytescan as B
from .common import Scratch, only, table

WINDOW, MASK, LEAST, MOST, RUN = 32, 0x1F << 26, 16, 128, 96


def ends_in(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Where a chunk may end: (place after) each byte at which the gear hash has zeros."""
    if not len(data):
        return np.zeros(0, np.int64)
    h = B._letters(13)[data]
    into = np.arange(len(data)) - np.repeat(offs[:-1], np.diff(offs))
    step = 1
    while step < WINDOW:
        before = np.zeros_like(h)
        before[step:] = h[:-step] << B.U64(step)
        before[into < step] = 0
        h = h + before
        step *= 2
    return np.flatnonzero((h & B.U64(MASK)) == 0) + 1


def chunks(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the chunks of the texts."""
    may = ends_in(data, offs)
    lo = np.searchsorted(may, offs[:-1], "right").tolist()
    hi = np.searchsorted(may, offs[1:], "left").tolist()
    may, starts, ends = may.tolist(), [], []
    for i, (a, b) in enumerate(zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True)):
        for e in (*may[lo[i] : hi[i]], b):
            while e - a > MOST:
                starts.append(a)
                a += MOST
                ends.append(a)
            if e - a >= LEAST or (e == b and e > a):
                starts.append(a)
                ends.append(e)
                a = e
    return np.array(starts, np.int64), np.array(ends, np.int64)


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, _, data, offs in B.texts(batch):
            starts, ends = chunks(data, offs)
            if not len(starts):
                continue
            raw = memoryview(np.ascontiguousarray(data))
            digest = np.frombuffer(b"".join(hashlib.blake2b(raw[a:b], digest_size=16).digest() for a, b in zip(starts.tolist(), ends.tolist(), strict=True)), np.int64)
            text = np.searchsorted(offs, starts, "right") - 1
            place = (starts - offs[text]) << 8 | (ends - starts)
            rows = pa.array(text + lo)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), batch.column(1).take(rows), pa.array(place), pa.array(digest[::2]), pa.array(digest[1::2])], names=["doc_id", "key", "place", "d1", "d2"])
    B.give_back()


def dedup(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_copied (bytes in runs that stand elsewhere too), n_removed (those of them that do not stay), repeats, removed (start and end of each, in turn) of all rows.

    Sums find the first and the last place of each digest, in each task before anything is sent; a digest in one place only is done with. The first places of the others are written, so that Spark can split their join with the chunks where a digest is very common.
    """
    scratch = Scratch(docs.sparkSession, "chunks")
    d = only(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), F.sha2(F.concat_ws(" ", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "text").cast("binary"), 256).alias("hex"), "text")
    d = d.select("doc_id", F.substring(F.unhex("hex"), 1, 16).alias("key"), "text")
    rows = d.where("text is not null").mapInArrow(_chunks, "doc_id long, key binary, place long, d1 long, d2 long")
    # the order of copies: doc_id and place as one number, nulls first
    order = F.coalesce(F.col("doc_id"), F.lit(-(1 << 63))).cast("decimal(19,0)").cast("decimal(38,0)") * F.lit(1 << 40).cast("decimal(13,0)") + F.col("place").cast("decimal(19,0)")
    order = order.cast("decimal(38,0)")
    copies = scratch.save(rows.groupBy("d1", "d2").agg(F.min(order).alias("first"), F.max(order).alias("last")).where("first < last").drop("last"), "first")
    scratch.forget_shuffles()
    hit = rows.join(copies, ["d1", "d2"]).select("key", F.shiftright("place", 8).cast("int").alias("a"), F.col("place").bitwiseAND(255).cast("int").alias("n"), (order > F.col("first")).alias("later"))
    hit = scratch.save(hit, "copies")
    scratch.forget_shuffles()
    runs = scratch.save(hit.groupBy("key").agg(F.sort_array(F.collect_set(F.struct("a", "n", "later"))).alias("c")).mapInArrow(_runs, "key binary, n_copied long, n_removed long, removed array<int>"), "runs")
    n = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")
    out = d.select("doc_id", "key", n.alias("n_bytes")).join(runs, "key", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return out.select("doc_id", "n_bytes", zero("n_copied"), zero("n_removed"), (F.coalesce("n_copied", F.lit(0)) > 0).alias("repeats"), F.coalesce("removed", F.array().cast("array<int>")).alias("removed"))


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunks of a text that have copies to runs of at least RUN bytes."""
    schema = pa.schema([("key", pa.binary()), ("n_copied", pa.int64()), ("n_removed", pa.int64()), ("removed", pa.list_(pa.int32()))])
    for batch in batches:
        out = []
        for key, cs in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            copied, gone, run = 0, [], []
            for c in [*cs, None]:
                if run and (c is None or c["a"] != run[-1]["a"] + run[-1]["n"]):
                    size = run[-1]["a"] + run[-1]["n"] - run[0]["a"]
                    if size >= RUN:
                        copied += size
                        for x in run:
                            if x["later"]:
                                if gone and gone[-1] == x["a"]:
                                    gone[-1] += x["n"]
                                else:
                                    gone += [x["a"], x["a"] + x["n"]]
                    run = []
                run.append(c)
            if copied:
                out.append((key, copied, sum(gone[1::2]) - sum(gone[::2]), gone))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(table(spark, sf_dir, "documents")).withColumn("removed", F.col("removed").cast("string"))
