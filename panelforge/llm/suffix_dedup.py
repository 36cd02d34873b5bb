"""Removal of byte strings that occur again, by suffix sorting of the places where that can be.

A string of LENGTH bytes that occurs twice has in both places the same smallest K-gram (by hash, the leftmost of equals): its anchor. Windows of one text with one anchor are neighbours and make a section. So (1) equal texts become one row with a count; (2) every text gives its sections: hash of the anchor, digest of the section's bytes, place; (3) sections whose anchor occurs nowhere else are done with; a section that occurs again as a whole is repeated as a whole; (4) of the others, one copy of each distinct section goes to the task of its anchor, where the suffixes at all its windows are sorted, and windows that equal a neighbour in LENGTH bytes are repeated; (5) bytes under a repeated window are removed.

The sort is deep-shallow: multikey quicksort by eight bytes at a time to SHALLOW bytes, then a blind trie for each group that is still together. All windows of all texts take part. Anchors choose what to compare and nothing else. Whole texts are equal by SHA-256, whole sections by BLAKE2b of 128 bits, all else by the sort.

A sort can't be split, so an anchor with more than HEAVY distinct sections (the edges of a passage that very many documents share) goes another way that can: its windows are counted by their BLAKE2b digests, summed in each task before they are sent.

The texts are written once as a table in buckets by their key, so the later steps that need bytes read them without a shuffle.

Results in special cases: null text is empty; a text shorter than LENGTH loses nothing; equal texts of LENGTH bytes or more lose everything; rows that repeat a doc_id count as texts of their own; ids may be null; columns beyond doc_id and text are not read; an empty table gives no rows.
"""

from __future__ import annotations

import atexit
import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bytescan as B
from .common import Scratch, only, table, text_key

LENGTH, K, SHALLOW = 200, 48, 32
#: Distinct sections of one anchor that one task sorts.
HEAVY = 1000
#: Bytes of sections that are sorted at a time, whole groups each.
POOL = 4 << 20


def leftmost_least(h: np.ndarray, wide: int) -> np.ndarray:
    """For each run of `wide` numbers the place of its smallest, the leftmost of equals."""
    least, at, span = h, np.arange(len(h), dtype=np.int32 if len(h) < 1 << 31 else np.int64), 1

    def lesser(step: int) -> tuple[np.ndarray, np.ndarray]:
        right = least[step:] < least[:-step]
        return np.where(right, least[step:], least[:-step]), np.where(right, at[step:], at[:-step])

    while 2 * span <= wide:
        least, at = lesser(span)
        span *= 2
    if wide > span:
        least, at = lesser(wide - span)
    return at


def sections(data: np.ndarray, offs: np.ndarray, length: int = LENGTH, k: int = K) -> tuple[np.ndarray, ...]:
    """(first window, windows, hash of the anchor, digest of all bytes) of each section of the texts; they depend on the text alone, and not on what is read with it."""
    n = len(data) - length + 1
    if n <= 0:
        return (np.zeros(0, np.int64),) * 2 + (np.zeros(0, B.U64), [])
    h = B.Rolling(data).windows(k)
    at = leftmost_least(h, length - k + 1)
    edge = np.zeros(len(data) + 2, np.int64)
    long = np.diff(offs) >= length
    np.add.at(edge, offs[:-1][long], 1)
    np.add.at(edge, offs[1:][long] - length + 1, -1)
    valid = np.cumsum(edge)[:n] > 0
    new = valid.copy()
    new[1:] &= ~valid[:-1] | (at[1:] != at[:-1])
    new[offs[:-1][long]] = True
    starts = np.flatnonzero(new)
    text = np.searchsorted(offs, starts, "right") - 1
    ends = offs[text + 1] - length + 1
    ends[:-1] = np.minimum(ends[:-1], starts[1:])
    raw = memoryview(np.ascontiguousarray(data))
    return starts, ends - starts, h[at[starts]], [_digest(raw[a:b]) for a, b in zip(starts.tolist(), (ends - 1 + length).tolist(), strict=True)]


def _digest(raw) -> bytes:
    return hashlib.blake2b(raw, digest_size=16).digest()


def _eights(pool: np.ndarray) -> np.ndarray:
    """The eight bytes from each place as a number that sorts as they do."""
    a = np.concatenate([pool, np.zeros(8, np.uint8)]).astype(np.uint64)
    for bits in (8, 16, 32):
        step = bits // 8
        a = (a[:-step] << np.uint64(bits)) | a[step:]
    return a


class BlindTrie:
    """A binary trie that keeps at each branch only the bit where its two sides differ, and at each leaf the suffixes that are equal.

    To insert, walk down by the bits alone, compare with the leaf that is met, and branch where the two first differ.
    """

    def __init__(self, first: int, name: int):
        self.root: list = [-1, first, [name]]  # leaf: [-1, number, names]; branch: [bit, side of 0, side of 1]

    def insert(self, x: int, name: int) -> None:
        node = self.root
        while node[0] >= 0:
            node = node[1 + (x >> node[0] & 1)]
        differ = x ^ node[1]
        if not differ:
            node[2].append(name)
            return
        bit = differ.bit_length() - 1
        node = self.root
        while node[0] > bit:
            node = node[1 + (x >> node[0] & 1)]
        old, leaf = list(node), [-1, x, [name]]
        node[:] = [bit, old, leaf] if x >> bit & 1 else [bit, leaf, old]

    def leaves(self) -> Iterator[list[int]]:
        """Names of equal suffixes, in the order of the suffixes."""
        todo = [self.root]
        while todo:
            node = todo.pop()
            if node[0] < 0:
                yield node[2]
            else:
                todo += [node[2], node[1]]


def repeated(pool: np.ndarray, starts: np.ndarray, length: int = LENGTH, shallow: int = SHALLOW) -> np.ndarray:
    """Whether the `length` bytes from each start equal those from another start, by sorting the suffixes there."""
    out = np.zeros(len(starts), bool)
    eights = _eights(pool)
    who, group, depth = np.arange(len(starts)), np.zeros(len(starts), np.int64), 0
    while depth < min(shallow, length - length % 8) and len(who):
        key = eights[starts[who] + depth]
        o = np.lexsort((key, group))
        who, key, group = who[o], key[o], group[o]
        same = (key[1:] == key[:-1]) & (group[1:] == group[:-1])
        group = np.concatenate([[0], np.cumsum(~same)])
        together = np.concatenate([[False], same]) | np.concatenate([same, [False]])
        who, group, depth = who[together], group[together], depth + 8
    if not len(who):
        return out
    first = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
    sizes = np.diff(np.append(first, len(who)))
    # a trie of two leaves is one comparison, made for all such groups side by side
    a, b = who[first[sizes == 2]], who[first[sizes == 2] + 1]
    for d in [*range(depth, length - 7, 8), length - 8]:
        same = eights[starts[a] + d] == eights[starts[b] + d]
        a, b = a[same], b[same]
    out[a] = out[b] = True
    raw, place = pool.tobytes(), starts.tolist()
    names = who.tolist()
    for lo, n in zip(first[sizes > 2].tolist(), sizes[sizes > 2].tolist(), strict=True):
        number = lambda i: int.from_bytes(raw[place[i] + depth : place[i] + length])  # noqa: E731, B023
        trie = BlindTrie(number(names[lo]), names[lo])
        for i in names[lo + 1 : lo + n]:
            trie.insert(number(i), i)
        for leaf in trie.leaves():
            if len(leaf) > 1:
                out[leaf] = True
    return out


def _sections(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, text) to (key, anchor, digest, start, n)."""
    for batch in batches:
        for lo, _, data, offs in B.texts(batch):
            start, n, anchor, digest = sections(data, offs)
            if len(start):
                text = np.searchsorted(offs, start, "right") - 1
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(text + lo)), pa.array(anchor.view(np.int64)), pa.array(digest, pa.binary()), pa.array((start - offs[text]).astype(np.int32)), pa.array(n.astype(np.int32))],
                    names=["key", "anchor", "digest", "start", "n"],
                )
    B.give_back()


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (anchor, digest, bytes) to a row (anchor, digest, at, w) for each window: its place and its own digest."""
    for batch in batches:
        for lo in range(0, batch.num_rows, 256):
            some = batch.slice(lo, 256)
            raw = [memoryview(x) for x in some.column(2).to_pylist()]
            n = [len(x) - LENGTH + 1 for x in raw]
            rows = pa.array(np.repeat(np.arange(len(raw)), n))
            at = np.concatenate([np.arange(x) for x in n]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([some.column(0).take(rows), some.column(1).take(rows), pa.array(at), pa.array([_digest(x[i : i + LENGTH]) for x, m in zip(raw, n, strict=True) for i in range(m)], pa.binary())], names=["anchor", "digest", "at", "w"])


def _sorted_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (anchor, digest, bytes) in order of anchor to (anchor, digest, ranges of repeated windows)."""
    names = ["anchor", "digest", "ranges"]
    kept: list[tuple[int, bytes, bytes]] = []
    size = 0

    def sort(rows):
        raw = b"".join(r[2] for r in rows)
        ends = np.cumsum([len(r[2]) for r in rows])
        windows = np.array([len(r[2]) - LENGTH + 1 for r in rows])
        begin = np.repeat(ends - [len(r[2]) for r in rows], windows)
        last = np.cumsum(windows)
        starts = begin + np.arange(last[-1]) - np.repeat(last - windows, windows)
        flags = repeated(np.frombuffer(raw, np.uint8), starts)
        out = []
        for r, hi, n in zip(rows, last.tolist(), windows.tolist(), strict=True):
            f = flags[hi - n : hi]
            if f.any():
                step = np.diff(np.concatenate([[0], f.view(np.int8), [0]]))
                out.append((r[0], r[1], np.stack([np.flatnonzero(step == 1), np.flatnonzero(step == -1)], 1).ravel().tolist()))
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate((pa.int64(), pa.binary(), pa.list_(pa.int32())))], names=names)

    for batch in batches:
        for row in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            if size > POOL and row[0] != kept[-1][0]:
                yield sort(kept)
                kept, size = [], 0
            kept.append(row)
            size += len(row[2])
    if kept:
        yield sort(kept)


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, text, copies, spans) to what is left of each text. spans: first window and the window after the last, in turn."""
    schema = pa.schema([("key", pa.binary()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("removed", pa.list_(pa.int32()))])
    for batch in batches:
        rows = []
        for key, text, copies, spans in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
            b = text if isinstance(text, bytes) else text.encode()
            gone: list[int] = []
            if copies > 1 and len(b) >= LENGTH:
                gone = [0, len(b)]
            else:
                for s in sorted((x["a"], x["b"] - 1 + LENGTH) for x in spans or ()):
                    if gone and s[0] <= gone[-1]:
                        gone[-1] = max(gone[-1], s[1])
                    else:
                        gone += s
            edges = [0, *gone, len(b)]
            left = hashlib.sha256(b"".join(b[x:y] for x, y in zip(edges[::2], edges[1::2], strict=True)))
            rows.append((key, len(b), sum(gone[1::2]) - sum(gone[::2]), len(gone) // 2, left.hexdigest(), gone))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
    B.give_back()


def _texts(docs: DataFrame) -> DataFrame:
    """(key, text, copies): each distinct text once, in buckets by its key."""
    spark = docs.sparkSession
    name = f"texts_{uuid.uuid4().hex}"
    text = F.coalesce(F.col("text"), F.lit(""))
    t = only(docs, "text").select(text_key(text).alias("key"), text.alias("text")).groupBy("key").agg(F.first("text").alias("text"), F.count(F.lit(1)).alias("copies"))
    t.write.option("compression", "zstd").bucketBy(int(spark.conf.get("spark.sql.shuffle.partitions")), "key").saveAsTable(name)
    atexit.register(_forget, spark, name)
    return spark.table(name)


def _forget(spark: SparkSession, name: str) -> None:
    try:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
    except Exception:  # noqa: BLE001  the session may have ended before
        pass


def substring_dedup(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, removed (ends of the removed runs, in turn) of all rows."""
    scratch = Scratch(docs.sparkSession, "suffix")
    texts = _texts(docs)
    scratch.forget_shuffles()
    every = scratch.save(texts.where(F.octet_length("text") >= LENGTH).select("key", "text").mapInArrow(_sections, "key binary, anchor long, digest binary, start int, n int"), "sections")
    # what is joined to rows of a hot anchor or digest is written before, so that Spark can split the join
    again = every.groupBy("anchor").agg(F.count(F.lit(1)).alias("c"), F.min("digest").alias("x"), F.max("digest").alias("y")).where("c > 1")
    again = scratch.save(again.select("anchor", (F.col("x") != F.col("y")).alias("mixed")), "again")
    found = scratch.save(every.join(again, "anchor"), "found")
    scratch.forget_shuffles()
    kinds = found.where("mixed").groupBy("anchor", "digest").agg(F.count(F.lit(1)).alias("c"), F.min(F.struct("key", "start", "n")).alias("one"))
    kinds = scratch.save(kinds.select("anchor", "digest", "c", "one.*"), "kinds")
    heavy = scratch.save(kinds.groupBy("anchor").agg(F.count(F.lit(1)).alias("k")).where(F.col("k") > HEAVY).select("anchor"), "heavy")
    piece = F.substring(F.col("text").cast("binary"), F.col("start") + 1, F.col("n") + LENGTH - 1)
    pieces = scratch.save(texts.select("key", "text").join(kinds.drop("c"), "key").select("anchor", "digest", piece.alias("piece")), "pieces")
    scratch.forget_shuffles()
    light = pieces.join(heavy, "anchor", "left_anti")
    marks = light.repartition(F.col("anchor")).sortWithinPartitions("anchor", "digest").mapInArrow(_sorted_groups, "anchor long, digest binary, ranges array<int>")
    windows = scratch.save(pieces.join(heavy, "anchor", "left_semi").mapInArrow(_windows, "anchor long, digest binary, at int, w binary"), "windows")
    twice = scratch.save(windows.groupBy("w").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("w"), "twice")
    places = windows.join(twice, "w", "left_semi").groupBy("anchor", "digest").agg(F.sort_array(F.collect_list("at")).alias("at"))
    places = places.select("anchor", "digest", F.flatten(F.transform("at", lambda i: F.array(i, i + 1))).alias("ranges"))
    known = scratch.save(kinds.select("anchor", "digest", "c").join(marks.union(places), ["anchor", "digest"], "left"), "known")
    scratch.forget_shuffles()
    whole = F.array(F.struct(F.col("start").alias("a"), (F.col("start") + F.col("n")).alias("b")))
    part = F.transform(F.sequence(F.lit(0), F.size("ranges") - 1, F.lit(2)), lambda i: F.struct((F.col("start") + F.get("ranges", i)).alias("a"), (F.col("start") + F.get("ranges", i + 1)).alias("b")))
    alike = found.where("not mixed").select("key", whole.alias("s"))
    rest = found.where("mixed").join(known, ["anchor", "digest"]).select("key", F.when(F.col("c") > 1, whole).when(F.col("ranges").isNotNull(), part).alias("s")).where("s is not null")
    spans = scratch.save(alike.union(rest).groupBy("key").agg(F.flatten(F.collect_list("s")).alias("spans")), "spans")
    scratch.forget_shuffles()
    cut = texts.join(spans, "key", "left").select("key", "text", "copies", "spans").mapInArrow(_cut, "key binary, n_bytes long, n_removed long, n_spans long, kept_sha256 string, removed array<int>")
    cut = scratch.save(cut, "cut")
    ids = only(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), text_key(F.coalesce(F.col("text"), F.lit(""))).alias("key"))
    return ids.join(cut, "key").drop("key")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(table(spark, sf_dir, "documents")).drop("removed")


#: Every window of 200 bytes of every text, in hexadecimal digits, cut from pieces of 699 bytes; those that stand twice; the runs that they cover; what is left.
ORACLE = """
WITH d AS (SELECT doc_id, row_number() OVER () AS r, hex(encode(coalesce(text, ''))) AS h FROM documents),
part AS (SELECT r, o, substr(h, 2 * o + 1, 2 * 699) AS p FROM (SELECT r, h, unnest(generate_series(0, len(h) // 2 - 200, 500)) AS o FROM d WHERE len(h) >= 400)),
w AS (SELECT r, o + j AS i, md5(substr(p, 2 * j - 1, 400)) AS m FROM (SELECT r, o, p, unnest(generate_series(1, least(500, len(p) // 2 - 199))) AS j FROM part)),
twice AS (SELECT m FROM w GROUP BY m HAVING count(*) > 1),
hit AS (SELECT r, i, CASE WHEN i > lag(i) OVER (PARTITION BY r ORDER BY i) + 200 THEN 1 ELSE 0 END AS new FROM w SEMI JOIN twice USING (m)),
run AS (SELECT r, min(i) AS a, max(i) + 199 AS b FROM (SELECT r, i, sum(new) OVER (PARTITION BY r ORDER BY i) AS g FROM hit) GROUP BY r, g),
cut AS (SELECT r, sum(b - a + 1) AS gone, count(*) AS spans, string_agg(substr(h, 2 * before + 1, 2 * (a - 1 - before)), '' ORDER BY a) || substr(any_value(h), 2 * max(b) + 1) AS kept
        FROM (SELECT r, a, b, coalesce(lag(b) OVER (PARTITION BY r ORDER BY a), 0) AS before FROM run) JOIN d USING (r) GROUP BY r)
SELECT doc_id, (len(h) // 2)::BIGINT AS n_bytes, coalesce(gone, 0)::BIGINT AS n_removed, coalesce(spans, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(kept, h))) AS kept_sha256
FROM d LEFT JOIN cut USING (r)
"""
