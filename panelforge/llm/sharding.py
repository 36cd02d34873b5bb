"""Sharding by minimax contiguous partition.

Texts that are equal form one atomic group; groups stand in the order of a hash of their text. The smallest capacity with which a greedy walk over that order needs no more than the wanted shards is found by binary search, and the cuts are made with it. Sizes per group are never collected: the order is refined like a radix tree, in ranges of hashes, and only where a cut can fall. The driver holds at most FAN sums for each range that is refined.

Results in special cases: a null text is a group of its own (size 1); an empty table gives no rows; a group larger than the mean shard makes a shard of its own size, the rest is evened out; repeated rows each keep a place.
"""

from __future__ import annotations

from bisect import bisect_right
from itertools import accumulate

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Scratch, only, table

#: Bits of the key that orders the groups, and those that one step refines.
KEY_BITS, FAN_BITS = 60, 10


class Order:
    """Sizes of consecutive ranges of keys: (first key, bits left below it, size, holds one group only)."""

    def __init__(self, groups: DataFrame, key: str = "key", size: str = "size"):
        self.groups, self.key, self.size = groups, key, size
        self.ranges = self._sums(None, KEY_BITS - FAN_BITS)

    def _sums(self, above: list[tuple[int, int]] | None, bits: int) -> list[tuple[int, int, int, bool]]:
        """Sums below the given (first key, bits) at the given finer bits."""
        g = self.groups
        if above is not None:
            up = above[0][1]
            g = g.where(F.shiftright(F.col(self.key), up).isin([k >> up for k, _ in above]))
        rows = g.groupBy(F.shiftright(F.col(self.key), bits).alias("p")).agg(F.sum(self.size).alias("s"), F.min(self.key).alias("a"), F.max(self.key).alias("b")).collect()
        return sorted((r.p << bits, bits, r.s, r.a == r.b) for r in rows)

    def refine(self, at: list[int]) -> None:
        by_bits: dict[int, list[tuple[int, int]]] = {}
        for i in at:
            first, bits, _, _ = self.ranges[i]
            by_bits.setdefault(bits, []).append((first, bits))
        new = [x for bits, above in by_bits.items() for x in self._sums(above, max(0, bits - FAN_BITS))]
        gone = set(at)
        self.ranges = sorted([r for i, r in enumerate(self.ranges) if i not in gone] + new)


def _reach(ends: list[int], start: int, capacity: int) -> int:
    """Ranges that fit behind the first `start`, at least one if any is left."""
    base = ends[start - 1] if start else 0
    return min(max(bisect_right(ends, base + capacity), start + 1), len(ends))


def _fits(ends: list[int], widest: int, capacity: int, shards: int) -> bool:
    at = 0
    for _ in range(shards):
        at = _reach(ends, at, capacity)
    return at == len(ends) and widest <= capacity


def _least(fits, lo: int, hi: int) -> int:
    while lo < hi:
        mid = (lo + hi) // 2
        lo, hi = (lo, mid) if fits(mid) else (mid + 1, hi)
    return lo


def cut_points(groups: DataFrame, shards: int) -> tuple[list[int], int]:
    """(first key of every shard but the first, the least capacity). groups: key, size; rows of one key are one atomic group."""
    order = Order(groups)
    if not order.ranges:
        return [0] * (shards - 1), 0
    while True:
        sizes = [r[2] for r in order.ranges]
        ends = list(accumulate(sizes))
        total = ends[-1]
        fluid = max(-(-total // shards), max((r[2] for r in order.ranges if r[3]), default=0))
        high = _least(lambda c: _fits(ends, max(sizes), c, shards), fluid, max(max(sizes), total))
        # a cut of any capacity between the two can fall only in these ranges
        low_at, high_at, touched = 0, 0, set()
        for _ in range(shards):
            base = ends[low_at - 1] if low_at else 0
            low_at = min(max(bisect_right(ends, base + fluid), low_at), len(ends))
            top = (ends[high_at - 1] if high_at else 0) + high
            high_at = min(bisect_right(ends, top) + 1, len(ends))
            touched |= set(range(low_at, high_at))
        touched = {i for i in touched if not order.ranges[i][3] and order.ranges[i][1] > 0}
        touched |= {i for i, r in enumerate(order.ranges) if not r[3] and r[1] > 0 and r[2] > fluid}
        if high == fluid or not touched:
            break
        order.refine(sorted(touched))
    # left: furthest end of the first j shards; right: least end of the first j that lets the rest fit
    left, right = [0], [len(ends)]
    for _ in range(shards):
        left.append(_reach(ends, left[-1], high))
    for _ in range(shards - 1):
        end = ends[right[-1] - 1] if right[-1] else 0
        right.append(min(right[-1], bisect_right([0, *ends], end - high - 1)))
    right = [*right[::-1]]
    cuts, at = [], 0
    for j in range(1, shards):
        base = ends[at - 1] if at else 0
        lo = max(right[j - 1], at)
        hi = max(lo, min(left[j], max(at, bisect_right(ends, base + high))))
        want = base + (total - base) / (shards - j + 1)
        i = bisect_right(ends, want)
        near = min((k for k in (i, i + 1) if lo <= k <= hi), key=lambda k: abs((ends[k - 1] if k else 0) - want), default=min(max(i, lo), hi))
        cuts.append(order.ranges[near][0] if near < len(ends) else 1 << KEY_BITS)
        at = near
    return cuts, high


def shard_column(key: Column, cuts: list[int]) -> Column:
    """How many cuts are at or below the key."""
    return sum((F.when(key >= F.lit(c), 1).otherwise(0) for c in cuts), F.lit(0)).cast("int")


def with_slots(rows: DataFrame, spread: Column, cells: int) -> DataFrame:
    """Number the rows of each shard from 0 without a gap. Rows are dealt to `cells` parts of a shard by a hash, numbered there, and moved by the counts of the parts before: no task gets a whole shard. shards x cells counts are broadcast."""
    rows = rows.withColumn("_cell", F.pmod(F.xxhash64(spread), F.lit(cells)).cast("int"))
    counts = rows.groupBy("shard", "_cell").agg(F.count(F.lit(1)).alias("_n"))
    before = counts.withColumn("_before", F.coalesce(F.sum("_n").over(Window.partitionBy("shard").orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    inner = Window.partitionBy("shard", "_cell").orderBy("doc_id", "text_crc32", "size")
    return rows.withColumn("_i", F.row_number().over(inner)).join(F.broadcast(before), ["shard", "_cell"]).withColumn("slot", (F.col("_before") + F.col("_i") - 1).cast("long")).drop("_cell", "_i", "_before")


def shard_documents(docs: DataFrame, shards: int = 8, cell_rows: int = 50_000) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of all rows by the law 'bytes'.

    cell_rows: rows that one task numbers at a time.
    """
    scratch = Scratch(docs.sparkSession, "shards")
    text = F.col("text")
    rows = scratch.save(
        only(docs, "doc_id", "text").select(
            F.col("doc_id").cast("long").alias("doc_id"),
            (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"),
            F.coalesce(F.crc32(text), F.lit(0)).cast("long").alias("text_crc32"),
            F.shiftrightunsigned(F.xxhash64(text), 64 - KEY_BITS).alias("key"),
        )
    )
    cuts, _ = cut_points(rows, shards)
    cells = max(8, -(-rows.count() // (shards * cell_rows)))
    out = with_slots(rows.withColumn("shard", shard_column(F.col("key"), cuts)), F.col("doc_id"), cells)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(table(spark, sf_dir, "documents"))
