"""Mixing sources to target weights by entropy balancing.

Every document gets a rate of use r. Among all rates with r <= LIMIT under which the words of each source sum to its target, the ones nearest to 1 in relative entropy are r = min(LIMIT, exp(lambda * size / mean size)), with one lambda a source. The convex dual in lambda is solved by Newton steps in the logarithm of the sum, kept inside a bracket. The sums run over a table of (source, size, count), which is grouped once; no row of a document is touched by a step. Rates are then rounded to copies by systematic sampling along the sizes of a source, in whole numbers of 2**-20, so reruns agree; the last few words are set right by one more or one less copy of single documents whose sizes fit best, never past 0 or LIMIT, and only if that brings the source nearer to its target. Every row has a number of its own, written once, so that equal rows are told apart.

Results in special cases: a null source is a source (last in order); null or empty text has size 0 and takes no words; a source without words has target 0; an empty table gives no rows; repeated rows count each for itself and may be taken unequally often; of equal rows it is open which gets a copy more.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import WORD, Scratch, only, table, unused

#: Weights of the sources in order, repeating; most copies of a document; whole numbers that make one copy.
WEIGHTS, LIMIT, ONE = (5, 2, 1), 3, 1 << 20


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, limit: int = LIMIT) -> DataFrame:
    """source, source_size, mean_size, target. One row a source; what a source can't take is shared again by weight."""
    by = Window.orderBy(F.col("source").asc_nulls_last())
    s = sizes.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"), (F.sum(F.col("size") * F.col("n")) / F.sum("n")).alias("mean_size"))
    s = s.withColumn("w", F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.row_number().over(by) - 1, F.lit(len(weights))) + 1).cast("int")).cast("double"))
    # Sources reach their limit in the order of limit / weight: with the first k at theirs, the rest share what is left.
    s = s.withColumn("cap", (F.col("source_size") * limit).cast("double")).withColumn("ratio", F.col("cap") / F.col("w"))
    up = Window.orderBy("ratio", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    s = s.withColumn("level", (F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(up), F.lit(0.0))) / (F.sum("w").over(every) - F.coalesce(F.sum("w").over(up), F.lit(0.0))))
    level = F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "level"))).over(every)["level"]
    return s.withColumn("target", F.least("cap", F.coalesce(level, F.col("ratio")) * F.col("w"))).select("source", "source_size", "mean_size", "target")


def _rate(lam: Column, size: Column, mean: Column, limit: int) -> Column:
    return F.least(F.lit(float(limit)), F.exp(F.least(F.lit(50.0), lam * size / mean)))


def solve(sizes: DataFrame, goals: DataFrame, scratch: Scratch, limit: int = LIMIT, steps: int = 40, near: float = 1e-9) -> DataFrame:
    """goals with lam, the multiplier of each source: null where no rate is asked for, 1e9 where every rate is at the limit."""
    full = F.col("target") >= F.col("source_size") * limit * (1 - 1e-12)
    lam = scratch.save(goals.select("*", F.when(F.col("source_size") == 0, None).when(full, 1e9).otherwise(F.log(F.col("target") / F.col("source_size"))).alias("lam"), F.lit(-60.0).alias("lo"), F.lit(60.0 * 60).alias("hi")), "lam")
    same = sizes["source"].eqNullSafe(F.col("t.source"))
    for _ in range(steps):
        r = _rate(F.col("lam"), F.col("size"), F.col("mean_size"), limit)
        free = F.when(r < limit, F.col("size") * F.col("size") / F.col("mean_size") * r * F.col("n")).otherwise(0.0)
        part = sizes.where("size > 0").join(lam.where("lam < 1e8").alias("t"), same).groupBy(F.col("t.source").alias("source")).agg(F.sum(r * F.col("size") * F.col("n")).alias("f"), F.sum(free).alias("d"))
        now = lam.alias("t").join(part.alias("p"), F.col("t.source").eqNullSafe(F.col("p.source")), "left").select("t.*", "f", "d")
        over = F.col("f") > F.col("target")
        now = now.withColumn("hi", F.when(over, F.col("lam")).otherwise(F.col("hi"))).withColumn("lo", F.when(~over, F.col("lam")).otherwise(F.col("lo")))
        step = F.col("lam") - F.log(F.col("f") / F.col("target")) * F.col("f") / F.nullif(F.col("d"), F.lit(0.0))
        inside = (step > F.col("lo")) & (step < F.col("hi"))
        off = F.abs(F.col("f") / F.col("target") - 1)
        now = now.withColumn("off", off).withColumn("lam", F.when(F.col("f").isNull() | (off <= near), F.col("lam")).when(inside, step).otherwise((F.col("lo") + F.col("hi")) / 2))
        lam = scratch.save(now.drop("f", "d"), "lam")
        worst = lam.agg(F.max("off")).first()[0]
        if worst is None or worst <= near:
            break
        lam = lam.drop("off")
    # sums of doubles differ in their last digits with the order of the tasks; rounding takes that away
    return lam.drop("off", "lo", "hi").withColumn("lam", F.round("lam", 9))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, limit: int = LIMIT, cell_rows: int = 20_000, row: str | None = None) -> DataFrame:
    """row, doc_id, source, size, source_size, target, rate, copies, taken of all rows. row: a column with a number for each row; without one rows are numbered here."""
    scratch = Scratch(docs.sparkSession, "mix")
    d = only(docs, "doc_id", "text", "source", *([row] if row else []))
    size = F.coalesce(F.regexp_count(F.col("text"), F.lit(WORD)), F.lit(0)).cast("long")
    number = F.col(f"`{row}`") if row else F.monotonically_increasing_id()
    rows = scratch.save(d.select(number.alias("row"), "doc_id", "source", size.alias("size"), F.xxhash64("doc_id", "text").alias("row_hash")), "sizes")
    sizes = scratch.save(rows.groupBy("source", "size").agg(F.count(F.lit(1)).alias("n")), "hist")
    lam = solve(sizes, targets(sizes, weights, limit), scratch, limit)
    cells = max(1, -(-rows.count() // (cell_rows * 16)))
    r = F.when(F.col("lam").isNull(), F.lit(1.0)).otherwise(_rate(F.col("lam"), F.col("size"), F.col("mean_size"), limit))
    rated = rows.alias("r").join(lam.alias("t"), F.col("r.source").eqNullSafe(F.col("t.source"))).select("r.*", "source_size", "target", r.alias("rate"))
    whole = F.floor(F.col("rate"))
    rated = rated.withColumn("whole", whole).withColumn("part", F.round((F.col("rate") - whole) * ONE).cast("long"))
    # parts of a source: an eighth of an octave of sizes, and a hash; a row's number only orders equal rows, so that reruns agree
    rated = rated.withColumn("band", F.floor(F.log2(F.col("size") + 1) * 8).cast("int")).withColumn("cell", F.pmod(F.xxhash64("row_hash"), F.lit(cells)).cast("int"))
    part = scratch.save(rated, "rated")
    totals = part.groupBy("source", "band", "cell").agg(F.sum("part").alias("all"))
    before = totals.withColumn("before", F.coalesce(F.sum("all").over(Window.partitionBy("source").orderBy("band", "cell").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("all")
    order = Window.partitionBy("source", "band", "cell").orderBy("size", "row_hash", "doc_id", "row").rowsBetween(Window.unboundedPreceding, 0)
    summed = part.withColumn("upto", F.sum("part").over(order))
    on = F.col("s.source").eqNullSafe(F.col("b.source")) & (F.col("s.band") == F.col("b.band")) & (F.col("s.cell") == F.col("b.cell"))
    upto = F.col("upto") + F.col("before") + ONE // 2
    more = F.floor(upto / ONE) - F.floor((upto - F.col("part")) / ONE)
    out = summed.alias("s").join(before.alias("b"), on).withColumn("copies", F.least(F.lit(limit), F.col("whole") + more).cast("int"))
    out = scratch.save(out.select("row", "doc_id", "row_hash", "s.source", "size", "source_size", "target", "rate", "copies"), "rounded")
    for _ in range(3):
        out = scratch.save(_nearer(out, limit, scratch), "nearer")
    return out.withColumn("taken", F.col("copies") * F.col("size"))


def _nearer(rows: DataFrame, limit: int, scratch: Scratch) -> DataFrame:
    """One copy more or less of one row of each source, if that brings the source nearer to its target."""
    miss = scratch.save(rows.groupBy("source").agg((F.max("target") - F.sum(F.col("copies") * F.col("size"))).alias("miss")), "miss")
    fits = (F.col("size") > 0) & (F.col("size") < 2 * F.abs("miss")) & F.when(F.col("miss") > 0, F.col("copies") < limit).otherwise(F.col("copies") > 0)
    pick = rows.alias("r").join(miss.alias("m"), F.col("r.source").eqNullSafe(F.col("m.source"))).where(fits).groupBy("r.source")
    pick = pick.agg(F.min(F.struct(F.abs(F.abs("miss") - F.col("size")).alias("off"), "row_hash", "doc_id", "row", F.signum("miss").cast("int").alias("step"))).alias("p"))
    pick = scratch.save(pick.select("p.row", "p.step"), "pick")  # a row for each source; its size is known when it is joined
    return rows.join(pick, "row", "left").select("row", "doc_id", "row_hash", "source", "size", "source_size", "target", "rate", (F.col("copies") + F.coalesce("step", F.lit(0))).alias("copies"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "source", "rate", "copies")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents, each as often as the mix takes it."""
    scratch = Scratch(spark, "mixed")
    row, copy = unused(docs, "row"), unused(docs, "copy")
    numbered = scratch.save(docs.withColumn(row, F.monotonically_increasing_id()), "numbered")
    taken = mix(numbered, row=row).where("copies > 0").select(F.col("row").alias("number"), "copies")
    every = numbered.join(taken, numbered[row] == taken["number"])
    return every.select(*(numbered[f"`{c}`"] for c in docs.columns), F.explode(F.sequence(F.lit(1), taken["copies"])).alias(copy)).drop(copy)
