"""Panels in long form. Factors: (panel, t, factor, x); responses: (panel, t, asset, y). Missing is NULL; NaN and infinities become NULL on the way in."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def clean(c: Column | str) -> Column:
    """NULL for what is not a finite number."""
    c = F.col(c) if isinstance(c, str) else c
    c = c.cast("double")
    return F.when(F.isnan(c) | (F.abs(c) == float("inf")), None).otherwise(c)


def from_wide(df: DataFrame, keys: list[str], name: str, value: str) -> DataFrame:
    """Columns other than the keys to rows."""
    cols = [c for c in df.columns if c not in keys]
    if not cols:
        raise ValueError("a wide panel needs columns besides its keys")
    return df.unpivot(keys, [F.col(f"`{c}`").cast("double").alias(c) for c in cols], name, value).withColumn(value, clean(value))


def from_pandas(spark: SparkSession, frame, name: str, value: str, panel: str = "p") -> DataFrame:
    """A pandas frame or an array, rows in time order, to a long panel; an array's columns are called x0, x1, ... or y0, y1, ..."""
    if not isinstance(frame, (pd.DataFrame, pd.Series)):
        frame = pd.DataFrame(frame)
        frame.columns = [f"{'x' if name == 'factor' else 'y'}{i}" for i in range(frame.shape[1])]
    frame = frame.to_frame() if isinstance(frame, pd.Series) else frame
    if frame.empty:
        raise ValueError("an empty panel")
    long = frame.reset_index(drop=True).rename_axis("t").reset_index().melt("t", var_name=name, value_name=value)
    long.insert(0, "panel", panel)
    long[name] = long[name].astype(str)
    return spark.createDataFrame(long).withColumn(value, clean(value)).withColumn("t", F.col("t").cast("int"))


def strict(x: DataFrame, y: DataFrame) -> DataFrame:
    """The times of both panels; an error if they differ."""
    a, b = x.select("panel", "t").distinct(), y.select("panel", "t").distinct()
    if not a.join(b, ["panel", "t"], "left_anti").isEmpty() or not b.join(a, ["panel", "t"], "left_anti").isEmpty():
        raise ValueError("factors and responses have different times")
    return a


def month(ts: Column) -> Column:
    return (F.year(ts) * 12 + F.month(ts) - 1).cast("int")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def revenue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(t, asset, cluster, v): monthly revenue of nations, in millions, with their regions."""
    n = _table(spark, sf_dir, "nation")
    keys = _table(spark, sf_dir, "supplier").join(F.broadcast(n), F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", F.col("n_name").alias("asset"), F.concat(F.lit("R"), F.col("n_regionkey")).alias("cluster"))
    lines = _table(spark, sf_dir, "lineitem").select("l_suppkey", "l_shipdate", (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("v"))
    # lines are summed by supplier and month before they meet anything: at most suppliers x months rows are shuffled on
    by = lines.groupBy("l_suppkey", month(F.col("l_shipdate")).alias("t")).agg(F.sum("v").alias("v"))
    return by.join(keys, by["l_suppkey"] == keys["s_suppkey"]).groupBy("t", "asset", "cluster").agg((F.sum("v") / 1e6).alias("v"))


def nation_panels(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Factors: revenue of regions; responses: revenue of nations; clusters: regions of nations."""
    r = revenue(spark, sf_dir)
    x = r.groupBy("t", F.col("cluster").alias("factor")).agg(F.sum("v").alias("x"))
    p = F.lit("p").alias("panel")
    return x.select(p, "t", "factor", "x"), r.select(p, "t", "asset", F.col("v").alias("y")), r.select(p, "asset", "cluster").distinct()


def month_end(prices: DataFrame, ts: str = "ts", value: str = "value", by: str = "asset") -> DataFrame:
    """The last value of each month."""
    return prices.groupBy(by, month(F.col(ts)).alias("t")).agg(F.max_by(value, ts).alias(value))


def excess_returns(prices: DataFrame, free: DataFrame) -> DataFrame:
    """(asset, t, value) and (t, rf), both monthly, to log returns less the rate of the month before; months without any return go."""
    before = F.lag(F.log("value")).over(Window.partitionBy("asset").orderBy("t"))
    r = prices.select("asset", "t", (F.log("value") - before).alias("r"))
    lagged = free.select((F.col("t") + 1).alias("t"), "rf")
    out = r.join(lagged, "t", "left").select("asset", "t", (F.col("r") - F.col("rf")).alias("excess"))
    return out.join(out.where("excess is not null").select("t").distinct(), "t", "left_semi").select("asset", "t", "excess")
