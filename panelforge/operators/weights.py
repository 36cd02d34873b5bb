"""Means, weights and z-scores of long panels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..config import span_decay


def demean(df: DataFrame, key: str, value: str) -> DataFrame:
    """Less the mean of the values that are there; what is missing stays missing."""
    return df.withColumn(value, F.col(value) - F.avg(value).over(Window.partitionBy("panel", key)))


def expanding_power(t: Column, last: Column, decay: float) -> Column:
    return F.pow(F.lit(float(decay)), last - t)


def aged(df: DataFrame) -> DataFrame:
    """df with `age`: how many times of its panel come after a row's. Times that are left out of the numbering don't count. Only the panel's times meet in one place, not its rows."""
    times = df.select("panel", "t").distinct().withColumn("age", F.row_number().over(Window.partitionBy("panel").orderBy(F.desc("t"))) - 1)
    return df.join(times, ["panel", "t"])


def solver_weights(y: DataFrame, span: float | None) -> DataFrame:
    """y with w2, the square of the weight in the loss: decay by age where there is a value, else 0."""
    if span is None:
        return y.withColumn("w2", F.when(F.col("y").isNull(), 0.0).otherwise(1.0))
    if span == 1:
        raise ValueError("a span of 1 leaves no weight to any row but the last")
    w = F.pow(F.lit(span_decay(span)), F.col("age"))
    return aged(y).withColumn("w2", F.when(F.col("y").isNull(), 0.0).otherwise(w)).drop("age")


def normalised(df: DataFrame, weight: str, by: list[str]) -> DataFrame:
    return df.withColumn(weight, F.col(weight) / F.sum(weight).over(Window.partitionBy(*by)))


def zscore(df: DataFrame, by: list[str], value: str, name: str = "z") -> DataFrame:
    """By the population's deviation."""
    w = Window.partitionBy(*by)
    return df.withColumn(name, (F.col(value) - F.avg(value).over(w)) / F.nullif(F.stddev_pop(value).over(w), F.lit(0.0)))


def cross_section(df: DataFrame, by: list[str], value: str, name: str = "z") -> DataFrame:
    """By the sample's deviation; 0 for fewer than two values or none that differ."""
    w = Window.partitionBy(*by)
    sd = F.stddev_samp(value).over(w)
    z = F.when(F.coalesce(sd, F.lit(0.0)) > 0, (F.col(value) - F.avg(value).over(w)) / sd).otherwise(0.0)
    return df.withColumn(name, F.when(F.col(value).isNotNull(), z))
