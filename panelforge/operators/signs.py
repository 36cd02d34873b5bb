"""Signs that the evidence supports: slopes of responses on single factors, pooled over clusters, gated by their t-statistics.

Everything is one aggregate of sums over the join of responses and factors in time; residuals are never made.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _moments(x: DataFrame, y: DataFrame, clusters: DataFrame | None, mask: str) -> DataFrame:
    key = "asset" if clusters is None else "cluster"
    yy = y if clusters is None else y.join(clusters, ["panel", "asset"])
    if mask == "valid_rows":
        yy, xx = yy.where("y is not null"), x.where("x is not null")
    elif mask == "fit_compat":  # as inside a fit, where what is missing has become 0 and counts as a row
        yy, xx = yy.withColumn("y", F.coalesce("y", F.lit(0.0))), x.withColumn("x", F.coalesce("x", F.lit(0.0)))
    else:
        raise ValueError(f"mask must be valid_rows or fit_compat, not {mask!r}")
    j = yy.join(xx, ["panel", "t"])
    return j.groupBy("panel", key, "factor").agg(
        F.sum(F.col("x") * F.col("y")).alias("xy"),
        F.sum(F.col("x") * F.col("x")).alias("xx"),
        F.sum(F.col("y") * F.col("y")).alias("yy"),
        F.count(F.lit(1)).alias("n"),
        F.count_distinct("asset").alias("q"),
    )


def slope_tests(x: DataFrame, y: DataFrame, clusters: DataFrame | None = None, tau: float = 0.75, mask: str = "valid_rows") -> DataFrame:
    """panel, asset or cluster, factor, n, slope, t_stat, sign. Both panels without their means."""
    m = _moments(x, y, clusters, mask)
    slope = F.col("xy") / F.nullif(F.col("xx"), F.lit(0.0))
    m = m.withColumn("slope", slope).withColumn("ssr", F.greatest(F.lit(0.0), F.col("yy") - F.col("slope") * F.col("slope") * F.col("xx")))
    df = F.greatest(F.col("n") - F.col("q"), F.lit(1))
    se = F.sqrt(F.col("ssr") / df / F.nullif(F.col("xx"), F.lit(0.0)))
    m = m.withColumn("t_stat", F.col("slope") / F.nullif(se, F.lit(0.0)))
    sign = F.when(F.abs("t_stat") < tau, 0.0).otherwise(F.signum("slope"))
    return m.select("panel", m.columns[1], "factor", "n", "slope", "t_stat", F.coalesce(sign, F.lit(0.0)).cast("int").alias("sign"))


def to_assets(signs: DataFrame, clusters: DataFrame) -> DataFrame:
    """Signs of clusters for each of their assets."""
    return signs.join(clusters, ["panel", "cluster"]).select("panel", "asset", "factor", "slope", "sign")


def override(signs: DataFrame, given: DataFrame) -> DataFrame:
    """Given signs (panel, asset, factor, given), where not null, stand before derived ones."""
    return signs.join(given, ["panel", "asset", "factor"], "left").withColumn("sign", F.coalesce("given", "sign")).drop("given")


def disagreements(x: DataFrame, y: DataFrame, clusters: DataFrame) -> DataFrame:
    """Factors whose own slope on an asset has another sign than the slope of the asset's cluster."""
    own = slope_tests(x, y, None, 0.0).select("panel", "asset", "factor", F.signum("slope").alias("own"))
    pooled = slope_tests(x, y, clusters, 0.0).select("panel", "cluster", "factor", F.signum("slope").alias("pooled"))
    j = own.join(clusters, ["panel", "asset"]).join(pooled, ["panel", "cluster", "factor"])
    return j.where("own * pooled < 0").select("panel", "asset", "cluster", "factor", F.col("own").cast("int").alias("own"), F.col("pooled").cast("int").alias("pooled"))


def cell_weight(slope: Column, sign: Column, gamma: float = 1.0, floor: float = 0.5) -> Column:
    """Adaptive weight of a cell: less for a large slope; 1 where the sign is gated."""
    return F.when(sign == 0, 1.0).otherwise(F.pow(F.greatest(F.abs(slope), F.lit(floor)), F.lit(-gamma)))


def _rms() -> Column:
    return F.coalesce(F.sqrt(F.avg(F.when(F.col("sign") != 0, F.col("w") * F.col("w")))), F.lit(1.0))


def row_weights(cells: DataFrame) -> DataFrame:
    """(panel, asset, row_weight): root mean square over the factors that are not gated."""
    return cells.groupBy("panel", "asset").agg(_rms().alias("row_weight"))


def block_weights(cells: DataFrame, clusters: DataFrame) -> DataFrame:
    """(panel, cluster, factor, block_weight): the same over the members of a cluster."""
    return cells.join(clusters, ["panel", "asset"]).groupBy("panel", "cluster", "factor").agg(_rms().alias("block_weight"))
