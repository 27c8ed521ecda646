"""Aggregating operators: thresholds, levelling, accuracy, detection metrics, shares, coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def otsu(df: DataFrame, value: str) -> DataFrame:
    """One row `t`: the smallest threshold of greatest between-class variance over integer values.

    Values are counted first, so the windows run over the histogram, not over the rows. The order of
    the bins is global; there are as many as distinct values (256 for grey levels)."""
    bins = df.groupBy(value).agg(F.count(F.lit(1)).alias("n"))
    up = W.orderBy(value).rowsBetween(W.unboundedPreceding, W.currentRow)
    every = W.partitionBy().rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    mass = F.col("n") * F.col(value)
    b = bins.select(value, F.sum("n").over(up).alias("w0"), F.sum(mass).over(up).alias("s0"), F.sum("n").over(every).alias("w"), F.sum(mass).over(every).alias("s"))
    w1 = F.col("w") - F.col("w0")
    gap = F.col("s0") / F.col("w0") - (F.col("s") - F.col("s0")) / w1
    b = b.where("w0 < w").withColumn("between", F.col("w0").cast("double") * w1 * gap * gap)
    return b.agg(F.min(F.struct((-F.col("between")).alias("v"), F.col(value).alias("t"))).alias("m")).select("m.t")


def flat_field(df: DataFrame, keys: list[str], order: list[str], value: str, radius: int) -> DataFrame:
    """df with `level` = value less the mean of its clipped window, plus 255, held to [0, 255]."""
    w = W.partitionBy(*keys).orderBy(*order).rowsBetween(-radius, radius)
    return df.withColumn("level", F.least(F.lit(255.0), F.greatest(F.lit(0.0), F.col(value) - F.avg(value).over(w) + 255)))


def share_weighted(df: DataFrame, key: str, seen: Column, ok: Column) -> DataFrame:
    """Per key: all rows, seen rows, right ones, share of all rows, rate; rates can be weighted by share over keys with seen rows."""
    by = df.groupBy(key).agg(F.count(F.lit(1)).alias("total"), F.count(F.when(seen, 1)).alias("n"), F.count(F.when(seen & ok, 1)).alias("ok"))
    return by.withColumn("share", F.col("total") / F.sum("total").over(W.partitionBy())).withColumn("rate", F.try_divide(F.col("ok"), F.col("n")))


def weighted_mean(by: DataFrame) -> Column:
    """Mean of rate weighted by share, over the keys that have rows."""
    has = F.col("n") > 0
    return F.try_divide(F.sum(F.when(has, F.col("rate") * F.col("share"))), F.sum(F.when(has, F.col("share"))))


def gate(ok: Column, n: Column, floor: float) -> Column:
    """Whether the percentage reaches the floor, with a slack of 1e-9; never without rows."""
    return F.coalesce((n > 0) & (100 * ok / F.nullif(n, F.lit(0)) >= floor - 1e-9), F.lit(False))


def detection(truth: Column, found: Column) -> list[Column]:
    """Overall, presence, identity given present, spurious given absent; null truth or finding is absent."""
    there, said = truth.isNotNull(), found.isNotNull()
    rate = lambda c, given: F.round(F.try_divide(F.count(F.when(given & c, 1)), F.count(F.when(given, 1))), 6)
    always = F.lit(True)
    return [
        rate(truth.eqNullSafe(found), always).alias("overall"), rate(there == said, always).alias("presence"),
        rate(truth.eqNullSafe(found), there).alias("identity"), rate(said, ~there).alias("spurious"),
    ]
