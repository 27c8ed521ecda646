"""Operators over ordered rows: merging, spans, sessions, attachment, samples, first and last."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import WindowSpec
from pyspark.sql import functions as F


def interval_groups(df: DataFrame, keys: list[str], start: str, end: str, tolerance, order: list[str]) -> DataFrame:
    """df with `group`: a new one where an interval starts beyond the greatest end so far plus the tolerance."""
    w = W.partitionBy(*keys).orderBy(start, *order)
    reach = F.max(end).over(w.rowsBetween(W.unboundedPreceding, -1))
    begins = (reach.isNull() | (F.col(start) > reach + tolerance)).cast("long")
    return df.withColumn("__b", begins).withColumn("group", F.sum("__b").over(w.rowsBetween(W.unboundedPreceding, 0))).drop("__b")


def flag_groups(df: DataFrame, w: WindowSpec, flag: Column) -> DataFrame:
    """df with `group`: rows from one flagged row up to the next; the first row always starts one."""
    begins = (flag | (F.row_number().over(w) == 1)).cast("long")
    return df.withColumn("__b", begins).withColumn("group", F.sum("__b").over(w.rowsBetween(W.unboundedPreceding, 0))).drop("__b")


def toggle_spans(df: DataFrame, w: WindowSpec, delimiter: Column) -> DataFrame:
    """Rows between an odd delimiter and the next, with `span` from 1; an unterminated span is kept, delimiters go."""
    seen = F.sum(delimiter.cast("long")).over(w.rowsBetween(W.unboundedPreceding, 0))
    return df.withColumn("__d", delimiter).withColumn("__n", seen).where(~F.col("__d") & (F.col("__n") % 2 == 1)).withColumn("span", ((F.col("__n") + 1) / 2).cast("long")).drop("__d", "__n")


def attach_previous(w: WindowSpec, anchor: Column, value: Column) -> Column:
    """The value of the last anchor row before this one, or null."""
    return F.last(F.when(anchor, value), ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, -1))


def upper_median(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Element n div 2 (from 0) of the sorted values of each group, by rank, so no group is gathered in an array."""
    w = W.partitionBy(*keys)
    ranked = df.select(*keys, value).withColumn("__r", F.row_number().over(w.orderBy(value)) - 1).withColumn("__n", F.count(F.lit(1)).over(w))
    return ranked.where(F.col("__r") == F.floor(F.col("__n") / 2)).select(*keys, F.col(value).alias("median"))


def even_sample(df: DataFrame, keys: list[str], order: list[str], k: int) -> DataFrame:
    """Rows floor(i * n / k), i from 0, of each group in its order; all rows if there are at most k."""
    w = W.partitionBy(*keys)
    df = df.withColumn("__r", F.row_number().over(w.orderBy(*order)) - 1).withColumn("__n", F.count(F.lit(1)).over(w))
    # row r is taken if it is floor(i * n / k) for i = ceil(r * k / n)
    i = F.ceil(F.col("__r") * k / F.col("__n"))
    taken = (F.col("__n") <= k) | ((i < k) & (F.floor(i * F.col("__n") / k) == F.col("__r")))
    return df.where(taken).drop("__r", "__n")


def first_wins(df: DataFrame, value: str, order: str) -> DataFrame:
    """The first row of each value, by one combined aggregation."""
    return df.groupBy(value).agg(F.min_by(F.struct(*df.columns), order).alias("__t"), F.count(F.lit(1)).alias("copies")).select("__t.*", "copies")


def tail(df: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    """The last n rows of each group, newest first as `age` from 1."""
    return df.withColumn("age", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where(F.col("age") <= n)


def partitioned(df: DataFrame, condition: Column) -> tuple[DataFrame, DataFrame]:
    """The rows that meet a condition, and all others, those where it is null among them."""
    meets = F.coalesce(condition, F.lit(False))
    return df.where(meets), df.where(~meets)
