"""Keyed lookups, merges, inversions, audits and positional comparison."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import if_small


def left_default(left: DataFrame, right: DataFrame, on: str, defaults: dict[str, object]) -> DataFrame:
    """Left join where a missing record reads as the defaults."""
    out = left.join(right, on, "left")
    return out.select(*[F.coalesce(F.col(c), F.lit(defaults[c])).alias(c) if c in defaults else F.col(c) for c in out.columns])


def merge_update(base: DataFrame, new: DataFrame, on: str, columns: list[str]) -> DataFrame:
    """base with columns replaced where new has the key and a value; other rows keep theirs."""
    renamed = new.select(on, *[F.col(c).alias(f"__new_{c}") for c in columns])
    out = base.join(renamed, on, "left")
    return out.select(*[F.coalesce(f"__new_{c}", c).alias(c) if c in columns else F.col(c) for c in base.columns])


def lookup_with_fallback(rows: DataFrame, exact: DataFrame, exact_on: str, general: DataFrame, general_on: str, value: str) -> DataFrame:
    """rows with `value` from the exact table or else the general one, and `found` saying which."""
    out = rows.join(exact.withColumnRenamed(value, "__e"), exact_on, "left").join(general.withColumnRenamed(value, "__g"), general_on, "left")
    found = F.when(F.col("__e").isNotNull(), "exact").when(F.col("__g").isNotNull(), "general").otherwise("none")
    return out.select(*rows.columns, F.coalesce("__e", "__g").alias(value), found.alias("found"))


def invert(df: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """value -> key; of several keys the last one wins."""
    return df.groupBy(value).agg(F.max_by(key, order).alias(key), F.count(F.lit(1)).alias("n_keys"))


def composite_key(*parts: Column) -> Column:
    """One key of several nullable parts; null reads as empty."""
    return F.concat_ws("|", *[F.coalesce(p, F.lit("")) for p in parts])


def range_audit(present: DataFrame, key: str, ranges: DataFrame) -> DataFrame:
    """Per range (name, low, high): expected and actual number of members, how many are missing, and a status.

    Both sides are counted per range; the expected members are never written out."""
    # each key is counted first, so the ranges meet a row a key, and they are broadcast only if they are few
    keys, ranges = present.groupBy(key).agg(F.count(F.lit(1)).alias("rows")), if_small(ranges)
    hit = keys.join(ranges, F.col(key).between(F.col("low"), F.col("high"))).groupBy("name").agg(F.count(F.lit(1)).alias("actual"), F.sum("rows").alias("rows"))
    out = ranges.join(hit, "name", "left")
    expected, actual = F.col("high") - F.col("low") + 1, F.coalesce("actual", F.lit(0)).cast("long")
    status = F.when(actual < expected, "GAP").when(F.coalesce("rows", F.lit(0)) > expected, "EXCESS").otherwise("OK")
    return out.select("name", expected.cast("long").alias("expected"), actual.alias("actual"), (expected - actual).cast("long").alias("missing"), status.alias("status"))
