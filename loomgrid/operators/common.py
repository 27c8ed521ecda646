"""Helpers shared by the operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows up to which a dimension side is broadcast; beyond it the planner chooses.
BROADCAST_ROWS = 10_000
#: Bytes of images that a Python worker gets, or makes, before it hands them on.
IMAGE_BYTES = 8 << 20


def if_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if a count, stopped early, shows that it is small."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def bound(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value) with value worked out once a row, though f uses it inside other lambdas.

    The optimizer inlines projections into lambdas, where they would be worked out for every element."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def image_batches(spark: SparkSession) -> None:
    """Arrow batches of at most IMAGE_BYTES in this session: a task holds several batches of each of its Python workers."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if not 0 < spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(key)) <= IMAGE_BYTES:
        spark.conf.set(key, str(IMAGE_BYTES))


def slices(batches: Iterator[pd.DataFrame], row_bytes: int) -> Iterator[pd.DataFrame]:
    """The rows of the batches, so few at a time that results of row_bytes each stay within IMAGE_BYTES."""
    rows = max(1, IMAGE_BYTES // row_bytes)
    for batch in batches:
        for i in range(0, len(batch), rows):
            yield batch.iloc[i : i + rows]


def spread(df: DataFrame, tasks: int = 4) -> DataFrame:
    """df in at least so many parts a core, for rows that are small to read and slow to work on."""
    parts = tasks * df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(parts) if df.rdd.getNumPartitions() < parts else df
