"""Keyed state without expiry over a stream of files, kept in RocksDB on the executors' disks."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import types as T

_STORE = "spark.sql.streaming.stateStore"
#: Without fallocate a store with few keys takes little disk, however many partitions hold state; all
#: stores of an executor share one bounded amount of memory and are closed after each micro-batch.
ROCKSDB = {
    f"{_STORE}.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider", f"{_STORE}.rocksdb.allowFAllocate": "false",
    f"{_STORE}.rocksdb.boundedMemoryUsage": "true", f"{_STORE}.rocksdb.maxMemoryUsageMB": "64", f"{_STORE}.unloadOnCommit": "true",
}
#: Files of the source read into one micro-batch.
FILES_PER_BATCH = 2000


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """Session settings for the time of one block."""
    old = {name: spark.conf.get(name, None) for name in values}
    for name, value in values.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in old.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def keyed_state(spark: SparkSession, source: str, schema: T.StructType, at: str, key: str, first: list[Column], last: list[Column]) -> DataFrame:
    """The final state of every key after streaming all Parquet files of source.

    first: aggregates of a micro-batch's events by key, which the state merges with what it holds; Spark
    combines the events of a key in each task before the shuffle. last: aggregates of the states written
    batch by batch that give the final one (a minimum that only falls, a count that only grows).
    Checkpoint, state snapshots and results lie under `at`, which must be a shared folder."""
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", FILES_PER_BATCH).parquet(source).groupBy(key).agg(*first)

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{at}/state/batch={number}")

    with settings(spark, ROCKSDB):
        run = stream.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", f"{at}/stream").trigger(availableNow=True).start()
        run.awaitTermination()
    spark.createDataFrame([], stream.schema).write.parquet(f"{at}/state/batch=none")  # a source without rows has no batch
    return spark.read.schema(stream.schema).parquet(f"{at}/state/batch=*").groupBy(key).agg(*last)
