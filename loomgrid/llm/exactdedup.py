"""Exact dedup as a stateful stream.

Every document becomes one small event (digest, id, row number, content locator). A streaming
aggregation without watermark keeps, per digest, the smallest identifier, its locator and the number
of rows; the state lives in RocksDB on the executors' disks and never expires. Spark combines events
of a digest before the shuffle, so a text that a third of all rows share costs one row per task; the
state comes back to the events without a shuffle of such digests.

A hit on a digest is confirmed on full bytes: the rows that a digest with hits names by identifier are
read again, and the distinct texts under each digest, combined in each task before the shuffle, must be
one. Texts that share a digest but differ are grouped by their bytes. The locator (file of the row that
stays) tells a caller where the bytes of that row lie.

Defined cases: a null text counts as the empty text. A null identifier sorts after all others.
Rows repeated under one identifier are rows of one group, of which exactly one stays. An empty table
gives an empty result. Extra columns are kept and never clash, as all work is on own columns, and helper
columns get names that the table does not have.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..streaming.state import keyed_state
from .common import attach, bloom, cut, free_names, in_bloom, scratch


def normalised(text) -> F.Column:
    """Null reads as empty; each run of ASCII white space becomes one space."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest_hex: int = 64) -> DataFrame:
    """One row per row of docs: row (id, number, locator), keep (the row that stays), group_size, text_sha256.

    digest_hex: hex digits of SHA-256 that serve as the key of the state; fewer only make collisions
    likelier, which the comparison of full texts then settles (tests use 1)."""
    spark = docs.sparkSession
    row = F.struct(
        F.col("id").isNull().alias("no_id"), F.col("id").alias("id"), F.monotonically_increasing_id().alias("number"), F.input_file_name().alias("locator")
    )
    sha = F.sha2(normalised(F.col("text")).cast("binary"), 256)
    own = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    with scratch(spark) as at:
        own.select(row.alias("row"), sha.alias("sha")).withColumn("digest", F.substring("sha", 1, digest_hex)).write.parquet(f"{at}/events")
        events = spark.read.parquet(f"{at}/events")
        # the smallest row only falls and the count only grows from batch to batch
        state = keyed_state(
            spark, f"{at}/events", events.schema, at, "digest", [F.min("row").alias("first"), F.count(F.lit(1)).alias("n")], [F.min("first").alias("first"), F.max("n").alias("n")]
        )
        placed = cut(attach(events, cut(state), ["digest"], "n"))

    # full bytes on every hit: the rows of digests seen more than once, found by identifier, are read again
    key = lambda c: F.when(F.col(c).isNotNull(), F.xxhash64(c)).alias("key")
    table = bloom(placed.where("n > 1").select(key("row.id")).distinct(), "key")
    again = in_bloom(own.select(key("id"), "text"), table, "key").select(normalised(F.col("text")).alias("norm"))
    texts = again.withColumn("sha", F.sha2(F.col("norm").cast("binary"), 256)).withColumn("digest", F.substring("sha", 1, digest_hex)).distinct()
    unlike = texts.groupBy("digest").agg(F.count(F.lit(1)).alias("texts")).where("texts > 1").select("digest")
    if unlike.isEmpty():
        return placed.select("row", F.col("first").alias("keep"), F.col("n").alias("group_size"), F.col("sha").alias("text_sha256"))

    # distinct texts under one digest: their bytes are the key. The row number ties them to the events.
    unlike = cut(unlike)
    shas = texts.join(unlike, "digest", "left_semi").select("norm", "sha")
    if shas.groupBy("sha").count().where("count > 1").isEmpty():
        by = placed.groupBy("sha").agg(F.min("row").alias("keep"), F.count(F.lit(1)).alias("group_size"))
        return attach(placed.select("row", "sha"), cut(by), ["sha"], "group_size").select("row", "keep", "group_size", F.col("sha").alias("text_sha256"))
    raise ArithmeticError("two texts with equal SHA-256: use another digest")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that stay, all columns as they were."""
    own, text = free_names(docs, "own", "text")
    groups = exact_groups(docs, id_col, text_col).select(F.col("row.id").alias(f"{own}2"), F.col("text_sha256").alias(f"{text}2"), (F.col("row.number") != F.col("keep.number")).alias("gone"))
    unclear = not groups.groupBy(f"{own}2").count().where(F.col(f"{own}2").isNull() | (F.col("count") > 1)).isEmpty()
    if not unclear:
        return docs.join(groups.where("gone").select(f"{own}2"), docs[id_col] == F.col(f"{own}2"), "left_anti")
    # identifiers that are missing or repeated: the text decides as well, and equal rows are cut to one
    same = [F.col(own).eqNullSafe(F.col(f"{own}2")), F.col(text) == F.col(f"{text}2")]
    keep = groups.where("not gone").select(f"{own}2", f"{text}2").distinct()
    marked = docs.withColumn(own, docs[id_col]).withColumn(text, F.sha2(normalised(docs[text_col]).cast("binary"), 256))
    return marked.join(keep, same, "left_semi").dropDuplicates([own, text]).drop(own, text)
