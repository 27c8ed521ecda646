"""Corpus pipeline: language ID, exact dedup, near-dedup, mixing to target weights, tokenising.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns
of documents. Every stage works on all that its predecessor kept.

Defined cases, of every stage: a null text counts as the empty one, which has no language and so goes at
the first stage (and is kept where there is nothing to learn languages from); very long texts are read
whole; rows without an identifier, or repeated under one, are judged by their text; ties go to the
smaller identifier; an empty table gives an empty result; extra columns stay, whatever they are called.
"""

from __future__ import annotations

import atexit
import uuid
from collections.abc import Callable
from contextlib import suppress

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgrid.llm.bpe import bpe_both
from loomgrid.llm.common import free_names, remove, shared_dir
from loomgrid.llm.exactdedup import exact_dedup
from loomgrid.llm.langid import predict_language, train_language_model
from loomgrid.llm.mixing import mixed
from loomgrid.llm.neardup import near_dedup

#: A document is rejected if no language is found, or none with this mean probability.
LEAST_LANGUAGE_SCORE = 0.4


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a language."""
    model = train_language_model(docs)
    if model is None:
        # nothing to learn from, so nothing to reject by
        return docs
    (found,) = free_names(docs, "found")
    scored = docs.withColumn(found, predict_language("text", docs, model))
    return scored.where((F.col(f"{found}.lang_pred") != "und") & (F.col(f"{found}.score") >= LEAST_LANGUAGE_SCORE)).drop(found)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the smallest doc_id of equal texts."""
    return exact_dedup(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the smallest doc_id of each group of near-duplicates: five-word shingles, similarity 0.8 or more."""
    return near_dedup(docs, k=5, percent=80)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes documents of each source up to its target, some twice."""
    return mixed(docs)


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Adds token ids, their number, and whether they decode to the text again.

    The new columns are ids, n_tokens and round_trip, or, where a column is called so already, the same with
    as many underscores before them as make them new; the table's own columns stay as they are."""
    vocabulary = (public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    (both,) = free_names(docs, "both")
    coded = docs.withColumn(both, bpe_both("text", docs, *vocabulary))
    same = F.col(f"{both}.decoded") == F.coalesce("text", F.lit("")).cast("binary")
    have = {c.lower() for c in docs.columns}
    new = lambda name: name if name not in have else new(f"_{name}")
    return coded.withColumns({new("ids"): F.col(f"{both}.ids"), new("n_tokens"): F.size(f"{both}.ids").cast("long"), new("round_trip"): same}).drop(both)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_id),
    ("exact_dedup", exact),
    ("near_dedup", near),
    ("mixing", mixing),
    ("bpe", tokenise),
]

#: The language network, the near-duplicate signatures and the tokenizer are beyond SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result but the last is written to the shared folder and read again.

    A stage's table is removed once the next one is written. The last one is read by the result, which is
    not yet worked out here, so it stays until the session ends."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    at = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    last = None
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            path = f"{at}/{i}-{name}"
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
            if last:
                remove(spark, last)
            last = path
    atexit.register(forget, spark, at)
    return docs


def forget(spark: SparkSession, path: str) -> None:
    """Remove the pipeline's folder as the session ends; one that has ended already leaves it."""
    with suppress(Exception):  # the session may be gone, and nothing is lost by a folder that stays
        remove(spark, path)
