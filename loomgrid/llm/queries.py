"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import bpe_both
from .exactdedup import exact_groups
from .langid import predict_language, train_language_model
from .lmscore import cross_entropy_difference
from .mixing import mix
from .neardup import near_groups
from .pii import KINDS, personal_data, train_tagger
from .tokencount import token_count
from .topk import exact_top_k, quantised
from .toxicity import toxic_passages, train_toxicity


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _held_out(parts: int, part: int) -> Column:
    """Whether a document is kept from learning; one without an identifier is not."""
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(parts)) == part, F.lit(False))


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = exact_groups(_table(spark, sf_dir, "documents"))
    return groups.select(
        F.col("row.id").alias("doc_id"), F.col("keep.id").alias("keep_id"), "group_size",
        (F.col("row.number") == F.col("keep.number")).alias("kept"), "text_sha256",
    )


OP7_SQL = r"""
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = min(doc_id) OVER w AS kept, sha256(norm) AS text_sha256
FROM (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents)
WINDOW w AS (PARTITION BY norm)
"""

def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as tokenizers

    vocabulary = (tokenizers.path("byte_bpe_multi_50k.tiktoken"), tokenizers.PATTERN)
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    coded = docs.select("doc_id", bpe_both("text", docs, *vocabulary).alias("b")).select("doc_id", "b.ids", "b.decoded")
    return coded.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join("ids", ",").cast("binary"), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mix(_table(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken")


OP8_SQL = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(text, '') AS t FROM documents),
k AS (
  SELECT doc_id, source, len(regexp_extract_all(t, '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         -ln((('0x' || substr(md5(doc_id::VARCHAR), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0)
         / CASE WHEN length(t) = 0 THEN 1.0
                ELSE greatest(0.05, length(regexp_replace(t, '[!-@\[-`{-~]', '', 'g'))::DOUBLE / length(t)) END AS key
  FROM d),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM k GROUP BY source),
w AS (SELECT *, [3.0::DOUBLE, 1.0::DOUBLE, 2.0::DOUBLE][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::BIGINT] AS weight,
             source_size * 2.0::DOUBLE AS most FROM s),
f AS (SELECT *, most / weight AS full_at FROM w),
l AS (SELECT *, (sum(source_size) OVER () * 1.5::DOUBLE
                 - coalesce(sum(most) OVER (ORDER BY full_at, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
                / sum(weight) OVER (ORDER BY full_at, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM f),
g AS (SELECT *, least(most, weight * coalesce((SELECT arg_min(level, full_at) FROM l WHERE level <= full_at), 'inf'::DOUBLE)) AS target FROM l),
e AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS epochs FROM g),
o AS (SELECT k.doc_id, k.size, e.source_size, e.target, e.epochs, e.target - e.epochs * e.source_size AS room,
             sum(k.size) OVER (PARTITION BY k.source ORDER BY k.key, k.doc_id ROWS UNBOUNDED PRECEDING) AS upto
      FROM k JOIN e ON k.source IS NOT DISTINCT FROM e.source)
SELECT doc_id, size, source_size, target,
       (size * (epochs + CASE WHEN upto <= room OR (upto - size < room AND upto - room < room - upto + size) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM o
"""


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    held_out = _held_out(4, 2)
    model = train_language_model(docs.where(~held_out))
    out = docs.select("doc_id", held_out.alias("held_out"), predict_language("text", docs, model).alias("p"))
    return out.select("doc_id", "held_out", "p.lang_pred", "p.score")


def op4_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = near_groups(_table(spark, sf_dir, "documents"), k=4, percent=80)
    return groups.select(F.col("id").alias("doc_id"), "n_shingles", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"))


OP4_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(regexp_replace(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+', ' ', 'g'), ' '), lambda x: x <> '') AS v
  FROM documents),
g AS (
  SELECT doc_id, unnest(CASE WHEN len(v) = 0 THEN []::VARCHAR[] WHEN len(v) < 4 THEN [array_to_string(v, ' ')]
         ELSE list_distinct(list_transform(range(1, len(v) - 2), lambda i: array_to_string(v[i:i+3], ' '))) END) AS s
  FROM w),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
link AS (
  SELECT x, y FROM (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM g a JOIN g b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id) p
  JOIN n na ON na.doc_id = x JOIN n nb ON nb.doc_id = y WHERE 100 * c >= 80 * (na.n + nb.n - c)),
reach AS (
  SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT r.x, l.y FROM reach r JOIN link l ON r.y = l.x)
SELECT d.doc_id, coalesce(any_value(n.n), 0)::BIGINT AS n_shingles, min(r.y) AS component_id, d.doc_id = min(r.y) AS kept
FROM documents d JOIN reach r ON r.x = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id GROUP BY d.doc_id
"""


def op1_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), quantised(F.col("embedding")).alias("vector"))
    out = exact_top_k(vectors, vectors.where("id % 50 = 0"), 5)
    return out.select("query_id", "rank", F.col("id").alias("vec_id"), "score")


OP1_SQL = r"""
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x::DOUBLE))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, coalesce(list_sum(list_transform(range(1, len(q.e) + 1), lambda i: q.e[i] * c.e[i])), 0)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0)
SELECT query_id, rank::INT AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5
"""


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    held_out = _held_out(5, 0)
    model = train_toxicity(docs, labels.where(~held_out))
    out = docs.select("doc_id", held_out.alias("held_out"), toxic_passages("text", docs, model).alias("p"))
    return out.select("doc_id", "held_out", "p.score", (F.col("p.score") >= 0.5).cast("int").alias("predicted"), F.size("p.passages").alias("n_passages"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as tokenizers

    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return docs.select("doc_id", token_count("text", docs, tokenizers.path("piece_bpe_32k.model")).alias("n_tokens"))


def op6_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target: documents labelled as of good quality; background: all documents."""
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    return cross_entropy_difference(docs, labels.where("quality = 1")).withColumnRenamed("id", "doc_id")


def op9_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    out = docs.select("doc_id", personal_data("text", docs, train_tagger(docs)).alias("p"))
    joined = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    count = lambda kind: F.size(F.filter("p.base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return out.select("doc_id", *[count(k) for k in KINDS], F.sha2(joined(F.col("p.base")).cast("binary"), 256).alias("base_sha256"), joined(F.col("p.spans")).alias("spans"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_top_k": op1_top_k,
    "op2_toxicity": op2_toxicity,
    "op3_language_id": op3_language_id,
    "op4_near_dedup": op4_near_dedup,
    "op5_bpe": op5_bpe,
    "op6_lm_scoring": op6_lm_scoring,
    "op7_exact_dedup": op7_exact_dedup,
    "op8_mixing": op8_mixing,
    "op9_personal_data": op9_personal_data,
    "op10_token_counts": op10_token_counts,
}
ORACLE_SQL: dict[str, str] = {"op1_top_k": OP1_SQL, "op4_near_dedup": OP4_SQL, "op7_exact_dedup": OP7_SQL, "op8_mixing": OP8_SQL}
