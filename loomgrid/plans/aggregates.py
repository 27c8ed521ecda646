"""Queries that aggregate."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators import aggregates as A
from ..operators.common import if_small
from .registry import query, table
from .sequences import events


@query("""WITH b AS (SELECT floor(l_quantity)::BIGINT AS q, count(*) AS n FROM lineitem GROUP BY 1),
c AS (SELECT q, sum(n) OVER u AS w0, sum(n * q) OVER u AS s0, sum(n) OVER () AS w, sum(n * q) OVER () AS s FROM b WINDOW u AS (ORDER BY q ROWS UNBOUNDED PRECEDING)),
v AS (SELECT q, w0::DOUBLE * (w - w0) * (s0 / w0::DOUBLE - (s - s0) / (w - w0)::DOUBLE) * (s0 / w0::DOUBLE - (s - s0) / (w - w0)::DOUBLE) AS v FROM c WHERE w0 < w),
t AS (SELECT q AS t FROM v ORDER BY v DESC, q LIMIT 1)
SELECT t, (q < t)::INT AS ink, count(*) AS n FROM (SELECT floor(l_quantity)::BIGINT AS q FROM lineitem), t GROUP BY t, ink""")
def q_binarize_otsu(spark: SparkSession, sf_dir: str) -> DataFrame:
    values = table(spark, sf_dir, "lineitem").select(F.floor("l_quantity").alias("q"))
    # one row, by construction
    return values.crossJoin(F.broadcast(A.otsu(values, "q"))).groupBy("t", (F.col("q") < F.col("t")).cast("int").alias("ink")).agg(F.count(F.lit(1)).alias("n"))


@query("""WITH w AS (SELECT event_id, value - avg(value) OVER (PARTITION BY user_id ORDER BY epoch_us(ts), event_id ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) + 255 AS v FROM events)
SELECT event_id, round(least(255.0::DOUBLE, greatest(0.0::DOUBLE, v)), 6) AS level, (least(255.0::DOUBLE, greatest(0.0::DOUBLE, v)) < 240)::INT AS ink FROM w""")
def q_flat_field_1d(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = A.flat_field(events(spark, sf_dir), ["user_id"], ["us", "event_id"], "value", 3)
    return e.select("event_id", F.round("level", 6).alias("level"), (F.col("level") < 240).cast("int").alias("ink"))


WEIGHTED = """WITH b AS (SELECT lang, count(*) AS total, count(quality) AS n, count(CASE WHEN quality = 1 THEN 1 END) AS ok FROM documents LEFT JOIN labels USING (doc_id) GROUP BY lang),
s AS (SELECT *, total / sum(total) OVER ()::DOUBLE AS share, ok / nullif(n, 0)::DOUBLE AS rate FROM b)
"""


def _weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang").join(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id", "left")
    return A.share_weighted(docs, "lang", F.col("quality").isNotNull(), F.col("quality") == 1)


@query(WEIGHTED + "SELECT round(sum(CASE WHEN n > 0 THEN rate * share END) / sum(CASE WHEN n > 0 THEN share END), 6) AS weighted, sum(n)::BIGINT AS n FROM s")
def q_weighted_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    by = _weighted(spark, sf_dir)
    return by.agg(F.round(A.weighted_mean(by), 6).alias("weighted"), F.sum("n").alias("n"))


@query(WEIGHTED + "SELECT lang, total, n, ok, round(share, 6) AS share, round(rate, 6) AS rate FROM s")
def q_share_of_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _weighted(spark, sf_dir).select("lang", "total", "n", "ok", F.round("share", 6).alias("share"), F.round("rate", 6).alias("rate"))


@query("""WITH f AS (SELECT doc_id, CASE WHEN n_chars > 3000 THEN 1 END AS found FROM documents),
j AS (SELECT CASE WHEN toxic = 1 THEN 1 END AS truth, found FROM labels JOIN f USING (doc_id))
SELECT round(count(CASE WHEN truth IS NOT DISTINCT FROM found THEN 1 END) / count(*)::DOUBLE, 6) AS overall,
round(count(CASE WHEN (truth IS NULL) = (found IS NULL) THEN 1 END) / count(*)::DOUBLE, 6) AS presence,
round(count(CASE WHEN truth IS NOT NULL AND truth IS NOT DISTINCT FROM found THEN 1 END) / nullif(count(truth), 0)::DOUBLE, 6) AS identity,
round(count(CASE WHEN truth IS NULL AND found IS NOT NULL THEN 1 END) / nullif(count(CASE WHEN truth IS NULL THEN 1 END), 0)::DOUBLE, 6) AS spurious FROM j""")
def q_detection_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = table(spark, sf_dir, "documents").select("doc_id", F.when(F.col("n_chars") > 3000, 1).alias("found"))
    j = table(spark, sf_dir, "labels").select("doc_id", F.when(F.col("toxic") == 1, 1).alias("truth")).join(found, "doc_id")
    return j.agg(*A.detection(F.col("truth"), F.col("found")))


@query("""SELECT o_orderpriority, count(*) AS n, count(CASE WHEN o_totalprice > 1000 THEN 1 END) AS ok,
round(100 * count(CASE WHEN o_totalprice > 1000 THEN 1 END) / count(*)::DOUBLE, 6) AS pct,
100 * count(CASE WHEN o_totalprice > 1000 THEN 1 END) / count(*)::DOUBLE >= 95 - 1e-9 AS pass FROM orders GROUP BY o_orderpriority""")
def q_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    by = table(spark, sf_dir, "orders").groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("o_totalprice") > 1000, 1)).alias("ok"))
    return by.select("*", F.round(100 * F.col("ok") / F.col("n"), 6).alias("pct"), A.gate(F.col("ok"), F.col("n"), 95.0).alias("pass"))


@query("SELECT l_returnflag, count(*) AS n, count(CASE WHEN l_linestatus = 'O' THEN 1 END) AS ok, grouping(l_returnflag)::INT AS total FROM lineitem GROUP BY GROUPING SETS ((l_returnflag), ())")
def q_group_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").rollup("l_returnflag").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("l_linestatus") == "O", 1)).alias("ok"), F.grouping("l_returnflag").cast("int").alias("total"))


@query("WITH s AS (SELECT conv_id, string_agg(left(role, 1), '' ORDER BY turn, role) AS shape FROM conversations GROUP BY conv_id) SELECT shape, count(*) AS n FROM s GROUP BY shape")
def q_shape_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role")
    shape = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "role"))), lambda s: F.left(s["role"], F.lit(1))), "")
    return turns.groupBy("conv_id").agg(shape.alias("shape")).groupBy("shape").agg(F.count(F.lit(1)).alias("n"))


@query("""WITH l AS (SELECT chr(x::INT) AS letter FROM range(97, 123) t(x)), d AS (SELECT lower(text) AS t FROM documents)
SELECT letter, count(CASE WHEN contains(t, letter) THEN 1 END) AS n, count(CASE WHEN contains(t, letter) THEN 1 END) < 50 AS uncovered FROM l, d GROUP BY letter""")
def q_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    # the letters are columns, so every text is read once and nothing is joined
    letters = [chr(c) for c in range(97, 123)]
    docs = table(spark, sf_dir, "documents").select(F.lower("text").alias("t"))
    counts = docs.agg(*[F.count(F.when(F.contains("t", F.lit(c)), 1)).alias(c) for c in letters])
    rows = counts.select(F.explode(F.array(*[F.struct(F.lit(c).alias("letter"), F.col(c).alias("n")) for c in letters])).alias("r")).select("r.*")
    return rows.withColumn("uncovered", F.col("n") < 50)


@query("WITH r AS (SELECT source, row_number() OVER (ORDER BY source) - 1 AS idx, n FROM (SELECT source, count(*) AS n FROM documents GROUP BY source)) SELECT source, idx::INT AS idx, n FROM r")
def q_label_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct sorted labels with their index; the window runs over the labels, of which there are few."""
    by = table(spark, sf_dir, "documents").groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    return by.select("source", (F.row_number().over(W.orderBy("source")) - 1).alias("idx"), "n")


@query("SELECT label, vec_id // 256 AS page, count(*) AS n, string_agg(vec_id::VARCHAR, ',' ORDER BY vec_id) AS members FROM embeddings GROUP BY label, page")
def q_group_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The members of each label in pages of bounded length, so no row grows with the table."""
    members = F.array_join(F.array_sort(F.collect_list("vec_id")), ",")
    return table(spark, sf_dir, "embeddings").select("vec_id", "label").groupBy("label", F.floor(F.col("vec_id") / 256).alias("page")).agg(F.count(F.lit(1)).alias("n"), members.alias("members"))


@query("SELECT l_linestatus AS status, count(*) AS n, round(100 * count(*) / (SELECT count(*) FROM lineitem)::DOUBLE, 6) AS pct FROM lineitem GROUP BY l_linestatus")
def q_status_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    by = table(spark, sf_dir, "lineitem").groupBy(F.col("l_linestatus").alias("status")).agg(F.count(F.lit(1)).alias("n"))
    return by.withColumn("pct", F.round(100 * F.col("n") / F.sum("n").over(W.partitionBy()), 6))


@query("SELECT p_brand, arg_max(p_partkey, {'v': p_retailprice, 'k': -p_partkey}) AS best, max(p_retailprice) AS price FROM part GROUP BY p_brand")
def q_argmax_reduce(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first row of the greatest value in each group: ties go to the smaller key, in one aggregation."""
    best = F.max(F.struct("p_retailprice", (-F.col("p_partkey")).alias("k")))
    return table(spark, sf_dir, "part").groupBy("p_brand").agg(best.alias("b")).select("p_brand", (-F.col("b.k")).alias("best"), F.col("b.p_retailprice").alias("price"))


@query("""SELECT n_name, round(coalesce(avg(c_acctbal) FILTER (c_acctbal BETWEEN 0 AND 1000), 255.0), 6) AS mean, min(c_acctbal) AS low, max(c_acctbal) AS high FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY n_name""")
def q_mean_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean over a range with a default where it is empty, and the extent."""
    c = table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(
        F.avg(F.when(F.col("c_acctbal").between(0, 1000), F.col("c_acctbal"))).alias("mean"), F.min("c_acctbal").alias("low"), F.max("c_acctbal").alias("high")
    )
    n = table(spark, sf_dir, "nation").join(if_small(c), F.col("n_nationkey") == F.col("c_nationkey"), "left")
    return n.select("n_name", F.round(F.coalesce("mean", F.lit(255.0)), 6).alias("mean"), "low", "high")
