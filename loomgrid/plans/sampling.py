"""Queries of draws, quotas and splits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators import sampling as S
from .registry import query, table


def draw_sql(rows: str, seed: str, i: str) -> str:
    """CTEs a .. u over rows: u holds the draw of each row."""
    times = lambda p, q: f"((({p}) * (({q}) & 65535) + ((({p}) * (({q}) >> 16)) & 65535) * 65536) & 4294967295)"
    return f"""a AS (SELECT *, ({seed} + {i} * {S.STEP}) & 4294967295 AS a FROM {rows}),
t1 AS (SELECT *, {times("xor(a, a >> 15)", "a | 1")} AS t FROM a),
t2 AS (SELECT * EXCLUDE (t), xor((t + {times("xor(t, t >> 7)", "t | 61")}) & 4294967295, t) AS t FROM t1),
u AS (SELECT * EXCLUDE (a, t), xor(t, t >> 14) / 4294967296.0::DOUBLE AS u FROM t2)"""


@query("WITH r AS (SELECT r_regionkey::BIGINT AS r_regionkey, i FROM region, range(1, 101) t(i)), " + draw_sql("r", "r_regionkey", "i") + " SELECT r_regionkey, i, round(u, 9) AS u FROM u")
def q_prng(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "region").select(F.col("r_regionkey").cast("long").alias("r_regionkey"), F.explode(F.sequence(F.lit(1).cast("long"), F.lit(100).cast("long"))).alias("i"))
    return rows.withColumn("u", F.round(S.draw(F.col("r_regionkey"), F.col("i")), 9))


@query("WITH r AS (SELECT n_nationkey, n_name, n_nationkey::BIGINT + 1 AS i FROM nation), " + draw_sql("r", "42", "i") + " SELECT n_name, row_number() OVER (ORDER BY u, n_nationkey)::INT AS place FROM u")
def q_shuffle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A permutation by draws; the window orders one dimension table."""
    rows = table(spark, sf_dir, "nation").withColumn("u", S.draw(F.lit(42), F.col("n_nationkey").cast("long") + 1))
    return rows.select("n_name", F.row_number().over(W.orderBy("u", "n_nationkey")).alias("place"))


QUOTA = """WITH s AS (SELECT o_orderpriority, count(*) AS n FROM orders GROUP BY 1),
b AS (SELECT *, floor(240 * n / sum(n) OVER ()::DOUBLE)::BIGINT AS base, row_number() OVER (ORDER BY n DESC, o_orderpriority) AS rank FROM s),
q AS (SELECT o_orderpriority, n, (base + CASE WHEN rank <= 240 - sum(base) OVER () THEN 1 ELSE 0 END)::BIGINT AS quota FROM b)
"""


@query(QUOTA + "SELECT o_orderpriority, n, quota FROM q")
def q_quota(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.quotas(table(spark, sf_dir, "orders").groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n")), "o_orderpriority", "n", 240)


@query(QUOTA + """, r AS (SELECT o_orderkey, o_orderpriority, o_orderkey AS i FROM orders), """ + draw_sql("r", "7", "i") + """,
k AS (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY u, o_orderkey) AS rn FROM u) SELECT o_orderkey, o_orderpriority FROM k JOIN q USING (o_orderpriority) WHERE rn <= quota""")
def q_stratified_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority")
    quota = S.quotas(orders.groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n")), "o_orderpriority", "n", 240)
    # a fixed filter first: no group takes more than all 240, so the ranked window keeps 240 rows a task
    ranked = orders.withColumn("u", S.draw(F.lit(7), F.col("o_orderkey"))).withColumn("rn", F.row_number().over(W.partitionBy("o_orderpriority").orderBy("u", "o_orderkey"))).where("rn <= 240")
    return ranked.join(quota, "o_orderpriority").where("rn <= quota").select("o_orderkey", "o_orderpriority")


@query("""WITH r AS (SELECT vec_id, label, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS r, count(*) OVER (PARTITION BY label) AS n, row_number() OVER (ORDER BY vec_id) AS g, count(*) OVER () AS gn FROM embeddings)
SELECT vec_id, label, CASE WHEN r <= greatest(1, floor(n * 0.25)) THEN 'test' WHEN r <= greatest(1, floor(n * 0.25)) + 30 THEN 'train' ELSE 'unused' END AS part FROM r""")
def q_head_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.head_split(table(spark, sf_dir, "embeddings").select("vec_id", "label"), ["label"], ["vec_id"], 0.25, 30)


@query("WITH r AS (SELECT event_id, event_type, event_id AS i FROM events), " + draw_sql("r", "5", "i") + " SELECT event_id, CASE WHEN u < 0.5 THEN 'view' WHEN u < 0.8 THEN event_type ELSE 'mixed' END AS picked FROM u")
def q_weighted_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = S.draw(F.lit(5), F.col("event_id"))
    return table(spark, sf_dir, "events").select("event_id", F.when(u < 0.5, "view").when(u < 0.8, F.col("event_type")).otherwise("mixed").alias("picked"))


@query("WITH r AS (SELECT event_id, value, event_id * 2 + 1 AS i FROM events), " + draw_sql("r", "11", "i") + ", r2 AS (SELECT event_id, value, u AS v, event_id * 2 + 2 AS i FROM u), "
       + draw_sql("r2", "11", "i").replace("a AS", "b AS", 1).replace("FROM a)", "FROM b)").replace("t1 AS", "s1 AS").replace("FROM t1", "FROM s1").replace("t2 AS", "s2 AS").replace("FROM t2", "FROM s2").replace("u AS (SELECT", "w AS (SELECT")
       + " SELECT event_id, round(value + 5 * sqrt(-2 * ln(greatest(v, 1e-12::DOUBLE))) * cos(2 * pi() * u), 4) AS noisy FROM w")
def q_noise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Normal noise from two draws a row."""
    v, u = S.draw(F.lit(11), F.col("event_id") * 2 + 1), S.draw(F.lit(11), F.col("event_id") * 2 + 2)
    normal = F.sqrt(-2 * F.log(F.greatest(v, F.lit(1e-12)))) * F.cos(2 * F.pi() * u)
    return table(spark, sf_dir, "events").select("event_id", F.round(F.col("value") + 5 * normal, 4).alias("noisy"))
