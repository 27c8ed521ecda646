"""Queries over ordered rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import WindowSpec
from pyspark.sql import functions as F

from ..operators import sequences as S
from .registry import query, table


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with the time as microseconds; the time has no zone, so the session's zone plays no part."""
    seconds = F.unix_date(F.to_date("ts")).cast("long") * 86_400 + F.hour("ts") * 3600 + F.minute("ts") * 60
    us = seconds * 1_000_000 + (F.extract(F.lit("SECOND"), "ts") * 1_000_000).cast("long")
    return table(spark, sf_dir, "events").select("event_id", us.alias("us"), "user_id", "event_type", "value")


E = "SELECT event_id, epoch_us(ts) AS us, user_id, event_type, value FROM events"


def by_user() -> WindowSpec:
    return W.partitionBy("user_id").orderBy("us", "event_id")


@query(f"""WITH e AS ({E}), i AS (SELECT *, us + 3600000000 AS us_end FROM e),
b AS (SELECT *, CASE WHEN us > max(us_end) OVER w + 60000000 OR max(us_end) OVER w IS NULL THEN 1 ELSE 0 END AS begins FROM i
      WINDOW w AS (PARTITION BY user_id ORDER BY us, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
g AS (SELECT *, sum(begins) OVER (PARTITION BY user_id ORDER BY us, event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS grp FROM b)
SELECT user_id, grp AS "group", min(us) AS first_us, max(us_end) AS last_us, count(*) AS n FROM g GROUP BY user_id, grp""")
def q_interval_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir).withColumn("us_end", F.col("us") + 3_600_000_000)
    return S.interval_groups(e, ["user_id"], "us", "us_end", 60_000_000, ["event_id"]).groupBy("user_id", "group").agg(F.min("us").alias("first_us"), F.max("us_end").alias("last_us"), F.count(F.lit(1)).alias("n"))


@query(f"""SELECT event_id, (row_number() OVER w - 1)::INT AS idx, coalesce(lag(event_type) OVER w = event_type, false) AS spill FROM ({E}) WINDOW w AS (PARTITION BY user_id ORDER BY us, event_id)""")
def q_spill_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).select("event_id", (F.row_number().over(by_user()) - 1).alias("idx"), F.coalesce(F.lag("event_type").over(by_user()) == F.col("event_type"), F.lit(False)).alias("spill"))


@query(f"""WITH s AS (SELECT *, sum(CASE WHEN event_type = 'signup' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY us, event_id ROWS UNBOUNDED PRECEDING) AS n FROM ({E}))
SELECT user_id, ((n + 1) // 2)::BIGINT AS span, count(*) AS n, string_agg(left(event_type, 1), '' ORDER BY us, event_id) AS types FROM s WHERE n % 2 = 1 AND event_type <> 'signup' GROUP BY user_id, (n + 1) // 2""")
def q_toggle_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = S.toggle_spans(events(spark, sf_dir), by_user(), F.col("event_type") == "signup")
    types = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("us", "event_id", "event_type"))), lambda s: F.left(s["event_type"], F.lit(1))), "")
    return spans.groupBy("user_id", "span").agg(F.count(F.lit(1)).alias("n"), types.alias("types"))


@query(f"""WITH b AS (SELECT *, CASE WHEN event_type = 'purchase' OR row_number() OVER w = 1 THEN 1 ELSE 0 END AS begins,
  CASE WHEN row_number() OVER w = 1 AND value < 0.7 * 50 THEN 'purchase' ELSE event_type END AS kind FROM ({E}) WINDOW w AS (PARTITION BY user_id ORDER BY us, event_id)),
g AS (SELECT *, sum(begins) OVER (PARTITION BY user_id ORDER BY us, event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS grp FROM b)
SELECT user_id, grp AS "group", count(*) AS n, count(CASE WHEN kind <> event_type THEN 1 END) AS forced, min(us) AS first_us FROM g GROUP BY user_id, grp""")
def q_sessionize_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    # a first row of low value is taken for the type that starts a group
    kind = F.when((F.row_number().over(by_user()) == 1) & (F.col("value") < 0.7 * 50), "purchase").otherwise(F.col("event_type"))
    e = S.flag_groups(events(spark, sf_dir).withColumn("kind", kind), by_user(), F.col("event_type") == "purchase")
    return e.groupBy("user_id", "group").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("kind") != F.col("event_type"), 1)).alias("forced"), F.min("us").alias("first_us"))


@query(f"""WITH a AS (SELECT *, last_value(CASE WHEN event_type = 'purchase' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY us, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS owner FROM ({E}))
SELECT event_id, owner FROM a WHERE event_type = 'error' AND owner IS NOT NULL""")
def q_attach_previous(spark: SparkSession, sf_dir: str) -> DataFrame:
    owner = S.attach_previous(by_user(), F.col("event_type") == "purchase", F.col("event_id"))
    return events(spark, sf_dir).withColumn("owner", owner).where("event_type = 'error' and owner is not null").select("event_id", "owner")


@query("""WITH r AS (SELECT o_orderkey, o_orderpriority, o_totalprice, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice) - 1 AS r, count(*) OVER (PARTITION BY o_orderpriority) AS n FROM orders),
m AS (SELECT o_orderpriority, o_totalprice AS med FROM r WHERE r = n // 2)
SELECT o_orderkey, o_orderpriority, o_totalprice, med AS median FROM r JOIN m USING (o_orderpriority) WHERE o_totalprice < 0.45 * med""")
def q_narrow_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", "o_totalprice")
    return orders.join(S.upper_median(orders, ["o_orderpriority"], "o_totalprice"), "o_orderpriority").where("o_totalprice < 0.45 * median").select("o_orderkey", "o_orderpriority", "o_totalprice", "median")


@query("""WITH r AS (SELECT o_orderkey, o_orderpriority, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) - 1 AS r, count(*) OVER (PARTITION BY o_orderpriority) AS n FROM orders)
SELECT o_orderkey, o_orderpriority FROM r WHERE n <= 100 OR r IN (SELECT (i * n) // 100 FROM range(0, 100) t(i))""")
def q_even_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.even_sample(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority"), ["o_orderpriority"], ["o_orderkey"], 100)


@query("SELECT arg_min(doc_id, doc_id) AS doc_id, arg_min(source, doc_id) AS source, count(*) AS copies FROM documents GROUP BY text")
def q_first_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    # grouped by a digest of the text, so that texts are not shuffled
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", F.sha2(F.col("text").cast("binary"), 256).alias("digest"))
    return S.first_wins(docs, "digest", "doc_id").drop("digest")


@query("""SELECT conv_id, arg_max(CASE WHEN role = 'user' THEN text END, CASE WHEN role = 'user' THEN turn END) AS last_user, string_agg(role, ' ' ORDER BY turn, role) AS roles FROM conversations GROUP BY conv_id""")
def q_last_nonnull(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    user = F.col("role") == "user"
    roles = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "role"))), lambda s: s["role"]), " ")
    return turns.groupBy("conv_id").agg(F.max_by(F.when(user, F.col("text")), F.when(user, F.col("turn"))).alias("last_user"), roles.alias("roles"))


@query(f"""SELECT user_id, event_id, age FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY us DESC, event_id DESC)::INT AS age FROM ({E})) WHERE age <= 3""")
def q_ring_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.tail(events(spark, sf_dir), ["user_id"], [F.desc("us"), F.desc("event_id")], 3).select("user_id", "event_id", "age")


@query(f"""SELECT event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS n FROM ({E})) WHERE n <= 6""")
def q_keep_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.tail(events(spark, sf_dir), ["event_type"], [F.asc("event_id")], 6).select("event_type", "event_id")
