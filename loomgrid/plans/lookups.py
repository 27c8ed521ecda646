"""Queries of lookups, merges and audits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators import lookups as L
from ..operators.common import if_small
from .registry import query, table


@query("""WITH o AS (SELECT o_custkey, count(*) AS n, sum(o_totalprice) AS total FROM orders WHERE o_totalprice > 300000 GROUP BY o_custkey)
SELECT c_custkey, coalesce(n, 0) AS n, round(coalesce(total, 0.0), 2) AS total FROM customer LEFT JOIN o ON c_custkey = o_custkey""")
def q_left_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").where("o_totalprice > 300000").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("n"), F.sum("o_totalprice").alias("total"))
    return L.left_default(table(spark, sf_dir, "customer").select("c_custkey"), o, "c_custkey", {"n": 0, "total": 0.0}).withColumn("total", F.round("total", 2))


@query("""WITH m AS (SELECT coalesce(CASE quality WHEN 1 THEN 'good' WHEN 0 THEN 'bad' END, 'unchecked') AS status FROM documents LEFT JOIN labels USING (doc_id))
SELECT status, count(*) AS n, round(100 * count(*) / sum(count(*)) OVER ()::DOUBLE, 6) AS pct FROM m GROUP BY status""")
def q_merge_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = table(spark, sf_dir, "documents").select("doc_id", F.lit("unchecked").alias("status"))
    new = table(spark, sf_dir, "labels").select("doc_id", F.when(F.col("quality") == 1, "good").when(F.col("quality") == 0, "bad").alias("status"))
    by = L.merge_update(base, new, "doc_id", ["status"]).groupBy("status").agg(F.count(F.lit(1)).alias("n"))
    return by.withColumn("pct", F.round(100 * F.col("n") / F.sum("n").over(W.partitionBy()), 6))


@query("""WITH x AS (SELECT p_partkey, max(p_retailprice) AS price FROM part WHERE p_partkey % 3 = 0 GROUP BY p_partkey),
g AS (SELECT p_brand, min(p_retailprice) AS price FROM part WHERE p_size <= 25 GROUP BY p_brand)
SELECT p.p_partkey, p.p_brand, coalesce(x.price, g.price) AS price, CASE WHEN x.price IS NOT NULL THEN 'exact' WHEN g.price IS NOT NULL THEN 'general' ELSE 'none' END AS found
FROM part p LEFT JOIN x USING (p_partkey) LEFT JOIN g USING (p_brand)""")
def q_fallback_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    exact = part.where("p_partkey % 3 = 0").groupBy("p_partkey").agg(F.max("p_retailprice").alias("price"))
    general = part.where("p_size <= 25").groupBy("p_brand").agg(F.min("p_retailprice").alias("price"))
    return L.lookup_with_fallback(part.select("p_partkey", "p_brand"), exact, "p_partkey", if_small(general), "p_brand", "price")


@query("SELECT n_regionkey, arg_max(n_name, n_nationkey) AS n_name, count(*) AS n_keys FROM nation GROUP BY n_regionkey")
def q_invert_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.invert(table(spark, sf_dir, "nation"), "n_name", "n_regionkey", "n_nationkey")


@query("SELECT string_agg(n_nationkey::VARCHAR || '=' || n_name, ',' ORDER BY n_nationkey) AS forward, string_agg(n_name || '=' || n_nationkey::VARCHAR, ',' ORDER BY n_name) AS reverse FROM nation")
def q_two_way_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forward and reverse map of a dimension, each listed in the order of its keys."""
    n = table(spark, sf_dir, "nation").agg(F.map_from_entries(F.collect_list(F.struct("n_nationkey", "n_name"))).alias("f"), F.map_from_entries(F.collect_list(F.struct("n_name", "n_nationkey"))).alias("r"))
    listed = lambda m: F.array_join(F.transform(F.array_sort(F.map_entries(m)), lambda e: F.concat_ws("=", e["key"].cast("string"), e["value"].cast("string"))), ",")
    return n.select(listed("f").alias("forward"), listed("r").alias("reverse"))


@query("""WITH e AS (SELECT event_id, nullif(event_type, 'view') AS a, CASE WHEN value > 50 THEN 'high' END AS b FROM events),
k AS (SELECT * FROM (VALUES ('click', 'high', 1), ('click', NULL, 2), (NULL, 'high', 3), (NULL, NULL, 4), ('error', NULL, 5)) t(a, b, code))
SELECT event_id, coalesce(code, 0) AS code FROM e LEFT JOIN k ON e.a IS NOT DISTINCT FROM k.a AND e.b IS NOT DISTINCT FROM k.b""")
def q_composite_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id", F.nullif("event_type", F.lit("view")).alias("a"), F.when(F.col("value") > 50, "high").alias("b"))
    codes = spark.createDataFrame([("click", "high", 1), ("click", None, 2), (None, "high", 3), (None, None, 4), ("error", None, 5)], "a string, b string, code int")
    key = L.composite_key(F.col("a"), F.col("b")).alias("key")
    return e.select("event_id", key).join(F.broadcast(codes.select(key, "code")), "key", "left").select("event_id", F.coalesce("code", F.lit(0)).alias("code"))


@query("""SELECT p_brand, min(CASE WHEN p_size % 2 = 0 THEN p_name END) AS structural, max(CASE WHEN p_size % 2 = 1 THEN p_name END) AS alias FROM part GROUP BY p_brand HAVING structural IS NOT NULL AND alias IS NOT NULL""")
def q_alias_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names that share a value: the first of one kind with the last of the other, both present."""
    by = table(spark, sf_dir, "part").groupBy("p_brand").agg(F.min(F.when(F.col("p_size") % 2 == 0, F.col("p_name"))).alias("structural"), F.max(F.when(F.col("p_size") % 2 == 1, F.col("p_name"))).alias("alias"))
    return by.where("structural is not null and alias is not null")


@query("""WITH t AS (SELECT conv_id, turn, string_split(text, ' ') AS a, string_split(lead(text) OVER (PARTITION BY conv_id ORDER BY turn, role), ' ') AS b FROM conversations)
SELECT conv_id, turn, len(a)::INT AS n, list_sum(list_transform(range(1, len(a) + 1), lambda i: CASE WHEN i <= len(b) AND a[i] = b[i] THEN 1 ELSE 0 END))::INT AS same, len(a) = len(b) AS aligned FROM t WHERE b IS NOT NULL""")
def q_zip_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of consecutive turns compared place by place; aligned says whether the lengths agree."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.split("text", " ").alias("a"), F.split(F.lead("text").over(W.partitionBy("conv_id").orderBy("turn", "role")), " ").alias("b"))
    pairs = F.zip_with("a", "b", lambda x, y: F.when(x == y, 1).otherwise(0))
    same = F.aggregate(pairs, F.lit(0), lambda s, x: s + x)
    return turns.where("b is not null").select("conv_id", "turn", F.size("a").alias("n"), same.alias("same"), (F.size("a") == F.size("b")).alias("aligned"))


@query("""WITH r AS (SELECT * FROM (VALUES ('low', 1::BIGINT, 100::BIGINT), ('mid', 101, 1000), ('high', 100001, 100100), ('zero', -5, 5)) t(name, low, high)),
h AS (SELECT name, low, high, count(DISTINCT c_custkey) AS actual, count(c_custkey) AS rows FROM r LEFT JOIN customer ON c_custkey BETWEEN low AND high GROUP BY name, low, high)
SELECT name, high - low + 1 AS expected, actual, high - low + 1 - actual AS missing, CASE WHEN actual < high - low + 1 THEN 'GAP' WHEN rows > high - low + 1 THEN 'EXCESS' ELSE 'OK' END AS status FROM h""")
def q_range_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranges = spark.createDataFrame([("low", 1, 100), ("mid", 101, 1000), ("high", 100001, 100100), ("zero", -5, 5)], "name string, low long, high long")
    return L.range_audit(table(spark, sf_dir, "customer"), "c_custkey", ranges)


@query("""SELECT r_name, n_name, size, 'grid' AS family FROM region, nation, (VALUES (1), (2), (3)) t(size)
UNION ALL SELECT r_name, NULL, 0, 'bare' FROM region""")
def q_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cartesian grid of dimensions of a few rows, and the union of two families."""
    sizes = spark.createDataFrame([(1,), (2,), (3,)], "size int")
    region = table(spark, sf_dir, "region").select("r_name")
    grid = region.crossJoin(if_small(table(spark, sf_dir, "nation").select("n_name"))).crossJoin(F.broadcast(sizes)).withColumn("family", F.lit("grid"))
    return grid.unionByName(region.select("r_name", F.lit(None).cast("string").alias("n_name"), F.lit(0).alias("size"), F.lit("bare").alias("family")))


@query("""SELECT r_name, string_agg(DISTINCT left(n_name, 1), '' ORDER BY left(n_name, 1)) AS marks, count(*) AS n FROM region JOIN nation ON r_regionkey = n_regionkey GROUP BY r_name""")
def q_attach_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per base, the set of marks that attach to it."""
    j = table(spark, sf_dir, "nation").join(if_small(table(spark, sf_dir, "region")), F.col("n_regionkey") == F.col("r_regionkey"))
    return j.groupBy("r_name").agg(F.array_join(F.array_sort(F.collect_set(F.left("n_name", F.lit(1)))), "").alias("marks"), F.count(F.lit(1)).alias("n"))


@query("""SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)""")
def q_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected keys that are not present."""
    return table(spark, sf_dir, "documents").select("doc_id").join(table(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_anti")
