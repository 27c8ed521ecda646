"""Queries of single operators: cropping with fill, soft blur, turning, speckle, corners, splits, nesting, bit strips."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import raster as R
from ..operators import sampling as S
from ..operators import sequences as Q
from .raster import M, SIDE, _bits, masks
from .registry import query, table
from .sampling import draw_sql

#: The cropping window and the turn in degrees.
LEFT, UPPER, SIZE, DEGREES = -2, 3, 8, 20
_COS, _SIN = math.cos(math.radians(DEGREES)), math.sin(math.radians(DEGREES))


@query(M + f"""SELECT vec_id, string_agg(CASE WHEN t % {SIZE} + ({LEFT}) BETWEEN 0 AND 7 AND t // {SIZE} + {UPPER} BETWEEN 0 AND 7 THEN mask[(t // {SIZE} + {UPPER}) * 8 + t % {SIZE} + ({LEFT}) + 1] ELSE 0 END::VARCHAR, '' ORDER BY t) AS bits
FROM m, range(0, {SIZE * SIZE}) r(t) GROUP BY vec_id""")
def q_crop_rebased(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A window of the mask with its own origin; cells outside the mask are empty."""
    return masks(spark, sf_dir).select("vec_id", _bits(R.cropped(F.col("mask"), SIDE, SIDE, LEFT, UPPER, SIZE, SIZE)).alias("bits"))


@query("""WITH c AS (SELECT vec_id, t % 8 AS x, t // 8 AS y, floor(128 + 100 * embedding[t + 1]::DOUBLE)::INT AS v FROM embeddings, range(0, 64) r(t)),
m AS (SELECT a.vec_id, a.x, a.y, avg(b.v) AS v FROM c a JOIN c b ON a.vec_id = b.vec_id AND abs(a.x - b.x) <= 1 AND abs(a.y - b.y) <= 1 GROUP BY a.vec_id, a.x, a.y)
SELECT vec_id, round(sum(v), 2) AS total, round(max(v), 3) AS high, round(min(v), 3) AS low FROM m GROUP BY vec_id""")
def q_soft_blur(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mean of the 3 x 3 cells inside the image, edge cells having fewer."""
    grey = F.transform("embedding", lambda v: F.floor(128 + 100 * v.cast("double")))
    rows = table(spark, sf_dir, "embeddings").select("vec_id", R.softened(grey, SIDE, SIDE).alias("s"))
    return rows.select("vec_id", F.round(F.aggregate("s", F.lit(0.0), lambda a, v: a + v), 2).alias("total"), F.round(F.array_max("s"), 3).alias("high"), F.round(F.array_min("s"), 3).alias("low"))


@query(M + f""", s AS (SELECT vec_id, mask, t, floor(3.5::DOUBLE + {_COS!r}::DOUBLE * (t % 8 - 3.5::DOUBLE) + {_SIN!r}::DOUBLE * (t // 8 - 3.5::DOUBLE) + 0.5::DOUBLE)::INT AS sx, floor(3.5::DOUBLE - {_SIN!r}::DOUBLE * (t % 8 - 3.5::DOUBLE) + {_COS!r}::DOUBLE * (t // 8 - 3.5::DOUBLE) + 0.5::DOUBLE)::INT AS sy FROM m, range(0, 64) r(t))
SELECT vec_id, string_agg(CASE WHEN sx BETWEEN 0 AND 7 AND sy BETWEEN 0 AND 7 THEN mask[sy * 8 + sx + 1] ELSE 0 END::VARCHAR, '' ORDER BY t) AS bits FROM s GROUP BY vec_id""")
def q_turned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mask turned around its centre by a fixed angle, nearest cells."""
    return masks(spark, sf_dir).select("vec_id", _bits(R.turned(F.col("mask"), SIDE, SIDE, DEGREES)).alias("bits"))


@query("WITH r AS (SELECT vec_id, cell, CASE WHEN embedding[cell + 1] > 0.12 THEN 1 ELSE 0 END AS v, vec_id * 64 + cell + 1 AS i FROM embeddings, range(0, 64) c(cell)), " + draw_sql("r", "9", "i")
       + " SELECT vec_id, string_agg(CASE WHEN u < 0.05::DOUBLE THEN 1 - v ELSE v END::VARCHAR, '' ORDER BY cell) AS bits, count(CASE WHEN u < 0.05::DOUBLE THEN 1 END)::INT AS flipped FROM u GROUP BY vec_id")
def q_speckle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One cell in twenty turned over by uniform draws of its own."""
    draws = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda t: S.draw(F.lit(9), F.col("vec_id") * 64 + t + 1) < 0.05)
    rows = masks(spark, sf_dir).select("vec_id", "mask", draws.alias("hit"))
    flipped = F.zip_with("mask", "hit", lambda v, h: F.when(h, 1 - v).otherwise(v))
    return rows.select("vec_id", _bits(flipped).alias("bits"), F.size(F.filter("hit", lambda h: h)).alias("flipped"))


@query("""WITH p AS (SELECT vec_id, i::INT AS i, embedding[2 * i + 1]::DOUBLE AS x, embedding[2 * i + 2]::DOUBLE AS y FROM embeddings, range(0, 32) r(i)),
a AS (SELECT vec_id, min({'s': x + y, 'i': i}) AS f FROM p GROUP BY vec_id),
o AS (SELECT p.vec_id, p.x AS ox, p.y AS oy, p.i AS oi FROM p JOIN a ON a.vec_id = p.vec_id AND a.f.i = p.i),
far AS (SELECT p.vec_id, max({'d': (x - ox) * (x - ox) + (y - oy) * (y - oy), 'i': -i}) AS f FROM p JOIN o USING (vec_id) GROUP BY p.vec_id),
d AS (SELECT p.vec_id, p.x AS fx, p.y AS fy, p.i AS fi FROM p JOIN far ON far.vec_id = p.vec_id AND -far.f.i = p.i),
c AS (SELECT p.vec_id, p.i, (fx - ox) * (p.y - oy) - (fy - oy) * (p.x - ox) AS cross_ FROM p JOIN o USING (vec_id) JOIN d USING (vec_id))
SELECT c.vec_id, any_value(oi) AS origin, any_value(fi) AS opposite, -max({'c': cross_, 'i': -c.i}).i AS first_side, min({'c': cross_, 'i': c.i}).i AS other_side FROM c JOIN o USING (vec_id) JOIN d USING (vec_id) GROUP BY c.vec_id""")
def q_corner_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Corners of 32 points: the upper left one, the one farthest from it, and on either side of their line the one
    with the largest cross product; ties to the earlier point."""
    point = lambda i: F.struct(i.alias("i"), F.get("embedding", 2 * i).cast("double").alias("x"), F.get("embedding", 2 * i + 1).cast("double").alias("y"))
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.transform(F.sequence(F.lit(0), F.lit(31)), point).alias("p"))
    least = lambda f: F.array_min(F.transform("p", lambda q: F.struct(f(q).alias("v"), q["i"].alias("i"), q["x"].alias("x"), q["y"].alias("y"))))
    rows = rows.withColumn("o", least(lambda q: q["x"] + q["y"]))
    rows = rows.withColumn("f", least(lambda q: -((q["x"] - F.col("o.x")) * (q["x"] - F.col("o.x")) + (q["y"] - F.col("o.y")) * (q["y"] - F.col("o.y")))))
    cross = lambda q: (F.col("f.x") - F.col("o.x")) * (q["y"] - F.col("o.y")) - (F.col("f.y") - F.col("o.y")) * (q["x"] - F.col("o.x"))
    return rows.select("vec_id", F.col("o.i").alias("origin"), F.col("f.i").alias("opposite"), least(lambda q: -cross(q))["i"].alias("first_side"), least(cross)["i"].alias("other_side"))


@query("""SELECT 'large' AS part, l_returnflag, count(*) AS n, sum(l_orderkey)::BIGINT AS keys FROM lineitem WHERE l_quantity > 25 GROUP BY l_returnflag
UNION ALL SELECT 'rest', l_returnflag, count(*), sum(l_orderkey)::BIGINT FROM lineitem WHERE (l_quantity > 25) IS NOT TRUE GROUP BY l_returnflag""")
def q_partition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that meet a condition and all others, as two tables that together are the whole."""
    large, rest = Q.partitioned(table(spark, sf_dir, "lineitem").select("l_returnflag", "l_orderkey", "l_quantity"), F.col("l_quantity") > 25)
    by = lambda df, name: df.groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"), F.sum("l_orderkey").alias("keys")).withColumn("part", F.lit(name))
    return by(large, "large").unionByName(by(rest, "rest"))


@query("WITH r AS (SELECT o_orderkey, o_orderkey AS i FROM orders), " + draw_sql("r", "13", "i") + """, k AS (SELECT o_orderkey, row_number() OVER (ORDER BY u, o_orderkey) AS place, count(*) OVER () AS n FROM u)
SELECT o_orderkey, CASE WHEN place <= greatest(1, floor(n * 0.2::DOUBLE)) THEN 'test' ELSE 'train' END AS part FROM k""")
def q_global_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first fifth of all rows in drawn order is the test part; the boundary is found without sorting all in one task."""
    rows = table(spark, sf_dir, "orders").select("o_orderkey").withColumn("u", S.draw(F.lit(13), F.col("o_orderkey")))
    return S.global_split(rows, "u", "o_orderkey", 0.2).select("o_orderkey", "part")


@query("""SELECT event_id, '{' || concat_ws(',', CASE WHEN event_type <> 'view' THEN '"type":"' || event_type || '"' END, CASE WHEN value > 50 THEN '"level":' || floor(value)::BIGINT END,
CASE WHEN user_id % 3 > 0 THEN '"ca":{"perspective":"P' || (user_id % 3) || '"}' END) || '}' AS spec FROM events""")
def q_nest_defined(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A record without its undefined fields, the perspective nested one level down."""
    perspective = F.when(F.col("user_id") % 3 > 0, F.struct(F.concat(F.lit("P"), (F.col("user_id") % 3).cast("string")).alias("perspective")))
    fields = F.struct(F.nullif("event_type", F.lit("view")).alias("type"), F.when(F.col("value") > 50, F.floor("value")).alias("level"), perspective.alias("ca"))
    return table(spark, sf_dir, "events").select("event_id", F.to_json(fields).alias("spec"))


@query("""WITH g AS (SELECT vec_id, list_transform(embedding, lambda v: round(128 + 100 * v::DOUBLE, 6)) AS g FROM embeddings),
w AS (SELECT vec_id, g, list_max(g[1:8]) AS white FROM g),
b AS (SELECT vec_id, list_transform(range(0, 8), lambda k: CASE WHEN g[9 + k] < 0.9::DOUBLE * white THEN 1 ELSE 0 END) AS b FROM w)
SELECT vec_id, list_reduce(list_transform(b, lambda x: x::VARCHAR), lambda p, q: p || q) AS bits, nullif(list_sum(list_transform(range(0, 8), lambda k: b[k + 1] << (7 - k)))::INT, 0) AS number FROM b""")
def q_read_bitstrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bits of a strip of cells: dark against the white of the strip beside it; no bit set reads as null."""
    grey = F.transform("embedding", lambda v: F.round(128 + 100 * v.cast("double"), 6))
    rows = table(spark, sf_dir, "embeddings").select("vec_id", T.read_bits(F.slice(grey, 9, 8), F.slice(grey, 1, 8), 0.9).alias("b"))
    return rows.select("vec_id", F.array_join("b", "").alias("bits"), T.from_bits(F.col("b")).alias("number"))


@query("""SELECT doc_id, string_agg(CASE c WHEN 'a' THEN 'á' WHEN 'e' THEN 'é' WHEN 'i' THEN 'í' WHEN 'o' THEN 'ó' WHEN 'u' THEN 'ú' WHEN 'ä' THEN 'â' WHEN 'ë' THEN 'ê' WHEN 'ö' THEN 'ô' WHEN 'ü' THEN 'û' ELSE c END, '' ORDER BY i) AS stressed
FROM (SELECT doc_id, unnest(string_split(left(split_part(lower(text), ' ', 1), 12), '')) AS c, generate_subscripts(string_split(left(split_part(lower(text), ' ', 1), 12), ''), 1) AS i FROM documents) GROUP BY doc_id""")
def q_stress_accent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vowels of the first word of each text with the accent of a stressed syllable."""
    word = F.left(F.split_part(F.lower("text"), F.lit(" "), F.lit(1)), F.lit(12))
    return table(spark, sf_dir, "documents").select("doc_id", T.stress_accent(word).alias("stressed")).where("stressed != ''")
