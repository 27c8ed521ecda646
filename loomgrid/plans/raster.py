"""Queries over embeddings read as 8 x 8 bitmaps (ink where a component is positive)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators import raster as R
from ..operators.scanning import homographies, warped
from ..operators.sequences import interval_groups
from ..session import ship
from .registry import query, table

SIDE = 8


def masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    # every fourth cell pattern is thinned so that masks have margins and separate parts
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda v: (v > 0.12).cast("int")).alias("mask"))
    return rows.withColumn("box", R.bbox(F.col("mask"), SIDE))


M = """WITH RECURSIVE m AS (SELECT vec_id, list_transform(embedding, lambda v: CASE WHEN v > 0.12 THEN 1 ELSE 0 END) AS mask FROM embeddings),
i AS (SELECT vec_id, mask, list_filter(range(0, 64), lambda i: mask[i + 1] = 1) AS ink FROM m),
b AS (SELECT vec_id, mask, list_min(list_transform(ink, lambda i: i % 8)) AS x, list_min(list_transform(ink, lambda i: i // 8)) AS y,
  list_max(list_transform(ink, lambda i: i % 8)) - list_min(list_transform(ink, lambda i: i % 8)) + 1 AS w,
  list_max(list_transform(ink, lambda i: i // 8)) - list_min(list_transform(ink, lambda i: i // 8)) + 1 AS h, len(ink) AS n FROM i)
"""


def _bits(mask: str) -> F.Column:
    return F.array_join(mask, "")


@query(M + "SELECT vec_id, x::INT AS x, y::INT AS y, w::INT AS w, h::INT AS h, n::INT AS n FROM b")
def q_bounding_box(spark: SparkSession, sf_dir: str) -> DataFrame:
    return masks(spark, sf_dir).select("vec_id", "box.*", F.size(R.ink_cells(F.col("mask"))).alias("n"))


@query(M + """SELECT vec_id, list_reduce(list_transform(range(0, 256), lambda t: CASE WHEN n > 0
 AND trunc((t % 16) * greatest(w, h) / 16.0::DOUBLE - (greatest(w, h) - w) // 2) BETWEEN 0 AND w - 1 AND trunc((t // 16) * greatest(w, h) / 16.0::DOUBLE - (greatest(w, h) - h) // 2) BETWEEN 0 AND h - 1
 AND mask[((y + trunc((t // 16) * greatest(w, h) / 16.0::DOUBLE - (greatest(w, h) - h) // 2)) * 8 + x + trunc((t % 16) * greatest(w, h) / 16.0::DOUBLE - (greatest(w, h) - w) // 2) + 1)::INT] = 1 THEN '1' ELSE '0' END), lambda p, q: p || q) AS bits FROM b""")
def q_normalize_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = masks(spark, sf_dir).select("vec_id", R.normalised(F.col("mask"), F.col("box"), SIDE, 16).alias("m"))
    return out.select("vec_id", _bits("m").alias("bits"))


@query(M + """SELECT vec_id, list_reduce(list_transform(range(0, 144), lambda t: CASE WHEN n > 0 AND mask[((y + ((t // 12) * h) // 12) * 8 + x + ((t % 12) * w) // 12 + 1)::INT] = 1 THEN '1' ELSE '0' END), lambda p, q: p || q) AS bits FROM b""")
def q_frame_square(spark: SparkSession, sf_dir: str) -> DataFrame:
    return masks(spark, sf_dir).select("vec_id", R.stretched(F.col("mask"), F.col("box"), SIDE, 12).alias("m")).select("vec_id", _bits("m").alias("bits"))


@query(M + """, s AS (SELECT *, floor(y + h - 1 + (t.t // 12 - 10) / (9.0::DOUBLE / h) + 0.5) AS sy, floor((x + x + w - 1) / 2.0::DOUBLE + (t.t % 12 - 6) / (9.0::DOUBLE / h) + 0.5) AS sx FROM b, range(0, 144) t(t))
SELECT vec_id, string_agg(CASE WHEN n > 0 AND sx BETWEEN 0 AND 7 AND sy BETWEEN 0 AND 7 AND mask[(sy * 8 + sx + 1)::INT] = 1 THEN '1' ELSE '0' END, '' ORDER BY t) AS bits FROM s GROUP BY vec_id""")
def q_align_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = masks(spark, sf_dir).select("vec_id", R.aligned(F.col("mask"), F.col("box"), SIDE, SIDE, 12, 10, 6, 9).alias("m"))
    return out.select("vec_id", _bits("m").alias("bits"))


@query(M + """SELECT vec_id, list_sum(list_transform(range(0, 16), lambda t: mask[(t // 4 + 2) * 8 + t % 4 + 2 + 1]))::INT AS core, list_sum(mask[25:64])::INT AS lower, list_sum(mask[1:24])::INT AS top FROM b""")
def q_crop_zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ink in a fixed rectangle and in the lower and upper bands: range filters on the cells."""
    ink = R.ink_cells(F.col("mask"))
    count = lambda keep: F.size(F.filter(ink, keep))
    x, y = lambda i: i % SIDE, lambda i: F.floor(i / SIDE)
    core = count(lambda i: (x(i) >= 2) & (x(i) < 6) & (y(i) >= 2) & (y(i) < 6))
    return masks(spark, sf_dir).select("vec_id", core.alias("core"), count(lambda i: y(i) >= 3).alias("lower"), count(lambda i: y(i) < 3).alias("top"))


@query(M + """SELECT vec_id, o::INT AS orientation, string_agg(mask[(CASE o WHEN 2 THEN (t // 8) * 8 + 7 - t % 8 WHEN 3 THEN 63 - t WHEN 4 THEN (7 - t // 8) * 8 + t % 8 WHEN 5 THEN (t % 8) * 8 + t // 8
 WHEN 6 THEN (7 - t % 8) * 8 + t // 8 WHEN 7 THEN (7 - t % 8) * 8 + 7 - t // 8 WHEN 8 THEN (t % 8) * 8 + 7 - t // 8 ELSE t END + 1)::INT]::VARCHAR, '' ORDER BY t) AS bits FROM b, range(1, 9) r(o), range(0, 64) c(t) GROUP BY vec_id, o""")
def q_reorient(spark: SparkSession, sf_dir: str) -> DataFrame:
    turned = F.explode(F.array(*[F.struct(F.lit(o).alias("orientation"), R.reoriented(F.col("mask"), SIDE, SIDE, o).alias("m")) for o in range(1, 9)]))
    return masks(spark, sf_dir).select("vec_id", turned.alias("t")).select("vec_id", "t.orientation", _bits("t.m").alias("bits"))


@query("""WITH c AS (SELECT vec_id, t, t % 8 AS x, t // 8 AS y, round(128 + 100 * embedding[t + 1]::DOUBLE, 6) AS v FROM embeddings, range(0, 64) r(t)),
m AS (SELECT a.vec_id, a.t, a.v, sum(b.v) / count(*) AS mean FROM c a JOIN c b ON a.vec_id = b.vec_id AND abs(a.x - b.x) <= 2 AND abs(a.y - b.y) <= 2 GROUP BY a.vec_id, a.t, a.v)
SELECT vec_id, round(sum(least(255.0::DOUBLE, greatest(0.0::DOUBLE, v - mean + 255))), 4) AS total, count(CASE WHEN least(255.0::DOUBLE, v - mean + 255) < 250 THEN 1 END)::INT AS ink FROM m GROUP BY vec_id""")
def q_flat_field_2d(spark: SparkSession, sf_dir: str) -> DataFrame:
    grey = F.transform("embedding", lambda v: F.round(128 + 100 * v.cast("double"), 6))
    rows = table(spark, sf_dir, "embeddings").select("vec_id", R.levelled(grey, SIDE, SIDE, 2).alias("l"))
    return rows.select("vec_id", F.round(F.aggregate("l", F.lit(0.0), lambda a, v: a + v), 4).alias("total"), F.size(F.filter("l", lambda v: v < 250)).alias("ink"))


@query("""WITH m AS (SELECT vec_id, t % 8 AS x, t // 8 AS y, CASE WHEN embedding[t + 1] > 0.12 THEN 1 ELSE 0 END AS v FROM embeddings, range(0, 64) r(t)),
n AS (SELECT a.vec_id, a.x, a.y, max(b.v) AS g, min(b.v) AS s FROM m a JOIN m b ON a.vec_id = b.vec_id AND abs(a.x - b.x) <= 1 AND abs(a.y - b.y) <= 1 GROUP BY a.vec_id, a.x, a.y)
SELECT vec_id, sum(g)::INT AS grown, sum(s)::INT AS shrunk FROM n GROUP BY vec_id""")
def q_morphology(spark: SparkSession, sf_dir: str) -> DataFrame:
    total = lambda grow: F.aggregate(R.morphed(F.col("mask"), SIDE, SIDE, grow), F.lit(0), lambda a, v: a + v)
    return masks(spark, sf_dir).select("vec_id", total(True).alias("grown"), total(False).alias("shrunk"))


def _components_sql(near: str, least: int) -> str:
    return f"""WITH RECURSIVE c AS (SELECT vec_id, t::INT AS t, (t % 8)::INT AS x, (t // 8)::INT AS y FROM embeddings, range(0, 64) r(t) WHERE embedding[t + 1] > 0.12),
r AS (SELECT vec_id, t, x, y, t AS root FROM c UNION SELECT c.vec_id, c.t, c.x, c.y, r.root FROM r JOIN c ON r.vec_id = c.vec_id AND {near}),
l AS (SELECT vec_id, t, x, y, min(root) AS root FROM r GROUP BY vec_id, t, x, y),
g AS (SELECT vec_id, root, min(x) AS x, min(y) AS y, max(x) - min(x) + 1 AS w, max(y) - min(y) + 1 AS h, count(*)::INT AS pixels FROM l GROUP BY vec_id, root HAVING count(*) >= {least}),
k AS (SELECT vec_id, (row_number() OVER (PARTITION BY vec_id ORDER BY root) - 1)::INT AS component, x, y, w, h, pixels FROM g)
"""


EIGHT, FOUR = "abs(r.x - c.x) <= 1 AND abs(r.y - c.y) <= 1", "abs(r.x - c.x) + abs(r.y - c.y) <= 1"


@query(_components_sql(EIGHT, 2) + "SELECT vec_id, component, x, y, w, h, pixels FROM k")
def q_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.components(masks(spark, sf_dir), "vec_id", "mask", SIDE, 2).withColumnRenamed("id", "vec_id")


@query(_components_sql(FOUR, 3) + "SELECT vec_id, component, x, y, w, h, pixels FROM k")
def q_components_four(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.components(masks(spark, sf_dir), "vec_id", "mask", SIDE, 3, diagonal=False).withColumnRenamed("id", "vec_id")


@query(_components_sql(EIGHT, 1) + """, s AS (SELECT *, CASE WHEN max(x + w - 1) OVER p IS NULL OR x > max(x + w - 1) OVER p THEN 1 ELSE 0 END AS begins FROM k WINDOW p AS (PARTITION BY vec_id ORDER BY x, component ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
q AS (SELECT *, (sum(begins) OVER (PARTITION BY vec_id ORDER BY x, component ROWS UNBOUNDED PRECEDING) - 1)::INT AS region FROM s),
b AS (SELECT *, first_value(component) OVER o AS bc, first_value(x) OVER o AS bx, first_value(y) OVER o AS by_, first_value(w) OVER o AS bw, first_value(h) OVER o AS bh FROM q WINDOW o AS (PARTITION BY vec_id, region ORDER BY pixels DESC, x, component))
SELECT vec_id, region, component, CASE WHEN component = bc THEN 'base' WHEN y + h <= by_ THEN 'superposed' WHEN y >= by_ + bh THEN 'underposed' WHEN x >= bx + bw THEN 'right' ELSE 'unknown' END AS role FROM b""")
def q_segment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components to characters from left to right, and each component's place relative to the largest."""
    parts = R.components(masks(spark, sf_dir), "vec_id", "mask", SIDE, 1).withColumn("right", F.col("x") + F.col("w") - 1)
    parts = interval_groups(parts, ["id"], "x", "right", 0, ["component"]).withColumn("region", (F.col("group") - 1).cast("int"))
    own = F.struct("component", "x", "y", "w", "h")
    base = F.first(own).over(W.partitionBy("id", "region").orderBy(F.desc("pixels"), "x", "component"))
    parts = parts.withColumn("c", own).withColumn("base", base)
    return parts.select(F.col("id").alias("vec_id"), "region", "component", R.role("c", "base").alias("role"))


@query("""WITH p AS (SELECT vec_id, embedding[1]::DOUBLE * 10 AS x, embedding[2]::DOUBLE * 10 AS y FROM embeddings),
v AS (SELECT * FROM (VALUES (0, -1.5, -1.0), (1, 1.5, -1.2), (2, 1.0, 1.3), (3, 0.0, 0.2), (4, -1.2, 1.1)) t(i, x, y)),
e AS (SELECT a.x::DOUBLE AS x1, a.y::DOUBLE AS y1, b.x::DOUBLE AS x2, b.y::DOUBLE AS y2 FROM v a JOIN v b ON b.i = (a.i + 1) % 5)
SELECT vec_id, count(CASE WHEN (e.y1 > p.y) <> (e.y2 > p.y) AND p.x < (e.x2 - e.x1) * (p.y - e.y1) / (e.y2 - e.y1) + e.x1 THEN 1 END) % 2 = 1 AS inside FROM p, e GROUP BY vec_id""")
def q_point_in_polygon(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Even-odd rule against a fixed polygon, as one expression without a join."""
    corners = [(-1.5, -1.0), (1.5, -1.2), (1.0, 1.3), (0.0, 0.2), (-1.2, 1.1)]
    x, y = F.get("embedding", F.lit(0)).cast("double") * 10, F.get("embedding", F.lit(1)).cast("double") * 10
    crossings = F.lit(0)
    for (x1, y1), (x2, y2) in zip(corners, corners[1:] + corners[:1], strict=True):
        crosses = ((F.lit(y1) > y) != (F.lit(y2) > y)) & (x < (x2 - x1) * (y - y1) / (y2 - y1) + x1)
        crossings = crossings + crosses.cast("int")
    return table(spark, sf_dir, "embeddings").select("vec_id", (crossings % 2 == 1).alias("inside"))


CORNERS = np.array([(0, 0), (7, 0), (7, 7), (0, 7)], dtype=float)


@query()
def q_homography(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four point pairs to a projective map (an 8 x 8 system per row), and the projection of the centre."""

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            to = CORNERS + np.stack(batch["embedding"].to_numpy())[:, :8].reshape(-1, 4, 2)
            p = homographies(to, CORNERS) @ np.array([3.5, 3.5, 1])
            yield pd.DataFrame({"vec_id": batch["vec_id"], "px": (p[:, 0] / p[:, 2]).round(6), "py": (p[:, 1] / p[:, 2]).round(6)})

    ship(spark)
    return table(spark, sf_dir, "embeddings").select("vec_id", "embedding").mapInPandas(solve, "vec_id long, px double, py double")


@query()
def q_warp(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each bitmap set straight by the map of its own corners: bilinear samples, white outside."""

    def straighten(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            e = np.stack(batch["embedding"].to_numpy()).astype(float)
            grey = warped((128 + 100 * e).reshape(-1, SIDE, SIDE), homographies(CORNERS + e[:, :8].reshape(-1, 4, 2), CORNERS))
            flat = grey.reshape(len(e), -1)
            yield pd.DataFrame({"vec_id": batch["vec_id"], "mean": flat.mean(axis=1).round(4), "low": flat.min(axis=1).round(4), "high": flat.max(axis=1).round(4)})

    ship(spark)
    return table(spark, sf_dir, "embeddings").select("vec_id", "embedding").mapInPandas(straighten, "vec_id long, mean double, low double, high double")
