"""Composite queries: sources, decoding chains, record flows and a model stand-in."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..operators import heads as H
from ..operators import lookups as L
from ..operators import matching as M
from ..operators import raster as R
from ..operators import sequences as S
from ..operators.common import if_small
from ..session import ship
from ..sources import records
from . import matching, raster
from .registry import query, table
from .sequences import E, by_user, events

GROUPED = f"""WITH b AS (SELECT *, CASE WHEN event_type = 'purchase' OR row_number() OVER w = 1 THEN 1 ELSE 0 END AS begins FROM ({E}) WINDOW w AS (PARTITION BY user_id ORDER BY us, event_id)),
g AS (SELECT *, sum(begins) OVER (PARTITION BY user_id ORDER BY us, event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS grp FROM b)
"""


@query(GROUPED + """SELECT user_id, grp AS "group", arg_max(CASE WHEN event_type = 'click' THEN event_id END, CASE WHEN event_type = 'click' THEN {'us': us, 'e': event_id} END) AS click,
arg_max(CASE WHEN event_type = 'view' THEN event_id END, CASE WHEN event_type = 'view' THEN {'us': us, 'e': event_id} END) AS view,
concat(CASE WHEN count(CASE WHEN event_type = 'error' THEN 1 END) > 0 THEN 'E' END, coalesce(string_agg(CASE WHEN value > 50 THEN left(event_type, 1) END, '' ORDER BY us, event_id), '')) AS text
FROM g GROUP BY user_id, grp""")
def q_decode_word(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows to groups at each flagged row; per group the last value of each slot, and text of what is not default."""
    e = S.flag_groups(events(spark, sf_dir), by_user(), F.col("event_type") == "purchase")
    place = F.struct("us", "event_id")
    last = lambda kind: F.max_by(F.when(F.col("event_type") == kind, F.col("event_id")), F.when(F.col("event_type") == kind, place)).alias(kind)
    parts = F.array_sort(F.collect_list(F.when(F.col("value") > 50, F.struct("us", "event_id", F.left("event_type", F.lit(1)).alias("t")))))
    text = F.concat_ws("", F.when(F.count(F.when(F.col("event_type") == "error", 1)) > 0, "E"), F.array_join(F.transform(parts, lambda p: p["t"]), ""))
    return e.groupBy("user_id", "group").agg(last("click"), last("view"), text.alias("text"))


@query(f"""WITH s AS (SELECT *, sum(CASE WHEN event_type = 'signup' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY us, event_id ROWS UNBOUNDED PRECEDING) AS n FROM ({E})),
r AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY value) - 1 AS r, count(*) OVER (PARTITION BY user_id) AS c FROM s),
m AS (SELECT user_id, value AS med FROM r WHERE r = c // 2),
k AS (SELECT s.*, s.n % 2 = 1 AS quoted FROM s JOIN m USING (user_id) WHERE event_type <> 'signup' AND (s.n % 2 = 1 OR value >= 0.45 * med)),
w AS (SELECT *, CASE WHEN (event_type = 'purchase' AND NOT quoted) OR coalesce(lag(quoted) OVER p <> quoted, true) OR (quoted AND lag(n) OVER p <> n) THEN 1 ELSE 0 END AS begins FROM k WINDOW p AS (PARTITION BY user_id ORDER BY us, event_id)),
g AS (SELECT *, sum(begins) OVER (PARTITION BY user_id ORDER BY us, event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS grp FROM w),
t AS (SELECT user_id, grp, bool_or(quoted) AS quoted, string_agg(left(event_type, 1), '' ORDER BY us, event_id) AS txt FROM g GROUP BY user_id, grp)
SELECT user_id, string_agg(CASE WHEN quoted THEN '<' || txt || '>' ELSE txt END, ' ' ORDER BY grp) AS phrase FROM t GROUP BY user_id""")
def q_decode_phrase(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Delimited spans, a filter of low rows against the group's upper median outside spans, words at flags, one text per user."""
    w = by_user()
    e = events(spark, sf_dir).withColumn("n", F.sum((F.col("event_type") == "signup").cast("long")).over(w.rowsBetween(W.unboundedPreceding, 0)))
    e = e.join(S.upper_median(e, ["user_id"], "value"), "user_id").withColumn("quoted", F.col("n") % 2 == 1)
    e = e.where((F.col("event_type") != "signup") & (F.col("quoted") | (F.col("value") >= 0.45 * F.col("median"))))
    turn = F.coalesce(F.lag("quoted").over(w) != F.col("quoted"), F.lit(True)) | (F.col("quoted") & (F.lag("n").over(w) != F.col("n")))
    begins = ((F.col("event_type") == "purchase") & ~F.col("quoted")) | turn
    e = e.withColumn("b", begins.cast("long")).withColumn("g", F.sum("b").over(w.rowsBetween(W.unboundedPreceding, 0)))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("us", "event_id", F.left("event_type", F.lit(1)).alias("t")))), lambda s: s["t"]), "")
    words = e.groupBy("user_id", "g").agg(F.bool_or("quoted").alias("q"), text.alias("t"))
    words = words.select("user_id", "g", F.when(F.col("q"), F.concat(F.lit("<"), "t", F.lit(">"))).otherwise(F.col("t")).alias("t"))
    return words.groupBy("user_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("g", "t"))), lambda s: s["t"]), " ").alias("phrase"))


@query(matching.RANKED_SQL + """, c AS (SELECT vec_id, label, t_label, 1 / (1 + distance) AS score FROM r WHERE rank = 1)
SELECT label, vec_id // 256 AS page, string_agg(CASE WHEN score >= 0.4 THEN t_label::VARCHAR ELSE '·' END, ' ' ORDER BY vec_id) AS text,
count(CASE WHEN score >= 0.4 THEN 1 END) AS sure, count(CASE WHEN score >= 0.3 AND score < 0.4 THEN 1 END) AS likely, count(CASE WHEN score < 0.3 THEN 1 END) AS doubtful FROM c GROUP BY label, page""")
def q_confidence_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best class where its score reaches the floor, a dot elsewhere, in reading order by pages of bounded length; and counts by band."""
    s = matching.ranked(spark, sf_dir, 1).withColumn("score", 1 / (1 + F.col("distance")))
    mark = F.when(F.col("score") >= 0.4, F.col("t_label").cast("string")).otherwise("·")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("vec_id", mark.alias("m")))), lambda x: x["m"]), " ")
    band = lambda c: F.count(F.when(c, 1))
    return s.groupBy("label", F.floor(F.col("vec_id") / 256).alias("page")).agg(text.alias("text"), band(F.col("score") >= 0.4).alias("sure"), band((F.col("score") >= 0.3) & (F.col("score") < 0.4)).alias("likely"), band(F.col("score") < 0.3).alias("doubtful"))


@query()
def q_classify_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segment, bring each character's largest component to a square mask, and match it to the first masks of each label."""
    masks = raster.masks(spark, sf_dir)
    parts = R.components(masks, "vec_id", "mask", raster.SIDE, 3)
    base = parts.withColumn("n", F.row_number().over(W.partitionBy("id").orderBy(F.desc("pixels"), "component"))).where("n = 1")
    own = base.join(masks.select(F.col("vec_id").alias("id"), "mask"), "id")
    own = own.select("id", R.normalised(F.col("mask"), F.struct("x", "y", "w", "h"), raster.SIDE, raster.SIDE).alias("mask"))
    labels = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "label")
    t = M.templates_first(own.join(labels, "id"), "label", "id").select(F.col("id").alias("t_id"), F.col("label").alias("t_label"), "mask")
    best = M.chamfer_nearest(own, t, "id", raster.SIDE)
    return best.select(F.col("id").alias("vec_id"), "t_id", F.col("t_label").alias("predicted"), F.round("score", 6).alias("score"))


@query("""WITH l AS (SELECT l_orderkey, l_linenumber, l_returnflag || l_linestatus AS label, l_quantity > 25 AS clean, 1 + l_discount AS scale FROM lineitem),
k AS (SELECT l_orderkey, label, row_number() OVER (PARTITION BY l_orderkey ORDER BY label) - 1 AS label_index FROM (SELECT DISTINCT l_orderkey, label FROM l))
SELECT l_orderkey || '/' || l_linenumber || '.png' AS file, label, label_index::INT AS label_index, 'c-' || label AS class, scale FROM l JOIN k USING (l_orderkey, label) WHERE clean""")
def q_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clean samples of dataset manifests, one JSON document an order, with the index of each label in its manifest."""
    label = F.concat("l_returnflag", "l_linestatus")
    aug = F.struct((1 + F.col("l_discount")).alias("scale"))
    sample = F.struct(F.concat_ws("/", "l_orderkey", F.concat(F.col("l_linenumber").cast("string"), F.lit(".png"))).alias("file"), label.alias("label"), F.concat(F.lit("c-"), label).alias("class"), (F.col("l_quantity") > 25).alias("clean"), aug.alias("aug"))
    # an order has few lines
    text = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.to_json(F.struct(F.lit(8).alias("canvas"), F.collect_list(sample).alias("samples"))).alias("j"))
    m = text.select(F.from_json("j", records.DATASET).alias("m")).select("m.*")
    return records.manifest_samples(m, clean_only=True).select("file", "label", F.col("label_index").cast("int").alias("label_index"), "class", "aug.scale")


@query("""SELECT l_orderkey::INT AS sheet, l_linenumber::INT AS place, ((l_linenumber - 1) // 3)::INT AS "row", ((l_linenumber - 1) % 3)::INT AS col, l_returnflag AS text, ((l_linenumber - 1) % 3 * 100)::INT AS x, ((l_linenumber - 1) // 3 * 80)::INT AS y FROM lineitem""")
def q_sheet_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells of capture manifests, one JSON document an order."""
    at = F.col("l_linenumber") - 1
    row, col = F.floor(at / 3).cast("int"), at % 3
    box = F.struct((col * 100).alias("x"), (row * 80).alias("y"), F.lit(90).alias("w"), F.lit(70).alias("h"))
    cell = F.struct(F.col("l_linenumber").alias("index"), row.alias("row"), col.alias("col"), F.col("l_returnflag").alias("text"), box.alias("box"))
    text = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.to_json(F.struct(F.col("l_orderkey").alias("sheetId"), F.collect_list(cell).alias("cells"))).alias("j"))
    cells = records.sheet_cells(text.select(F.from_json("j", records.SHEET).alias("m")).select("m.*"))
    return cells.select(F.col("sheetId").alias("sheet"), F.col("index").alias("place"), "row", "col", "text", "box.x", "box.y")


@query("SELECT * FROM (VALUES (0, 'single', 'parsed', 'a', 'b'), (0, 'single', 'parsed', 'c', 'd'), (1, 'ligature', 'parsed', 'ff', 'f f'), (2, 'chained', 'unparsed', NULL, NULL), (3, 'single', 'error', NULL, NULL)) t(lookup, type, status, source, targets)")
def q_flatten_lookups(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = json.dumps([{"lookup": 0, "type": "single", "single": {"a": "b", "c": "d"}}, {"lookup": 1, "type": "ligature", "many": {"ff": ["f", "f"]}}, {"lookup": 2, "type": "chained"}, {"lookup": 3, "type": "single", "error": "bad"}])
    return records.flatten_lookups(spark.createDataFrame([(text,)], "j string"), "j")


@query("""SELECT (61696 + c_custkey)::INT AS cp, c_name AS name FROM customer UNION ALL SELECT (97 + c_custkey % 26)::INT, 'letter' FROM customer""")
def q_code_point_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Code point maps in both dialects, one JSON document a customer: objects from hex to name, and lists of objects."""
    high, low, name = F.hex(61696 + F.col("c_custkey")), F.hex(97 + F.col("c_custkey") % 26), F.col("c_name")
    as_map = F.to_json(F.create_map(F.concat(F.lit("0x"), high), name, low, F.lit("letter")))
    item = lambda point, n: F.struct(point.alias("codepoint"), n.alias("name"))
    as_list = F.to_json(F.array(item(F.concat(F.lit("U+"), high), name), item(low, F.lit("letter"))))
    text = table(spark, sf_dir, "customer").select(F.when(F.col("c_custkey") % 2 == 0, as_map).otherwise(as_list).alias("j"))
    return records.code_points(text, "j")


@query("""WITH c AS (SELECT doc_id, source, coalesce(quality, -1) AS quality FROM documents LEFT JOIN labels USING (doc_id))
SELECT source, count(*) AS n, count(CASE WHEN quality = 1 THEN 1 END) AS confirmed, count(CASE WHEN quality = 0 THEN 1 END) AS rejected, count(CASE WHEN quality = -1 THEN 1 END) AS unchecked,
CASE WHEN count(CASE WHEN quality = -1 THEN 1 END) > 0 THEN 'open' ELSE 'done' END AS status FROM c GROUP BY source""")
def q_inventory_flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inventory, verdicts applied by key, and a report by class."""
    base = table(spark, sf_dir, "documents").select("doc_id", "source", F.lit(-1).alias("quality"))
    rows = L.merge_update(base, table(spark, sf_dir, "labels"), "doc_id", ["quality"])
    n = lambda v: F.count(F.when(F.col("quality") == v, 1))
    by = rows.groupBy("source").agg(F.count(F.lit(1)).alias("n"), n(1).alias("confirmed"), n(0).alias("rejected"), n(-1).alias("unchecked"))
    return by.withColumn("status", F.when(F.col("unchecked") > 0, "open").otherwise("done"))


@query("""WITH o AS (SELECT o_orderkey, nullif(o_orderkey % 7, 0) AS sheet, o_totalprice FROM orders),
m AS (SELECT * FROM (VALUES (1, 250000.0::DOUBLE), (2, 200000.0), (3, 150000.0), (4, 100000.0)) t(sheet, least)), d AS (SELECT 50000.0::DOUBLE AS least),
s AS (SELECT o.sheet, o_totalprice >= coalesce(m.least, d.least) AS ok FROM o LEFT JOIN m USING (sheet), d WHERE o.sheet IS NOT NULL)
SELECT sheet, count(*) AS n, count(CASE WHEN ok THEN 1 END) AS ok FROM s GROUP BY GROUPING SETS ((sheet), ())""")
def q_scan_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Captures joined to manifests by decoded number, a fallback for the rest, those without a number left out; totals per sheet and in all."""
    o = table(spark, sf_dir, "orders").select(F.nullif(F.col("o_orderkey") % 7, F.lit(0)).alias("sheet"), "o_totalprice").where("sheet is not null")
    sheets = spark.createDataFrame([(1, 250000.0), (2, 200000.0), (3, 150000.0), (4, 100000.0)], "sheet long, least double")
    s = o.join(F.broadcast(sheets), "sheet", "left").withColumn("ok", F.col("o_totalprice") >= F.coalesce("least", F.lit(50000.0)))
    return s.rollup("sheet").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("ok"), 1)).alias("ok"))


@query("""WITH t AS (SELECT conv_id, turn, string_split(text, ' ') AS a, string_split(lead(text) OVER (PARTITION BY conv_id ORDER BY turn, role), ' ') AS b FROM conversations)
SELECT conv_id, turn, i::INT AS i, a[i + 1] AS x, b[i + 1] AS y FROM t, range(0, 5000) r(i) WHERE len(a) = len(b) AND i < len(a)""")
def q_zip_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of two lists side by side; a pair of lists of unlike lengths is dropped whole."""
    t = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.split("text", " ").alias("a"), F.split(F.lead("text").over(W.partitionBy("conv_id").orderBy("turn", "role")), " ").alias("b"))
    rows = t.where(F.size("a") == F.size("b")).select("conv_id", "turn", F.posexplode(F.arrays_zip("a", "b")).alias("i", "p"))
    return rows.select("conv_id", "turn", "i", F.col("p.a").alias("x"), F.col("p.b").alias("y"))


@query("""WITH e AS (SELECT label, vec_id, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y, abs(embedding[3])::DOUBLE AS size FROM embeddings),
r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY size DESC, vec_id) AS rn, max(size) OVER (PARTITION BY label) AS top FROM e),
c AS (SELECT * FROM r WHERE size >= 0.3 * top AND rn <= 4), m AS (SELECT label, x, y FROM c WHERE rn = 1)
SELECT label, vec_id, rn::INT AS place, row_number() OVER (PARTITION BY c.label ORDER BY (c.x - m.x) ** 2 + (c.y - m.y) ** 2 DESC, vec_id) = 1 AS farthest FROM c JOIN m USING (label)""")
def q_corner_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The four largest of each group among those near the largest in size, and the one farthest from the first."""
    e = table(spark, sf_dir, "embeddings").select("label", "vec_id", *[F.get("embedding", F.lit(i)).cast("double").alias(c) for i, c in enumerate(("x", "y", "z"))]).withColumn("size", F.abs("z"))
    w = W.partitionBy("label")
    e = e.withColumn("place", F.row_number().over(w.orderBy(F.desc("size"), "vec_id"))).where("place <= 4")
    e = e.withColumn("top", F.max("size").over(w)).withColumn("m", F.max(F.when(F.col("place") == 1, F.struct("x", "y"))).over(w)).where("size >= 0.3 * top")
    far = F.pow(F.col("x") - F.col("m.x"), 2) + F.pow(F.col("y") - F.col("m.y"), 2)
    return e.select("label", "vec_id", "place", (F.row_number().over(w.orderBy(F.desc(far), "vec_id")) == 1).alias("farthest"))


@query("""WITH g AS (SELECT vec_id, t, round(128 + 100 * embedding[t + 1]::DOUBLE, 6) AS v FROM embeddings, range(0, 64) r(t)),
h AS (SELECT a.vec_id, a.t, sum(b.v * CASE WHEN b.t % 8 = a.t % 8 THEN 1 + (a.t % 8 = 0)::INT + (a.t % 8 = 7)::INT ELSE 1 END) / 3 AS v FROM g a JOIN g b ON a.vec_id = b.vec_id AND a.t // 8 = b.t // 8 AND abs(a.t % 8 - b.t % 8) <= 1 GROUP BY a.vec_id, a.t),
k AS (SELECT a.vec_id, a.t, sum(b.v * CASE WHEN b.t // 8 = a.t // 8 THEN 1 + (a.t // 8 = 0)::INT + (a.t // 8 = 7)::INT ELSE 1 END) / 3 AS v FROM h a JOIN h b ON a.vec_id = b.vec_id AND a.t % 8 = b.t % 8 AND abs(a.t // 8 - b.t // 8) <= 1 GROUP BY a.vec_id, a.t)
SELECT vec_id, round(max(v), 4) AS high, round(min(v), 4) AS low FROM k GROUP BY vec_id""")
def q_box_blur(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Separable mean of three cells with the edge repeated."""
    grey = F.transform("embedding", lambda v: F.round(128 + 100 * v.cast("double"), 6))
    rows = table(spark, sf_dir, "embeddings").select("vec_id", R.box_blurred(grey, raster.SIDE, raster.SIDE, 1).alias("b"))
    return rows.select("vec_id", F.round(F.array_max("b"), 4).alias("high"), F.round(F.array_min("b"), 4).alias("low"))


@query("""SELECT vec_id, round(2 * (x * cos(radians(30)) - y * sin(radians(30))) + 5, 6) AS px, round(2 * (x * sin(radians(30)) + y * cos(radians(30))) - 1, 6) AS py,
round(sqrt(power(x - greatest(0, least(1, x)), 2) + y * y), 6) AS distance, round((200 * 64 + 40 * 191) / 255.0)::INT AS blend FROM (SELECT vec_id, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y FROM embeddings)""")
def q_placement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points scaled, turned and moved; distance to a straight piece; one colour laid over another."""
    x, y = F.get("embedding", F.lit(0)).cast("double"), F.get("embedding", F.lit(1)).cast("double")
    px, py = G.placed(x, y, F.lit(2.0), F.lit(30.0), F.lit(5.0), F.lit(-1.0))
    z, o = F.lit(0.0), F.lit(1.0)
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(px, 6).alias("px"), F.round(py, 6).alias("py"), F.round(G.segment_distance(x, y, z, z, o, z), 6).alias("distance"), G.over(F.lit(200), F.lit(64), F.lit(40)).alias("blend"))


@query("SELECT vec_id, 2 AS lines, (1 + 10 + 1 + 3)::INT AS points FROM embeddings")
def q_path_flatten(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Path strings to polylines: a closed curve and an open line."""
    ship(spark)
    path = F.concat(F.lit("M0 0Q"), F.format_number(F.col("vec_id") % 9 + 0.5, 1), F.lit(" 4 8 0Z M1 1H5V7"))
    lines = table(spark, sf_dir, "embeddings").select("vec_id", G.flattened(path).alias("l"))
    return lines.select("vec_id", F.size("l").alias("lines"), F.aggregate("l", F.lit(0), lambda a, x: a + F.size(x)).alias("points"))


@query("""WITH p AS (SELECT vec_id, round(embedding[1]::DOUBLE * 100) / 10 AS a, round(embedding[2]::DOUBLE * 100) / 10 AS b FROM embeddings),
c AS (SELECT vec_id, 0 AS n, a AS x, 0.0::DOUBLE AS y FROM p UNION ALL SELECT vec_id, i, a + 2 * (i / 10.0::DOUBLE) * (1 - i / 10.0::DOUBLE) * 2 + (i / 10.0::DOUBLE) ** 2 * 8, 2 * (i / 10.0::DOUBLE) * (1 - i / 10.0::DOUBLE) * 4 FROM p, range(1, 11) r(i)
UNION ALL SELECT vec_id, 11, a + 8 + b, 3 FROM p UNION ALL SELECT vec_id, 12, 5, 3 FROM p UNION ALL SELECT vec_id, 13, 5, b FROM p UNION ALL SELECT vec_id, 14, a, 0 FROM p)
SELECT vec_id, n::INT AS n, round(x, 6) + 0 AS x, round(y, 6) + 0 AS y FROM c""")
def q_path_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every point of paths with relative and absolute commands: a curve, lines, and the way back to the start."""
    ship(spark)
    a, b = (F.round(F.get("embedding", F.lit(i)).cast("double") * 100) / 10 for i in (0, 1))
    path = F.concat(F.lit("M"), a.cast("string"), F.lit(",0q2 4 8,0l"), b.cast("string"), F.lit(" 3H5V"), b.cast("string"), F.lit("zm1 1"))
    lines = table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode(F.get(G.flattened(path), F.lit(0))).alias("n", "p"))
    return lines.select("vec_id", "n", (F.round("p.x", 6) + 0).alias("x"), (F.round("p.y", 6) + 0).alias("y"))


@query("""WITH d AS (SELECT doc_id, lower(text) AS t, row_number() OVER (ORDER BY doc_id) AS rn FROM documents), h AS (SELECT * FROM d WHERE rn <= 20), l AS (SELECT chr(x::INT) AS letter FROM range(97, 123) t(x)),
u AS (SELECT letter FROM l WHERE NOT EXISTS (SELECT 1 FROM h WHERE contains(h.t, letter))) SELECT letter, (SELECT min(doc_id) FROM d WHERE contains(d.t, letter) AND rn > 20) AS repair FROM u""")
def q_coverage_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Letters that the first 20 documents lack, and the first other document that has each."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.lower("text").alias("t"))
    edge = docs.select("doc_id").orderBy("doc_id").limit(20).agg(F.max("doc_id").alias("edge"))
    letters = [chr(c) for c in range(97, 123)]
    head = F.col("doc_id") <= F.col("edge")
    has = lambda c: F.contains("t", F.lit(c))
    found = docs.crossJoin(F.broadcast(edge)).agg(*[F.struct(F.count(F.when(head & has(c), 1)).alias("n"), F.min(F.when(~head & has(c), F.col("doc_id"))).alias("d")).alias(c) for c in letters])
    rows = found.select(F.explode(F.array(*[F.struct(F.lit(c).alias("letter"), F.col(f"{c}.n").alias("n"), F.col(f"{c}.d").alias("repair")) for c in letters])).alias("r"))
    return rows.where("r.n = 0").select("r.letter", "r.repair")


@query()
def q_model_standin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A trained classifier with candidates and confidence beside the template baseline, on the same held-out rows."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector, vector_to_array

    from ..operators.sampling import head_split

    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.col("label").cast("double").alias("label"), array_to_vector(F.col("embedding").cast("array<double>")).alias("features"))
    rows = head_split(rows, ["label"], ["vec_id"], 0.25, 1000).persist()
    model = LogisticRegression(maxIter=20, regParam=0.05).fit(rows.where("part = 'train'"))
    p = model.transform(rows.where("part = 'test'")).withColumn("p", vector_to_array("probability"))
    top = F.slice(F.reverse(F.array_sort(F.transform("p", lambda v, i: F.struct(v.alias("v"), (-i).alias("k"))))), 1, 3)
    p = p.withColumn("top", F.transform(top, lambda s: -s["k"]))
    model_rows = p.select("vec_id", F.col("label").cast("int").alias("label"), F.get("top", F.lit(0)).alias("predicted"), F.round(F.array_max("p"), 4).alias("confidence"), F.array_contains("top", F.col("label").cast("int")).alias("in_top3"))
    base = matching.ranked(spark, sf_dir, 1).select("vec_id", F.col("t_label").alias("template"))
    return model_rows.join(if_small(base), "vec_id")


#: Heads over the labels: features of a primary, an extension that may be absent, three slots twice over.
HEADS = {
    "version": "label % 2", "stem": "label % 3", "context": "label div 5",
    "top": "CASE WHEN label < 4 THEN 'NONE' ELSE concat('t', label) END", "core": "label", "bottom": "label % 4",
}
#: Least confidence at which a version is accepted.
SURE_VERSION = 0.97


@query()
def q_model_heads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A classifier with several heads on rows held out, each with its confidence; the version only if it is sure."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "label", "embedding").withColumns({k: F.expr(e) for k, e in HEADS.items()})
    test = F.pmod(F.crc32(F.col("vec_id").cast("string")), F.lit(4)) == 0
    model = H.train_heads(H.training_sample(rows.where(~test), "vec_id", "embedding", list(HEADS)), "vec_id", list(HEADS))
    out = H.predict_heads(rows.where(test), "vec_id", "embedding", model)
    confidences = [F.round(f"{h}_confidence", 4).alias(f"{h}_confidence") for h in HEADS]
    return out.select("vec_id", F.when(F.col("version_confidence") >= SURE_VERSION, F.col("version")).alias("version"), *[h for h in HEADS if h != "version"], *confidences)


@query("""SELECT n_nationkey AS lookup, CASE WHEN n_nationkey % 4 = 3 THEN 'error' WHEN n_nationkey % 4 = 2 THEN 'unparsed' ELSE 'parsed' END AS status, CASE n_nationkey % 4 WHEN 0 THEN 'mark-to-base' WHEN 1 THEN 'mark-to-mark' ELSE 'other' END AS type,
CASE WHEN n_nationkey % 4 < 2 THEN 'b' || n_nationkey END AS base, CASE WHEN n_nationkey % 4 < 2 THEN 'm' || k END AS mark,
CASE WHEN n_nationkey % 4 < 2 THEN CASE WHEN k % 2 = 0 THEN n_nationkey * 3 ELSE 1 END - (n_nationkey + k) END::INT AS dx, CASE WHEN n_nationkey % 4 < 2 THEN CASE WHEN k % 2 = 0 THEN 7 ELSE n_regionkey END - (n_nationkey * 2 - k) END::INT AS dy
FROM nation, range(0, 3) r(k) WHERE k = 0 OR n_nationkey % 4 < 2""")
def q_flatten_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positioning lookups to one row per base and mark with the offset of their anchors; other kinds and errors stay as rows."""
    part = F.col("n_nationkey") % 4
    kind = F.when(part == 0, "mark-to-base").when(part == 1, "mark-to-mark").otherwise("other")
    known, n = part < 2, F.col("n_nationkey")
    anchor = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    marks = F.create_map(*[c for k in range(3) for c in (F.lit(f"m{k}"), F.struct(F.lit(k % 2).alias("class"), (n + k).alias("x"), (n * 2 - k).alias("y")))])
    bases = F.create_map(F.concat(F.lit("b"), n.cast("string")), F.array(anchor(n * 3, F.lit(7)), anchor(F.lit(1), F.col("n_regionkey"))))
    text = F.to_json(F.array(F.struct(F.col("n_nationkey").alias("lookup"), kind.alias("type"), F.when(known, marks).alias("marks"), F.when(known, bases).alias("bases"), F.when(part == 3, "bad offset").alias("error"))))
    return records.flatten_positions(table(spark, sf_dir, "nation").select(text.alias("t")), "t")


@query("""WITH n AS (SELECT n_nationkey::INT AS lookup, n_nationkey % 8 AS part, n_name AS g FROM nation),
r AS (SELECT lookup, 'single' AS type, 'parsed' AS status, g AS source, g || '.alt' AS targets FROM n WHERE part = 0
UNION ALL SELECT lookup, 'multiple', 'parsed', g, g || ' dot' FROM n WHERE part = 1
UNION ALL SELECT lookup, 'alternate', 'parsed', g, g || '.' || k FROM n, range(1, 4) r(k) WHERE part = 2
UNION ALL SELECT lookup, 'ligature', 'parsed', g || ' dot', g || '_dot' FROM n WHERE part = 3
UNION ALL SELECT lookup, 'chained' || (part - 3), 'parsed', 'a b | ' || g || ' | ' || CASE part WHEN 5 THEN 'c' ELSE '' END, '0:' || (lookup + 1) || ' 1:' || (lookup + 2) FROM n WHERE part IN (4, 5, 6)
UNION ALL SELECT lookup, 'other', CASE WHEN lookup % 16 = 7 THEN 'error' ELSE 'unparsed' END, NULL, NULL FROM n WHERE part = 7) SELECT * FROM r""")
def q_flatten_substitutions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Substitution lookups of every kind to rows of source and targets; a choice is a row for each, a chained rule one
    row of what stands before, in and after, and the lookups that it applies."""
    part, g, n = F.col("n_nationkey") % 8, F.col("n_name"), F.col("n_nationkey")
    kind = F.element_at(F.array(*map(F.lit, ("single", "multiple", "alternate", "ligature", "chained1", "chained2", "chained3", "other"))), (part + 1).cast("int"))
    only = lambda i, c: F.when(part == i, c)
    rule = F.struct(F.array(F.lit("a"), F.lit("b")).alias("before"), F.array(g).alias("input"), F.when(part == 5, F.array(F.lit("c"))).otherwise(F.array().cast("array<string>")).alias("after"),
                    F.array(F.struct(F.lit(0).alias("at"), (n + 1).alias("lookup")), F.struct(F.lit(1).alias("at"), (n + 2).alias("lookup"))).alias("applies"))
    fields = {
        "lookup": n, "type": kind, "single": only(0, F.create_map(g, F.concat(g, F.lit(".alt")))), "multiple": only(1, F.create_map(g, F.array(g, F.lit("dot")))),
        "alternate": only(2, F.create_map(g, F.array(*[F.concat(g, F.lit(f".{k}")) for k in (1, 2, 3)]))),
        "ligature": only(3, F.create_map(F.concat(g, F.lit(" dot")), F.concat(g, F.lit("_dot")))), "rules": F.when(part.between(4, 6), F.array(rule)), "error": F.when(n % 16 == 7, "bad offset"),
    }
    text = F.to_json(F.array(F.struct(*[c.alias(k) for k, c in fields.items()])))
    return records.flatten_substitutions(table(spark, sf_dir, "nation").select(text.alias("t")), "t")
