"""Composite decoders over embeddings read as 8 x 8 bitmaps: types, decomposition, zones, competition, spelling."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators import decoding as D
from ..operators import raster as R
from .registry import query, table

TYPES = ("primary", "secondary", "tertiary", "quaternary")
WHOLE, TOP, CORE, LOWER, BOTTOM = D.zone(0, 64), D.zone(0, 16), D.zone(16, 48), D.zone(16, 64), D.zone(48, 64)
#: Pools of templates: the how-manieth item of a label, and the labels.
POOLS = (("typed", 1, 0, 9), ("base", 1, 0, 4), ("mark", 1, 5, 9), ("bare", 2, 0, 4), ("ext", 3, 0, 4), ("place", 2, 5, 9), ("top", 4, 0, 9), ("none", 5, 0, 9))
#: Least score of a first character that is not primary; margins of an extension and of a top; least score of a base.
PRIOR, EXTENSION, TOP_GATE, BASE = 0.7, 0.04, 0.14, 0.6


def characters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, label, bits and the book of templates."""
    mask = F.transform("embedding", lambda v: (v > 0.12).cast("int"))
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "label", D.packed(mask).alias("bits"))
    # the first items of each label: each task keeps but a few rows for the window
    first = rows.withColumn("n", F.row_number().over(W.partitionBy("label").orderBy("vec_id"))).where("n <= 5")
    pool = F.explode(F.filter(F.array(*[F.struct(F.lit(p).alias("pool"), F.lit(n).alias("n"), F.lit(a).alias("a"), F.lit(b).alias("b")) for p, n, a, b in POOLS]), lambda p: (p["n"] == F.col("n")) & F.col("label").between(p["a"], p["b"])))
    templates = first.select(F.col("vec_id").alias("id"), "label", "bits", pool.alias("p")).select("p.pool", "id", "label", "bits")
    return rows.crossJoin(D.book(templates))


S = """WITH m AS (SELECT vec_id, label, list_transform(embedding, lambda v: CASE WHEN v > 0.12 THEN 1 ELSE 0 END) AS k FROM embeddings),
f AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS n FROM m),
t AS (SELECT p.pool, f.vec_id AS id, f.label, f.k FROM f JOIN (VALUES """ + ", ".join(f"('{p}', {n}, {a}, {b})" for p, n, a, b in POOLS) + """) p(pool, n, a, b) ON f.n = p.n AND f.label BETWEEN p.a AND p.b)
"""


def _best(name: str, rows: str, pool: str, first: int, last: int, keep: str = "TRUE") -> str:
    """A CTE of the best template of a pool over a zone of cells: vec_id, d, id, label, score."""
    unlike = f"list_sum(list_transform(range({first + 1}, {last + 1}), lambda i: abs(r.k[i] - t.k[i])))"
    return f"""{name} AS (SELECT vec_id, b.d AS d, b.id AS id, b.label AS label, 1 - b.d / {last - first}.0::DOUBLE AS score
FROM (SELECT r.vec_id, min({{'d': {unlike}::INT, 'id': t.id, 'label': t.label}}) AS b FROM {rows} r JOIN t ON t.pool = '{pool}' AND {keep} GROUP BY r.vec_id))"""


TYPED = S + ", " + _best("y", "m", "typed", 0, 64) + ", c AS (SELECT vec_id, label, ['primary', 'secondary', 'tertiary', 'quaternary'][label % 4 + 1] AS kind, score FROM y)\n"


def _typed(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = characters(spark, sf_dir).withColumn("y", D.best(F.col("bits"), WHOLE, "typed"))
    kind = F.element_at(F.array(*map(F.lit, TYPES)), F.col("y.label") % 4 + 1)
    return rows.withColumn("kind", kind).withColumn("score", D.score(F.col("y"), WHOLE))


@query(TYPED + "SELECT vec_id, kind AS type, label, round(score, 6) AS score FROM c")
def q_char_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A character's type: that of the best of all typed templates."""
    return _typed(spark, sf_dir).select("vec_id", F.col("kind").alias("type"), F.col("y.label").alias("label"), F.round("score", 6).alias("score"))


ROUTED = TYPED + f""", w AS (SELECT vec_id, vec_id // 5 AS word, CASE WHEN row_number() OVER (PARTITION BY vec_id // 5 ORDER BY vec_id) = 1 AND kind <> 'primary' AND score < {PRIOR}::DOUBLE THEN 'primary' ELSE kind END AS type FROM c),
z AS (SELECT *, coalesce(type = 'secondary' AND lag(type) OVER (PARTITION BY word ORDER BY vec_id) = 'secondary', FALSE) AS spilled FROM w)
"""


def _routed(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _typed(spark, sf_dir).withColumn("word", F.floor(F.col("vec_id") / 5))
    return D.typed_words(rows, "word", "vec_id", "kind", "score", "primary", PRIOR, "secondary")


@query(ROUTED + "SELECT vec_id, word, type, spilled FROM z")
def q_word_routing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Types in words of five: the first is primary unless surely another; secondaries after a secondary are spilled."""
    return _routed(spark, sf_dir).select("vec_id", "word", "type", "spilled")


@query(S + ", " + _best("p", "(SELECT * FROM m WHERE vec_id % 4 = 0)", "base", 0, 64) + ", " + _best("q", "(SELECT * FROM m WHERE vec_id % 4 <> 0)", "mark", 0, 64)
       + " SELECT vec_id, 'base' AS pool, label, round(score, 6) AS score FROM p UNION ALL SELECT vec_id, 'mark', label, round(score, 6) FROM q")
def q_classify_pools(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of a region by pool: the base among base templates, each mark among marks."""
    is_base = F.col("vec_id") % 4 == 0
    found = F.when(is_base, D.best(F.col("bits"), WHOLE, "base")).otherwise(D.best(F.col("bits"), WHOLE, "mark"))
    rows = characters(spark, sf_dir).withColumn("f", found)
    return rows.select("vec_id", F.when(is_base, "base").otherwise("mark").alias("pool"), F.col("f.label").alias("label"), F.round(D.score(F.col("f"), WHOLE), 6).alias("score"))


@query(S + ", " + _best("p", "m", "base", 0, 64) + ", " + _best("q", "m", "mark", 0, 64) + f""",
c AS (SELECT m.vec_id, m.vec_id // 4 AS ch, row_number() OVER (PARTITION BY m.vec_id // 4 ORDER BY m.vec_id) AS n, m.label % 2 AS under, p.label AS base, p.score, CASE q.label WHEN 5 THEN 'low' WHEN 6 THEN 'mid' WHEN 7 THEN 'high' END AS v, CASE q.label WHEN 7 THEN 'near' WHEN 8 THEN 'far' WHEN 9 THEN 'gone' END AS u FROM m JOIN p USING (vec_id) JOIN q USING (vec_id))
SELECT ch AS character, min(CASE WHEN n = 1 THEN base END) AS base, min(CASE WHEN n = 1 THEN score END) >= {BASE}::DOUBLE AS accepted,
coalesce((arg_max({{'v': v}}, vec_id) FILTER (n > 1 AND under = 0)).v, 'none') AS superposed, coalesce((arg_max({{'v': u}}, vec_id) FILTER (n > 1 AND under = 1)).v, 'none') AS underposed FROM c GROUP BY ch""")
def q_decompose(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A character of four components: the base's label, if good enough, and the value of the last mark of each role."""
    above = F.create_map(*[F.lit(x) for pair in {5: "low", 6: "mid", 7: "high"}.items() for x in pair])
    below = F.create_map(*[F.lit(x) for pair in {7: "near", 8: "far", 9: "gone"}.items() for x in pair])
    rows = characters(spark, sf_dir).withColumn("p", D.best(F.col("bits"), WHOLE, "base")).withColumn("q", D.best(F.col("bits"), WHOLE, "mark"))
    rows = rows.withColumn("character", F.floor(F.col("vec_id") / 4)).withColumn("n", F.row_number().over(W.partitionBy("character").orderBy("vec_id")))
    mark, under = F.col("n") > 1, F.col("label") % 2 == 1
    first = lambda c: F.min(F.when(F.col("n") == 1, c))
    return rows.groupBy("character").agg(
        first(F.col("p.label")).alias("base"), (first(D.score(F.col("p"), WHOLE)) >= BASE).alias("accepted"),
        F.coalesce(D.last_of(mark & ~under, F.try_element_at(above, F.col("q.label")), F.col("vec_id")), F.lit("none")).alias("superposed"),
        F.coalesce(D.last_of(mark & under, F.try_element_at(below, F.col("q.label")), F.col("vec_id")), F.lit("none")).alias("underposed"),
    )


@query(S + ", " + ", ".join(_best(n, "m", p, a, b) for n, p, a, b in (("x", "mark", 0, 16), ("y", "base", 16, 48), ("z", "mark", 0, 64)))
       + " SELECT vec_id, x.label AS fixed_perspective, y.label AS specification, z.label AS aligned_perspective FROM x JOIN y USING (vec_id) JOIN z USING (vec_id)")
def q_primary_zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two features of a character: by its zones, and by the whole shape for the one and the core zone for the other."""
    bits = F.col("bits")
    rows = characters(spark, sf_dir)
    found = {"fixed_perspective": D.best(bits, TOP, "mark"), "specification": D.best(bits, CORE, "base"), "aligned_perspective": D.best(bits, WHOLE, "mark")}
    return rows.select("vec_id", *[f["label"].alias(n) for n, f in found.items()])


@query(ROUTED + ", s AS (SELECT m.*, z.spilled FROM m JOIN z USING (vec_id) WHERE z.type = 'secondary')," + ", ".join(_best(n, "s", p, 16, 64) for n, p in (("a", "bare"), ("e", "ext"), ("h", "place")))
       + f""", o AS (SELECT s.*, CASE WHEN spilled THEN h.label WHEN e.score > a.score + {EXTENSION}::DOUBLE THEN e.label ELSE a.label END AS core, NOT spilled AND e.score > a.score + {EXTENSION}::DOUBLE AS extended
FROM s JOIN a USING (vec_id) JOIN e USING (vec_id) JOIN h USING (vec_id)), """
       + _best("u", "o", "top", 0, 16, "t.label % 5 = r.core % 5") + ", " + _best("v", "o", "none", 0, 16, "t.label = r.core")
       + f"""SELECT vec_id, spilled, CASE WHEN NOT spilled THEN core END AS core, extended, CASE WHEN u.score > v.score + {TOP_GATE}::DOUBLE THEN u.label END AS top FROM o JOIN u USING (vec_id) JOIN v USING (vec_id)""")
def q_secondary_competition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bare cores against extended ones, which must be clearly better; spilled characters meet placeholders alone; then
    the top among those of the core that was read, against the same core without a top."""
    bits = F.col("bits")
    rows = _routed(spark, sf_dir).where("type = 'secondary'")
    rows = rows.withColumn("a", D.best(bits, LOWER, "bare")).withColumn("e", D.best(bits, LOWER, "ext")).withColumn("h", D.best(bits, LOWER, "place"))
    wins = D.score(F.col("e"), LOWER) > D.score(F.col("a"), LOWER) + EXTENSION
    rows = rows.withColumn("core", F.when(F.col("spilled"), F.col("h.label")).when(wins, F.col("e.label")).otherwise(F.col("a.label")))
    rows = rows.withColumn("u", D.best(bits, TOP, "top", lambda t: t["label"] % 5 == F.col("core") % 5)).withColumn("v", D.best(bits, TOP, "none", lambda t: t["label"] == F.col("core")))
    top = F.when(D.score(F.col("u"), TOP) > D.score(F.col("v"), TOP) + TOP_GATE, F.col("u.label"))
    return rows.select("vec_id", "spilled", F.when(~F.col("spilled"), F.col("core")).alias("core"), (~F.col("spilled") & wins).alias("extended"), top.alias("top"))


#: Slots of the base that each label is read as; a doubled slot repeats the core, and a stress core accents the vowels.
SLOTS = (("k", "", ""), ("s", "r", ""), ("t", "", "GEM"), ("STRESS", "", "l"), ("p", "GEM", ""), ("m", "", "t"), ("n", "", ""), ("STRESS", "s", ""), ("l", "", "k"), ("x", "", ""))
VOWELS = "aeiou"
_SLOT = ", ".join(f"[{', '.join(repr(s[i]) for s in SLOTS)}][b.label + 1] AS {n}" for i, n in enumerate(("core", "top", "bottom")))
_STRESS = lambda v: f"CASE WHEN stress THEN CASE {v} " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in D.STRESSED.items()) + f" ELSE {v} END ELSE {v} END"


@query(S + ", " + ", ".join(_best(n, "m", p, a, b) for n, p, a, b in (("b", "typed", 0, 64), ("x", "mark", 0, 16), ("y", "mark", 48, 64), ("z", "mark", 0, 64)))
       + f""", i AS (SELECT vec_id, k, list_filter(range(0, 64), lambda i: k[i + 1] = 1) AS ink FROM m),
h AS (SELECT vec_id, vec_id // 6 AS word, coalesce(list_max(list_transform(ink, lambda i: i // 8)) - list_min(list_transform(ink, lambda i: i // 8)) + 1, 0) AS high, list_sum(k[1:16]) > 6 AS above, list_sum(k[49:64]) > 6 AS below FROM i),
g AS (SELECT *, high < 0.8::DOUBLE * max(high) OVER (PARTITION BY word) AS side FROM h),
n AS (SELECT *, sum(CASE WHEN side THEN 0 ELSE 1 END) OVER (PARTITION BY word ORDER BY vec_id ROWS UNBOUNDED PRECEDING) AS ch FROM g),
d AS (SELECT n.*, {_SLOT}, CASE WHEN above THEN 'aeiou'[x.label - 4] ELSE '' END AS sup, CASE WHEN below THEN 'aeiou'[y.label - 4] ELSE '' END AS sub, 'aeiou'[z.label - 4] AS mark FROM n JOIN b USING (vec_id) JOIN x USING (vec_id) JOIN y USING (vec_id) JOIN z USING (vec_id)),
c AS (SELECT word, ch, max(core) FILTER (NOT side) AS core, max(top) FILTER (NOT side) AS top, max(bottom) FILTER (NOT side) AS bottom, max(sup) FILTER (NOT side) AS sup, max(sub) FILTER (NOT side) AS sub, coalesce(arg_max(mark, vec_id) FILTER (side), '') AS right_ FROM d WHERE ch > 0 GROUP BY word, ch),
e AS (SELECT *, core = 'STRESS' AS stress, CASE WHEN core = 'STRESS' THEN '' ELSE core END AS plain FROM c)
SELECT word, string_agg({_STRESS("sup")} || CASE WHEN top = 'GEM' THEN plain ELSE top END || plain || {_STRESS("right_")} || CASE WHEN bottom = 'GEM' THEN plain ELSE bottom END || {_STRESS("sub")}, '' ORDER BY ch) AS text FROM e GROUP BY word""")
def q_alphabetic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of six spelt out: low characters are side marks of the one before; each base is read as three slots at
    once, marks above and below as vowels; then doubling, stress, and the letters in reading order."""
    bits = F.col("bits")
    mask = F.transform("embedding", lambda v: (v > 0.12).cast("int"))
    high = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("v"), F.coalesce(R.bbox(mask, 8)["h"], F.lit(0)).alias("high"))
    rows = characters(spark, sf_dir).join(high, F.col("vec_id") == F.col("v")).withColumn("word", F.floor(F.col("vec_id") / 6))
    rows = rows.withColumn("side", F.col("high") < 0.8 * F.max("high").over(W.partitionBy("word")))
    rows = rows.withColumn("ch", F.sum((~F.col("side")).cast("int")).over(W.partitionBy("word").orderBy("vec_id").rowsBetween(W.unboundedPreceding, 0))).where("ch > 0")
    vowel = lambda found: F.element_at(F.array(*map(F.lit, VOWELS)), found["label"] - 4)
    rows = rows.withColumn("b", D.best(bits, WHOLE, "typed"))
    slot = lambda i: F.element_at(F.array(*[F.lit(s[i]) for s in SLOTS]), F.col("b.label") + 1)
    own = lambda c: F.max(F.when(~F.col("side"), c))
    chars = rows.groupBy("word", "ch").agg(
        *[own(slot(i)).alias(n) for i, n in enumerate(("core", "top", "bottom"))],
        own(F.when(D.ink_in(bits, TOP) > 6, vowel(D.best(bits, TOP, "mark"))).otherwise("")).alias("sup"),
        own(F.when(D.ink_in(bits, BOTTOM) > 6, vowel(D.best(bits, BOTTOM, "mark"))).otherwise("")).alias("sub"),
        F.coalesce(F.max_by(F.when(F.col("side"), vowel(D.best(bits, WHOLE, "mark"))), F.when(F.col("side"), F.col("vec_id"))), F.lit("")).alias("right"),
    )
    stress = F.col("core") == "STRESS"
    plain = F.when(stress, "").otherwise(F.col("core"))
    double = lambda c: F.when(F.col(c) == "GEM", plain).otherwise(F.col(c))
    accent = lambda c: F.when(stress, D.stressed(F.col(c))).otherwise(F.col(c))
    chars = chars.withColumn("text", F.concat(accent("sup"), double("top"), plain, accent("right"), double("bottom"), accent("sub")))
    # a word is six characters, so its list is bounded
    return chars.groupBy("word").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ch", "text"))), lambda s: s["text"]), "").alias("text"))
