"""Flows of several steps: choosing words that cover letters, words of mixed forms, review rows, mark classes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import sampling as S
from ..operators.common import bound
from .matching import RANKED_SQL, ranked
from .registry import query, table
from .sampling import draw_sql

#: Words chosen, and the letters that they must cover.
CHOSEN, LETTERS = 24, "qzxjkvwy"


@query(f"""WITH RECURSIVE p AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS word FROM documents), o AS (SELECT word, length(word) AS len, md5(word) AS h FROM p),
z AS (SELECT len, count(*) AS n FROM o GROUP BY len),
b AS (SELECT *, floor({CHOSEN} * n / sum(n) OVER ()::DOUBLE)::BIGINT AS base, row_number() OVER (ORDER BY n DESC, len) AS rank FROM z),
q AS (SELECT len, base + CASE WHEN rank <= {CHOSEN} - sum(base) OVER () THEN 1 ELSE 0 END AS quota FROM b),
r AS (SELECT *, row_number() OVER (PARTITION BY len ORDER BY h) AS rn FROM o),
k AS (SELECT list(word ORDER BY r.len, h) AS words FROM r JOIN q USING (len) WHERE rn <= quota),
l AS (SELECT i, substr('{LETTERS}', i::INT, 1) AS letter FROM range(1, {len(LETTERS) + 1}) t(i)),
c AS (SELECT i, letter, arg_min(word, {{'len': len, 'h': h}}) AS word FROM l LEFT JOIN o ON contains(o.word, l.letter) GROUP BY i, letter),
s AS (SELECT 0::BIGINT AS i, words FROM k UNION ALL SELECT c.i, CASE WHEN c.word IS NULL OR len(list_filter(words, lambda w: contains(w, c.letter))) > 0 THEN words
ELSE list_transform(words, lambda w, j: CASE WHEN j = coalesce(list_position(list_transform(words, lambda v: length(v) = length(c.word) AND translate(v, '{LETTERS}', '') = v), TRUE), len(words)) THEN c.word ELSE w END) END FROM s JOIN c ON c.i = s.i + 1)
SELECT generate_subscripts(words, 1)::INT AS place, unnest(words) AS word FROM s WHERE i = {len(LETTERS)}""")
def q_word_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of all texts by quotas of their lengths, in drawn order, then swaps until every letter is covered."""
    # repeats go within each task before the shuffle
    words = table(spark, sf_dir, "documents").select(F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("([a-z]+)")))).alias("word")).distinct()
    pool = words.select(F.length("word").alias("len"), F.md5(F.col("word").cast("binary")).alias("h"), "word")
    quota = S.quotas(pool.groupBy("len").agg(F.count(F.lit(1)).alias("n")), "len", "n", CHOSEN)
    # a fixed filter first: no length takes more than all of them, so each task keeps that many rows
    first = pool.withColumn("rn", F.row_number().over(W.partitionBy("len").orderBy("h"))).where(f"rn <= {CHOSEN}")
    picked = first.join(quota, "len").where("rn <= quota").agg(F.transform(F.array_sort(F.collect_list(F.struct("len", "h", "word"))), lambda s: s["word"]).alias("words"))
    least = lambda c: F.min(F.when(F.contains("word", F.lit(c)), F.struct("len", "h", "word")))
    found = pool.agg(F.array(*[F.struct(F.lit(c).alias("letter"), least(c)["word"].alias("word")) for c in LETTERS]).alias("candidates"))
    chosen = picked.crossJoin(F.broadcast(found))  # one row each, by construction
    rows = chosen.select(F.posexplode(S.cover_letters(F.col("words"), F.col("candidates"), LETTERS)).alias("i", "word"))
    return rows.select((F.col("i") + 1).alias("place"), "word")


#: Shares of the forms of a syllable, and of words with a stressed vowel.
FORMS = [(0.12, "VC=V"), (0.10, "VC=EV"), (0.12, "VOCV"), (0.12, "VDCEV"), (0.24, "EVE"), (0.16, "CV"), (0.14, "VCE")]
STRESSED_SHARE = 0.22
KINDS = {"V": "aeiou", "C": "pbtdkgfvszclmnr", "O": "wy", "E": "pbtdkgfvszclmnrwy"}
#: Draws of a syllable; three syllables, and before them how many there are, after them the stress and its place.
EACH, ALL = 6, 21


def _syllable_sql(s: int) -> str:
    """CASE over the forms of syllable s, its draws being u[first + 1] and on."""
    first, upto, cases = 1 + EACH * s, 0.0, []
    for share, pattern in FORMS:
        upto = round(upto + share, 9)
        parts = []
        for k, p in enumerate(pattern):
            u = f"u[{first + k + 2}]"
            if p == "D":
                core, at = f"floor(u[{first + k + 3}] * {len(KINDS['C'])})", f"floor({u} * {len(KINDS['E']) - 1})"
                parts.append(f"substr('{KINDS['E']}', ({at} + CASE WHEN {at} >= {core} THEN 1 ELSE 0 END + 1)::INT, 1)")
            else:
                parts.append(parts[-1] if p == "=" else f"substr('{KINDS[p]}', (floor({u} * {len(KINDS[p])}) + 1)::INT, 1)")
        cases.append(f"WHEN u[{first + 1}] < {upto}::DOUBLE THEN " + " || ".join(parts))
    return "CASE " + " ".join(cases[:-1]) + " ELSE " + cases[-1].split(" THEN ", 1)[1] + " END"


@query(f"WITH r AS (SELECT c_custkey, j, c_custkey * 32 + j + 1 AS i FROM customer, range(0, {ALL}) t(j)), " + draw_sql("r", "17", "i")
       + f""", g AS (SELECT c_custkey, list(u ORDER BY j) AS u FROM u GROUP BY c_custkey), s AS (SELECT *, floor(u[1] * 3)::INT + 1 AS n, {_syllable_sql(0)} AS a, {_syllable_sql(1)} AS b, {_syllable_sql(2)} AS c FROM g),
w AS (SELECT *, a || CASE WHEN n > 1 THEN b ELSE '' END || CASE WHEN n > 2 THEN c ELSE '' END AS word FROM s), v AS (SELECT *, list_filter(range(1, length(word) + 1), lambda i: contains('aeiou', substr(word, i::INT, 1))) AS vowels FROM w),
p AS (SELECT *, vowels[floor(u[{ALL}] * len(vowels))::INT + 1]::INT AS place FROM v)
SELECT c_custkey, n AS syllables, CASE WHEN u[{ALL - 1}] < {STRESSED_SHARE}::DOUBLE THEN substr(word, 1, place - 1) || translate(substr(word, place, 1), 'aeiou', 'áéíóú') || substr(word, place + 1) ELSE word END AS word FROM p""")
def q_word_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A made-up word a row: one to three syllables of mixed forms, about one word in five with a stressed vowel."""
    draws = F.transform(F.sequence(F.lit(0), F.lit(ALL - 1)), lambda j: S.draw(F.lit(17), F.col("c_custkey") * 32 + j + 1))
    count = lambda u: F.floor(F.get(u, F.lit(0)) * 3).cast("int") + 1

    def plain(u):
        more = [S.syllable(u, at, FORMS, KINDS) for at in (1 + EACH * s for s in range(3))]
        return F.struct(count(u).alias("n"), F.concat(more[0], F.when(count(u) > 1, more[1]).otherwise(""), F.when(count(u) > 2, more[2]).otherwise("")).alias("word"), u.alias("u"))

    def stressed(w):
        word, u = w["word"], w["u"]
        vowels = F.filter(F.sequence(F.lit(1), F.length(word)), lambda i: F.contains(F.lit(KINDS["V"]), F.substr(word, i, F.lit(1))))
        place = F.get(vowels, F.floor(F.get(u, F.lit(ALL - 1)) * F.size(vowels)).cast("int"))
        accented = bound(place, lambda p: F.concat(F.substr(word, F.lit(1), p - 1), T.stress_accent(F.substr(word, p, F.lit(1))), F.substr(word, p + 1)))
        return F.struct(w["n"].alias("n"), F.when(F.get(u, F.lit(ALL - 2)) < STRESSED_SHARE, accented).otherwise(word).alias("word"))

    rows = table(spark, sf_dir, "customer").select("c_custkey", bound(bound(draws, plain), stressed).alias("w"))
    return rows.select("c_custkey", F.col("w.n").alias("syllables"), "w.word")


@query(RANKED_SQL + """, near AS (SELECT vec_id, string_agg(t_label::VARCHAR || ':' || t_id::VARCHAR, ' ' ORDER BY rank) AS alike FROM r WHERE rank <= 3 AND t_id <> vec_id GROUP BY vec_id),
v AS (SELECT vec_id, '<path d="M0 0H' || vec_id % 90 || 'V9Z"/>' AS outline FROM embeddings WHERE vec_id % 3 > 0)
SELECT e.vec_id, e.label, coalesce(q.quality::VARCHAR, 'unchecked') AS status, coalesce(near.alike, '') AS alike, coalesce(v.outline, '') AS outline
FROM embeddings e LEFT JOIN labels q ON q.doc_id = e.vec_id LEFT JOIN near ON near.vec_id = e.vec_id LEFT JOIN v ON v.vec_id = e.vec_id""")
def q_review_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a review page shows of each item: its verdict or `unchecked`, the items most like it, its outline; none lost."""
    items = table(spark, sf_dir, "embeddings").select("vec_id", "label")
    near = ranked(spark, sf_dir).where("rank <= 3 AND t_id <> vec_id")
    listed = F.array_sort(F.collect_list(F.struct("rank", F.concat(F.col("t_label").cast("string"), F.lit(":"), F.col("t_id").cast("string")).alias("t"))))
    alike = near.groupBy("vec_id").agg(F.array_join(F.transform(listed, lambda s: s["t"]), " ").alias("alike"))
    # a third of the items lack an outline, as when its file is missing
    outlines = items.where("vec_id % 3 > 0").select("vec_id", F.concat(F.lit('<path d="M0 0H'), (F.col("vec_id") % 90).cast("string"), F.lit('V9Z"/>')).alias("outline"))
    verdicts = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("vec_id"), F.col("quality").cast("string").alias("status"))
    rows = items.join(verdicts, "vec_id", "left").join(alike, "vec_id", "left").join(outlines, "vec_id", "left")
    return rows.na.fill("unchecked", ["status"]).na.fill("", ["alike", "outline"])


@query("""WITH a AS (SELECT n_nationkey AS glyph, n_regionkey AS class, n_nationkey % 4 < 2 AS is_mark, n_nationkey * 7 % 11 AS x FROM nation),
m AS (SELECT class, string_agg(glyph::VARCHAR, ' ' ORDER BY glyph) AS marks FROM a WHERE is_mark GROUP BY class), b AS (SELECT glyph, string_agg(class::VARCHAR || '=' || x, ' ' ORDER BY class) AS anchors FROM a WHERE NOT is_mark GROUP BY glyph)
SELECT 'class' AS kind, class::BIGINT AS key, marks AS value FROM m UNION ALL SELECT 'base', glyph::BIGINT, anchors FROM b UNION ALL SELECT 'mark', glyph::BIGINT, class::VARCHAR || '=' || x FROM a WHERE is_mark""")
def q_mark_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Anchors of marks and bases as three tables: the marks of each class once each, the anchors of each base by class,
    and the class and anchor of each mark."""
    n, is_mark = F.col("n_nationkey"), F.col("n_nationkey") % 4 < 2
    a = table(spark, sf_dir, "nation").select(n.alias("glyph"), F.col("n_regionkey").alias("class"), is_mark.alias("is_mark"), (n * 7 % 11).alias("x"))
    anchor = F.concat_ws("=", F.col("class").cast("string"), F.col("x").cast("string"))
    key = lambda c: F.col(c).cast("long").alias("key")
    text = lambda c: F.array_join(F.transform(c, lambda s: s.cast("string")), " ").alias("value")
    by_class = a.where("is_mark").groupBy(key("class")).agg(text(F.array_sort(F.collect_set("glyph"))))
    by_base = a.where("NOT is_mark").groupBy(key("glyph")).agg(text(F.transform(F.array_sort(F.collect_list(F.struct("class", anchor.alias("a")))), lambda s: s["a"])))
    marks = a.where("is_mark").select(key("glyph"), anchor.alias("value"))
    return by_class.withColumn("kind", F.lit("class")).unionByName(by_base.withColumn("kind", F.lit("base"))).unionByName(marks.withColumn("kind", F.lit("mark")))


@query(r"""WITH r AS (SELECT c_custkey, c_custkey % 3 > 0 AS held, c_custkey % 2 = 0 AS more FROM customer)
SELECT c_custkey, CASE WHEN held THEN 1 ELSE 0 END AS removed, FALSE AS holds,
'{' || chr(10) || '  "key": ' || c_custkey || CASE WHEN more THEN ',' || chr(10) || '  "list": [1,' || chr(10) || '2]' ELSE '' END || chr(10) || '}' AS text FROM r""")
def q_line_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records without the lines of one field: how many a check counts, that it counts none afterwards, and the text,
    without the comma that would then end the last field."""
    pattern, key = r'^\s*"outline"', F.col("c_custkey")
    held, more = key % 3 > 0, key % 2 == 0
    lines = [F.lit("{"), F.concat(F.lit('  "key": '), key.cast("string"), F.when(held | more, ",").otherwise("")), F.when(more, F.concat(F.lit('  "list": [1,\n2]'), F.when(held, ",").otherwise(""))), F.when(held, '  "outline": "M0 0"'), F.lit("}")]
    rows = table(spark, sf_dir, "customer").select("c_custkey", F.concat_ws("\n", *lines).alias("t"))
    after = T.drop_lines(F.col("t"), pattern)
    return rows.select("c_custkey", T.matching_lines(F.col("t"), pattern).alias("removed"), (T.matching_lines(after, pattern) > 0).alias("holds"), after.alias("text"))
