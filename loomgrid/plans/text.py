"""Queries of scalar expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from .registry import query, table

_NAMES = ", ".join(f"WHEN '{k.replace(chr(39), chr(39) * 2)}' THEN '{v}'" for k, v in T.NAMED.items()).replace(", WHEN", " WHEN")


@query(f"""WITH c AS (SELECT p_partkey, s, unnest(string_split(s, '')) AS c, generate_subscripts(string_split(s, ''), 1) AS i FROM (SELECT p_partkey, p_name || '¿ž ' || p_type AS s FROM part))
SELECT p_partkey, string_agg(CASE WHEN regexp_full_match(c, '[A-Za-z0-9_]') THEN c ELSE coalesce(CASE c {_NAMES} END, 'u' || lower(to_hex(unicode(c)))) END, '' ORDER BY i) AS slug FROM c GROUP BY p_partkey""")
def q_slug(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", T.slug(F.concat("p_name", F.lit("¿ž "), "p_type")).alias("slug"))


@query("""SELECT n_nationkey, (n_nationkey * 6 - 5) AS off, CASE WHEN off < 0 OR off > 127 THEN 'external' WHEN off <= 3 THEN 'punctuation' WHEN off <= 13 THEN 'number' WHEN off <= 17 THEN 'tenthPower' WHEN off <= 41 THEN 'primary'
WHEN off <= 47 THEN 'secondary' WHEN off <= 54 THEN 'tertiary' WHEN off <= 77 THEN 'consonantal' WHEN off <= 79 THEN 'placeholder' WHEN off <= 112 THEN 'diacritic' WHEN off = 127 THEN 'grid' ELSE 'unassigned' END AS class,
upper(class) || '_' || lpad(off::VARCHAR, 2, '0') AS id FROM nation""")
def q_offset_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    off = F.col("n_nationkey") * 6 - 5
    return table(spark, sf_dir, "nation").select("n_nationkey", off.alias("off"), T.offset_class(off).alias("class"), T.stable_id(off).alias("id"))


@query("""SELECT n_nationkey, 'U+' || lpad(upper(to_hex(n_nationkey + 62720)), 5, '0') AS label, n_nationkey + 62720 AS cp FROM nation""")
def q_code_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Code points to labels and back."""
    label = T.code_point_label(F.col("n_nationkey") + 62720)
    return table(spark, sf_dir, "nation").select("n_nationkey", label.alias("label"), F.conv(F.substring(label, 3, 5), 16, 10).cast("int").alias("cp"))


@query("""SELECT n_nationkey, list_reduce(list_transform([7, 6, 5, 4, 3, 2, 1, 0], lambda k: ((n_nationkey >> k) & 1)::VARCHAR), lambda a, b: a || b) AS bits, nullif(n_nationkey, 0) AS back FROM nation""")
def q_bitstrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation").select("n_nationkey", T.bits(F.col("n_nationkey"), 8).alias("b"))
    return n.select("n_nationkey", F.array_join("b", "").alias("bits"), T.from_bits(F.col("b")).alias("back"))


@query(r"""WITH s AS (SELECT page_id, html, CASE WHEN contains(html, 'data-seen="1"') THEN 'already_fixed' WHEN NOT regexp_matches(html, '<p\b[^>]*>') THEN 'no_tag' ELSE 'patched' END AS status FROM (SELECT page_id, CASE WHEN page_id % 5 = 0 THEN html || '<i data-seen="1">' ELSE html END AS html FROM pages))
SELECT page_id, status, length(CASE WHEN status = 'patched' THEN regexp_replace(html, '(<p\b)', '\1 data-seen="1"', 'g') ELSE html END)::INT AS size FROM s""")
def q_regex_patch(spark: SparkSession, sf_dir: str) -> DataFrame:
    html = F.when(F.col("page_id") % 5 == 0, F.concat("html", F.lit('<i data-seen="1">'))).otherwise(F.col("html"))
    fixed, status = T.add_attribute(html, "p", 'data-seen="1"', "data-seen")
    return table(spark, sf_dir, "pages").select("page_id", status.alias("status"), F.length(fixed).alias("size"))


@query(r"""SELECT page_id, len(string_split(t, chr(10)))::INT AS lines, length(t)::INT AS size FROM (SELECT page_id, array_to_string(list_filter(string_split(replace(html, '><', '>' || chr(10) || '<'), chr(10)), lambda x: NOT regexp_matches(x, '^\s*<(li|p)\b')), chr(10)) AS t FROM pages)""")
def q_drop_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = T.drop_lines(F.replace(F.col("html"), F.lit("><"), F.lit(">\n<")), r"^\s*<(li|p)\b")
    return table(spark, sf_dir, "pages").select("page_id", F.size(F.split(t, "\n")).alias("lines"), F.length(t).alias("size"))


@query("""SELECT p_type, split_part(p_type, ' ', 1) AS family, count(*) AS n FROM part GROUP BY p_type, family""")
def q_prefix_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").groupBy("p_type", F.split_part("p_type", F.lit(" "), F.lit(1)).alias("family")).agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT doc_id, length(translate(lower(text), 'áéíóúàèçñäöü', 'aeiouaecnaou'))::INT AS size, md5(translate(lower(text), 'áéíóúàèçñäöü', 'aeiouaecnaou')) AS digest FROM documents""")
def q_accent_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.translate(F.lower("text"), "áéíóúàèçñäöü", "aeiouaecnaou")
    return table(spark, sf_dir, "documents").select("doc_id", F.length(t).alias("size"), F.md5(t).alias("digest"))


@query("""SELECT event_id, concat(nullif(event_type, 'view'), CASE WHEN value > 50 THEN '+' END, nullif((user_id % 3)::VARCHAR, '0')) AS short FROM events""")
def q_default_elision(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Only parts that are not the default are written, one after the other."""
    parts = [F.nullif("event_type", F.lit("view")), F.when(F.col("value") > 50, "+"), F.nullif((F.col("user_id") % 3).cast("string"), F.lit("0"))]
    return table(spark, sf_dir, "events").select("event_id", F.concat_ws("", *parts).alias("short"))


@query("""SELECT event_id, CASE WHEN TRY_CAST(k AS DOUBLE) BETWEEN 10 AND 60 THEN TRY_CAST(k AS DOUBLE) END AS n, regexp_matches(event_type, '^[a-z]{1,6}$') AS safe FROM (SELECT event_id, event_type, regexp_extract(props, '([0-9]+)', 1) AS k FROM events)""")
def q_bounded_number(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.regexp_extract("props", "([0-9]+)", 1)
    return table(spark, sf_dir, "events").select("event_id", T.bounded_number(k, 10, 60).alias("n"), F.col("event_type").rlike("^[a-z]{1,6}$").alias("safe"))


@query("""SELECT vec_id, round(0.299 * r + 0.587 * g + 0.114 * b, 6) AS luma, round((r + g + b) / 3, 6) AS grey, round(1 - (r + g + b) / 765, 6) AS ink, 0.299 * r + 0.587 * g + 0.114 * b < 128 AS dark
FROM (SELECT vec_id, 128 + 100 * embedding[1]::DOUBLE AS r, 128 + 100 * embedding[2]::DOUBLE AS g, 128 + 100 * embedding[3]::DOUBLE AS b FROM embeddings)""")
def q_luminance(spark: SparkSession, sf_dir: str) -> DataFrame:
    r, g, b = (128 + 100 * F.get("embedding", F.lit(i)).cast("double") for i in range(3))
    luma = 0.299 * r + 0.587 * g + 0.114 * b
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(luma, 6).alias("luma"), F.round((r + g + b) / 3, 6).alias("grey"), F.round(1 - (r + g + b) / 765, 6).alias("ink"), (luma < 128).alias("dark"))


@query("""SELECT vec_id, CASE WHEN embedding[1] > 0.1 THEN 'jpeg' WHEN embedding[1] < -0.1 THEN 'png' ELSE 'unknown' END AS format, (vec_id % 30) // 5 AS "row", vec_id % 5 AS col FROM embeddings""")
def q_sniff_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Format by first bytes of data URLs with and without a head, and the place of a cell in a grid of five columns."""
    first = F.get("embedding", F.lit(0))
    start = F.when(first > 0.1, "FFD8FF").when(first < -0.1, "89504E470D0A1A0A").otherwise("474946")
    body = F.base64(F.unhex(F.concat(start, F.lpad(F.hex("vec_id"), 16, "0"))))
    url = F.when(F.col("vec_id") % 2 == 0, F.concat(F.lit("data:image/x;base64,"), body)).otherwise(body)
    return table(spark, sf_dir, "embeddings").select("vec_id", T.image_format(T.data_url(url)).alias("format"), F.floor(F.col("vec_id") % 30 / 5).alias("row"), (F.col("vec_id") % 5).alias("col"))
