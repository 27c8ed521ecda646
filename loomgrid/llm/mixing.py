"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Every row draws u from a hash of its identifier and gets the exponential key -ln(u) / quality. Within
a source, rows in order of the key are a weighted sample without replacement. A source takes whole
epochs first and then rows in that order up to what is left of its target; the last row is taken where
that comes nearer to the target. The order statistic is found by a radix search on the logarithm of the
key, in DIGITS bits a level; rows share a code only if their keys agree to about 14 digits, so no source is
sorted, or even gathered, in one task, whatever its qualities.

Defined cases: a missing identifier draws by the text; null text has size 0 and quality 1; a null source is a source of its own, placed last;
sources without words have target 0; rows repeated under one identifier draw the same key and are
ordered by a hash of their text and then taken alike; very long texts count whole; ties of the key go to
the smaller identifier; an empty table gives an empty result; extra columns are kept, and helper columns get
names that the table does not have. The table of sources, one row each, is ordered as a whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import MAX_GROUPS, cut, free_names

#: Sources by code point, null last, weigh these values in turn.
WEIGHTS = (3, 1, 2)
#: Words of the mix for each word of the input, and the most epochs of one source.
SHARE, MOST = 1.5, 2.0
#: Bits of the code of a key that each level of the search settles: the logarithm, between -64 and 64, in 2**-46ths.
DIGITS = (14, 13, 13, 13)


def word_count(text: Column) -> Column:
    """Number of runs of characters that are not ASCII white space; null has none."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def quality(text: Column) -> Column:
    """Weight of a text in (0, 1]: the share of ASCII letters, spaces and non-ASCII characters, not under 0.05."""
    t = F.coalesce(text, F.lit(""))
    n = F.length(t)
    plain = F.length(F.translate(t, "0123456789!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~", ""))
    return F.when(n == 0, F.lit(1.0)).otherwise(F.greatest(F.lit(0.05), plain / n))


def targets(sizes: DataFrame) -> DataFrame:
    """Source, source_size, target of each source: shares by weight, none above MOST times its size.

    Filling every source to min(MOST * size, level * weight) is where resharing the excess by weight
    ends; the level follows from sources in order of the level at which they are full."""
    turn = F.pmod(F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1, F.lit(len(WEIGHTS)))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in WEIGHTS]), (turn + 1).cast("int"))
    t = sizes.withColumn("weight", weight).withColumn("most", F.col("source_size") * MOST).withColumn("full_at", F.col("most") / F.col("weight"))
    every = W.partitionBy().rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    order = W.orderBy("full_at", F.col("source").asc_nulls_last())
    before, rest = order.rowsBetween(W.unboundedPreceding, -1), order.rowsBetween(0, W.unboundedFollowing)
    # the level if all before this one are full and none from here on is
    level = (F.sum("source_size").over(every) * SHARE - F.coalesce(F.sum("most").over(before), F.lit(0.0))) / F.sum("weight").over(rest)
    t = t.withColumn("level", level).withColumn("first_open", F.min(F.when(F.col("level") <= F.col("full_at"), F.struct("full_at", "level"))).over(every))
    level = F.coalesce(F.col("first_open.level"), F.lit(float("inf")))
    return t.select("source", "source_size", F.least(F.col("most"), level * F.col("weight")).alias("target"))


def _attach(rows: DataFrame, small: DataFrame) -> DataFrame:
    """Join on source, null with null; broadcast only if the small side is small."""
    fits = small.limit(MAX_GROUPS + 1).count() <= MAX_GROUPS
    small = small.withColumnRenamed("source", "__source")
    return rows.join(F.broadcast(small) if fits else small, rows["source"].eqNullSafe(small["__source"]), "left").drop("__source")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """Id, size, source, source_size, target, taken of every row of docs."""
    size = word_count(F.col("text"))
    tie = F.xxhash64(F.coalesce(F.col("text"), F.lit("")))
    digest = F.md5(F.coalesce(F.col("id").cast("string"), F.concat(F.lit("text "), tie.cast("string"))))
    u = (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)
    own = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(source_col).alias("source"))
    key = -F.log(u) / quality(F.col("text"))
    rows = own.select("id", "source", size.alias("size"), key.alias("key"), tie.alias("tie"))
    # a monotone map of the key onto whole numbers; u lies between 2**-53 and 1, so the logarithm stays within bounds
    code = F.floor((F.log(F.greatest(F.col("key"), F.lit(1e-27))) + 64) * float(1 << 46)).cast("long")
    rows = cut(rows.withColumn("code", code))
    goal = cut(targets(rows.groupBy("source").agg(F.sum("size").alias("source_size"))))
    goal = goal.withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long"))
    goal = goal.withColumn("left", F.col("target") - F.col("epochs") * F.col("source_size"))
    rows = _attach(rows, goal)

    # radix search: per source, the code up to which whole bins fit into what is left
    edge = goal.select("source", F.col("left").alias("room"), F.lit(0).cast("long").alias("low"))
    shift = sum(DIGITS)
    for digits in DIGITS:
        inside = _attach(rows.select("source", "code", "size"), edge).where(F.shiftright("code", shift) == F.col("low"))
        shift -= digits
        bins = inside.groupBy("source", "room", F.shiftright("code", shift).alias("bin")).agg(F.sum("size").alias("words"))
        upto = W.partitionBy("source").orderBy("bin").rowsBetween(W.unboundedPreceding, W.currentRow)
        bins = bins.withColumn("upto", F.sum("words").over(upto)).where("upto > room")
        found = bins.groupBy("source").agg(F.min(F.struct("bin", "upto", "words", "room")).alias("b"))
        edge = cut(found.select("source", (F.col("b.room") - F.col("b.upto") + F.col("b.words")).alias("room"), F.col("b.bin").alias("low")))
    # rows below the found code are in, rows above it out; only those of the code itself are sorted
    placed = _attach(rows, edge.withColumnRenamed("low", "edge"))
    at_edge = placed.where("code = edge")
    order = W.partitionBy("source").orderBy("key", "id", "tie").rowsBetween(W.unboundedPreceding, W.currentRow)
    at_edge = at_edge.withColumn("upto", F.sum("size").over(order))
    nearer = (F.col("upto") - F.col("size") < F.col("room")) & (F.col("upto") - F.col("room") < F.col("room") - F.col("upto") + F.col("size"))
    at_edge = at_edge.withColumn("in", (F.col("upto") <= F.col("room")) | nearer).drop("upto")
    # a source without an edge has room for all its rows only if nothing was left over
    below = placed.where("edge is null or code != edge").withColumn("in", F.when(F.col("edge").isNull(), F.col("left") > 0).otherwise(F.col("code") < F.col("edge")))
    out = below.unionByName(at_edge)
    return out.select("id", "size", "source", "source_size", "target", (F.col("size") * (F.col("epochs") + F.col("in").cast("int"))).alias("taken"), "tie")


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The rows of docs in the mix, each as often as it is taken, all columns as they were."""
    own, text, drawn, tie, times, copy = free_names(docs, "own", "text", "drawn", "tie", "times", "copy")
    out = mix(docs, id_col, text_col, source_col).where("taken > 0")
    # rows repeated under one identifier with one text are taken alike
    taken = out.groupBy(F.col("id").alias(drawn), F.col("tie").alias(tie)).agg(F.max((F.col("taken") / F.col("size")).cast("int")).alias(times))
    marked = docs.withColumn(own, docs[id_col]).withColumn(text, F.xxhash64(F.coalesce(docs[text_col], F.lit(""))))
    joined = marked.join(taken, F.col(own).eqNullSafe(F.col(drawn)) & (F.col(text) == F.col(tie)))
    return joined.withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(times)))).select(*[F.col(f"`{c}`") for c in docs.columns])
