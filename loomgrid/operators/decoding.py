"""Decoding of characters held as 8 x 8 bitmaps packed into one bigint: matching against books of templates.

A book is a bounded set of templates in one row, so that every character meets it where it lies: choosing the
best template is an expression without a join or a shuffle, and a distance is one exclusive or and a bit count."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import STRESSED
from .common import BROADCAST_ROWS, bound

CELLS = 64


def packed(mask: Column) -> Column:
    """64 cells of 0 and 1 as one bigint, the first cell in the highest bit."""
    return F.aggregate(mask, F.lit(0).cast("long"), lambda acc, b: F.shiftleft(acc, 1).bitwiseOR(b.cast("long")))


def zone(first: int, last: int) -> int:
    """The bits of the cells from first up to, not including, last."""
    bits = sum(1 << (CELLS - 1 - i) for i in range(first, last))
    return bits - (1 << 64) if bits >> 63 else bits


def ink_in(bits: Column, where: int) -> Column:
    return F.bit_count(bits.bitwiseAND(F.lit(where).cast("long")))


def book(templates: DataFrame) -> DataFrame:
    """One row with the column book: all templates (pool, id, label, bits); more than BROADCAST_ROWS are refused."""
    if templates.limit(BROADCAST_ROWS + 1).count() > BROADCAST_ROWS:
        raise ValueError(f"more than {BROADCAST_ROWS} templates")
    return F.broadcast(templates.agg(F.array_sort(F.collect_list(F.struct("pool", "id", "label", "bits"))).alias("book")))


def best(bits: Column, where: int, pool: str, keep=None) -> Column:
    """Struct d, id, label of the template of a pool with the fewest unlike cells in a zone; ties to the smaller id.

    keep: a further condition on the templates, such as the label that another slot was read as. Null without any."""
    mine = F.filter("book", lambda t: (t["pool"] == pool) & (F.lit(True) if keep is None else keep(t)))
    unlike = lambda b, t: F.bit_count(b.bitwiseXOR(t["bits"]).bitwiseAND(F.lit(where).cast("long")))
    return bound(bits, lambda b: F.array_min(F.transform(mine, lambda t: F.struct(unlike(b, t).alias("d"), t["id"].alias("id"), t["label"].alias("label")))))


def score(found: Column, where: int) -> Column:
    """1 less the share of unlike cells of the zone."""
    return 1 - found["d"] / float(bin(where & ((1 << 64) - 1)).count("1"))


def typed_words(rows: DataFrame, word: str, order: str, kind: str, value: str, first: str, least: float, run: str) -> DataFrame:
    """rows with `type` and `spilled`: a word's first character is of the first kind unless surely another;
    of characters of the kind `run` in a row, all but the first are spilled."""
    w = W.partitionBy(word).orderBy(order)
    prior = (F.row_number().over(w) == 1) & (F.col(kind) != first) & (F.col(value) < least)
    rows = rows.withColumn("type", F.when(prior, first).otherwise(F.col(kind)))
    again = F.lag("type").over(w) == run
    return rows.withColumn("spilled", F.coalesce((F.col("type") == run) & again, F.lit(False)))


def last_of(role: Column, value: Column, order: Column) -> Column:
    """The value of the last row of a role, which may be null; null without such a row."""
    return F.max_by(F.when(role, F.struct(value.alias("v"))), F.when(role, order))["v"]


def stressed(text: Column) -> Column:
    """A vowel with its accent; all else as it is."""
    names = F.create_map(*[F.lit(x) for pair in STRESSED.items() for x in pair])
    return F.coalesce(F.try_element_at(names, text), text)
