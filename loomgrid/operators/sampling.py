"""Reproducible draws, shuffles, quotas and splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import bound

MASK = 0xFFFFFFFF
#: Fixed values of the generator: the step of its counter here, and the shifts 15, 7, 14 and the 61 in draw().
STEP = 0x6D2B79F5


def _times(a: Column, b: Column) -> Column:
    """Product modulo 2**32 of two columns in [0, 2**32), in halves so that no bigint overflows."""
    low = a * b.bitwiseAND(F.lit(65535))
    high = (a * F.shiftright(b, 16)).bitwiseAND(F.lit(65535)) * 65536
    return (low + high).bitwiseAND(F.lit(MASK))


def draw(seed: Column, i: Column) -> Column:
    """The i-th draw, from 1, of a 32-bit counter generator, uniform in [0, 1): a pure expression without state.

    Each step's value is used several times by the next, so it is bound: else the expression doubles at each."""
    start = (seed.cast("long") + i.cast("long") * STEP).bitwiseAND(F.lit(MASK))
    first = lambda a: _times(a.bitwiseXOR(F.shiftright(a, 15)), a.bitwiseOR(F.lit(1)))
    second = lambda t: (t + _times(t.bitwiseXOR(F.shiftright(t, 7)), t.bitwiseOR(F.lit(61)))).bitwiseAND(F.lit(MASK)).bitwiseXOR(t)
    last = lambda t: t.bitwiseXOR(F.shiftright(t, 14)) / 4294967296.0
    return bound(bound(bound(start, first), second), last)


def quotas(sizes: DataFrame, key: str, n: str, total: int) -> DataFrame:
    """floor(total * share) of each group; what is left goes one by one to the largest shares, once around."""
    every = W.partitionBy().rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    base = F.floor(total * F.col(n) / F.sum(n).over(every))
    rank = F.row_number().over(W.orderBy(F.desc(n), key))
    q = sizes.withColumn("base", base).withColumn("rank", rank).withColumn("left", F.lit(total) - F.sum("base").over(every))
    return q.select(key, n, (F.col("base") + (F.col("rank") <= F.col("left")).cast("long")).alias("quota"))


def head_split(df: DataFrame, keys: list[str], order: list[str], share: float, cap: int) -> DataFrame:
    """df with `part`: the first share of each group (one row at least) is test, the next cap rows train, the rest unused."""
    w = W.partitionBy(*keys)
    rows = df.withColumn("__r", F.row_number().over(w.orderBy(*order))).withColumn("__n", F.count(F.lit(1)).over(w))
    test = F.greatest(F.lit(1), F.floor(F.col("__n") * share))
    return rows.withColumn("part", F.when(F.col("__r") <= test, "test").when(F.col("__r") <= test + cap, "train").otherwise("unused")).drop("__r", "__n")


#: Bins of the search for the boundary of a split.
BINS = 4096


def global_split(df: DataFrame, draw_col: str, tie: str, share: float) -> DataFrame:
    """df with `part`: the first share of all rows (one at least) in order of a draw in [0, 1) is test, the rest train.

    Counts by bins of the draw find the bin where the boundary lies, and only that bin's rows are ranked."""
    bin_of = F.floor(F.col(draw_col) * BINS).cast("int")
    counts = df.groupBy(bin_of.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    upto = F.sum("n").over(W.orderBy("bin").rowsBetween(W.unboundedPreceding, W.currentRow))  # BINS rows at most
    every = F.sum("n").over(W.partitionBy().rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    wanted = F.greatest(F.lit(1), F.floor(every * share))
    edge = counts.select("bin", upto.alias("upto"), "n", wanted.alias("wanted")).where("upto >= wanted")
    edge = edge.agg(F.min(F.struct("bin", (F.col("wanted") - F.col("upto") + F.col("n")).alias("room"))).alias("edge"))
    rows = df.crossJoin(F.broadcast(edge)).withColumn("bin", bin_of)  # one row, by construction
    inside = rows.where(F.col("bin") == F.col("edge.bin"))
    ranked = inside.withColumn("rank", F.row_number().over(W.partitionBy("bin").orderBy(draw_col, tie)))
    ranked = ranked.withColumn("part", F.when(F.col("rank") <= F.col("edge.room"), "test").otherwise("train")).drop("rank")
    clear = rows.where(F.col("bin") != F.col("edge.bin")).withColumn("part", F.when(F.col("bin") < F.col("edge.bin"), "test").otherwise("train"))
    return clear.unionByName(ranked).drop("bin", "edge")


def cover_letters(picked: Column, candidates: Column, letters: str) -> Column:
    """A bounded list of words, changed so that it has every letter for which there is a candidate.

    candidates: structs (letter, word) in the order of the letters, the word being the first of the whole pool with
    that letter, or null. A letter that no word has takes its candidate in place of the first word of its length
    without any of the letters, else of the last word. As no picked word has the letter then, the first word of the
    pool that has it is always outside the picked ones, so one word a letter is all that is needed of the pool."""
    plain = lambda w: F.translate(w, letters, "") == w

    def swap(words: Column, c: Column) -> Column:
        victims = F.transform(words, lambda w: (F.length(w) == F.length(c["word"])) & plain(w))
        at = F.coalesce(F.nullif(F.array_position(victims, F.lit(True)), F.lit(0)), F.size(words))
        return bound(at, lambda a: F.transform(words, lambda w, i: F.when(i + 1 == a, c["word"]).otherwise(w)))

    needless = lambda words, c: c["word"].isNull() | F.exists(words, lambda w: F.contains(w, c["letter"]))
    return F.aggregate(candidates, picked, lambda words, c: F.when(needless(words, c), words).otherwise(swap(words, c)))


def _among(letters: str, u: Column, skip: Column | None = None) -> Column:
    """The letter that a draw picks; skip: a position from 0 that is left out."""
    at = F.floor(u * (len(letters) - (skip is not None)))
    at = at if skip is None else at + (at >= skip).cast("int")
    return F.substr(F.lit(letters), (at + 1).cast("int"), F.lit(1))


def syllable(draws: Column, first: int, forms: list[tuple[float, str]], kinds: dict[str, str]) -> Column:
    """A syllable of one of several forms, chosen by a draw and cumulative shares; a further draw for each letter.

    A form is a pattern: a key of kinds is any of its letters, `=` the letter before it once more, and `D` a letter of
    kind E other than the C after it (the letters of C come first in E). first: the place of the form's draw."""
    word = F.lit("")
    upto = 1.0
    for share, pattern in reversed(forms):
        letters: list[Column] = []
        for k, p in enumerate(pattern):
            u = F.get(draws, F.lit(first + 1 + k))
            if p == "=":
                letters.append(letters[-1])
            elif p == "D":
                letters.append(_among(kinds["E"], u, F.floor(F.get(draws, F.lit(first + 2 + k)) * len(kinds["C"]))))
            else:
                letters.append(_among(kinds[p], u))
        text = F.concat(*letters)
        word = text if upto == 1.0 else F.when(F.get(draws, F.lit(first)) < upto, text).otherwise(word)
        upto = round(upto - share, 9)
    return word
