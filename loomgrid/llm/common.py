"""Shared-folder, hashing and tokenising helpers of the training-data operators."""

from __future__ import annotations

import ctypes
import hashlib
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager, suppress

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import ship as ship_package

#: Used only by a session on one machine that names no spark.checkpoint.dir, as in tests.
LOCAL_CHECKPOINT_DIR = "/tmp/checkpoints/loomgrid"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; also makes checkpoint() usable."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not named and not sc.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(named or LOCAL_CHECKPOINT_DIR)
    return named or LOCAL_CHECKPOINT_DIR


#: Rows of an Arrow batch: texts may be long, and a task holds several batches at once.
BATCH_ROWS = 1000
#: Groups whose counts may be broadcast.
MAX_GROUPS = 10_000


def ship(spark: SparkSession) -> SparkSession:
    """The package's modules on every Python worker, and Arrow batches of at most BATCH_ROWS rows in this session."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return ship_package(spark)


def send(df: DataFrame, value: object):
    """A broadcast of a value of bounded size for the Python workers that run functions of this package."""
    return ship(df.sparkSession).sparkContext.broadcast(value)


def tidy() -> None:
    """Give freed memory back to the system: a worker waits for its next task with little of it."""
    pa.default_memory_pool().release_unused()
    with suppress(OSError, AttributeError):  # only where the C library has it
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def remove(spark: SparkSession, path: str) -> None:
    """Remove a folder of any file system."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[str]:
    """A new folder in the shared one, removed on exit: nothing returned may read from it."""
    path = f"{shared_dir(spark)}/loomgrid-{uuid.uuid4().hex}"
    try:
        yield path
    finally:
        remove(spark, path)


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage in the shared folder; Spark's cleaner drops the files with the last reference."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def free_names(df: DataFrame, *wanted: str) -> list[str]:
    """Names for helper columns that begin no column name of df, whatever its columns are called."""
    have, prefix = [c.lower() for c in df.columns], "__"
    while any(c.startswith(prefix) for c in have):
        prefix += "_"
    return [prefix + w for w in wanted]


@contextmanager
def settings(spark: SparkSession, **values: str) -> Iterator[None]:
    """Session settings for the time of one block; keys are written with __ for a dot."""
    old = {}
    for key, value in values.items():
        name = key.replace("__", ".")
        old[name] = spark.conf.get(name, None)
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in old.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def smallest_hashes(df: DataFrame, key: Column, rows: int, per: str | None = None) -> DataFrame:
    """The rows of df with the smallest hashes of key: so many, or so many for each value of per.

    A threshold known from counts goes first, about twice as high as needed, so that the ordered limit
    sees a few times `rows` in all and not that many from every partition."""
    h = F.xxhash64(key)
    share = (h.cast("double") + 2.0**63) / 2.0**64
    if per is None:
        least = min(1.0, (2 * rows + 200) / max(1, df.count()))
        return df.where(share < least if least < 1 else F.lit(True)).orderBy(h, key).limit(rows)
    counts = df.groupBy(per).agg(F.count(F.lit(1)).alias("__n"))
    few = counts.limit(MAX_GROUPS + 1).count() <= MAX_GROUPS
    near = df.join(F.broadcast(counts) if few else counts, per).where(share * F.col("__n") < 2 * rows + 200).drop("__n")
    order = W.partitionBy(per).orderBy(h, key)
    return near.withColumn("__r", F.row_number().over(order)).where(F.col("__r") <= rows).drop("__r")


# --- hashing -----------------------------------------------------------------------------------

U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


# --- texts -------------------------------------------------------------------------------------

SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: All ASCII but letters and digits; bytes of other scripts belong to words.
NOT_ALNUM = np.array([i < 128 and not chr(i).isalnum() for i in range(256)])


def text_chunks(texts: pa.Array, max_bytes: int = 1 << 20) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets) of runs of whole texts of about max_bytes; null reads as empty."""
    if pa.types.is_large_string(texts.type) or pa.types.is_string_view(texts.type):
        texts = texts.cast(pa.string()) if texts.nbytes < 1 << 31 else texts
    if texts.null_count:
        texts = texts.fill_null("")
    if not len(texts):
        return
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    _, off, data = texts.buffers()
    off = np.frombuffer(off, dtype=kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    row = 0
    while row < len(texts):
        end = max(row + 1, int(np.searchsorted(off, off[row] + max_bytes, "right")) - 1)
        end = min(end, len(texts))
        yield row, data[off[row] : off[end]], off[row : end + 1] - off[row]
        row = end


def words(data: np.ndarray, off: np.ndarray, gaps: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words of each text and the number of words before each text (one more at the end)."""
    n = len(data)
    if not n:
        return (z := np.zeros(0, dtype=np.int64)), z, np.zeros(len(off), dtype=np.int64)
    inside = ~gaps[data]
    begin = inside.copy()
    begin[1:] &= ~inside[:-1]
    stop = inside.copy()
    stop[:-1] &= ~inside[1:]
    edge = off[(off > 0) & (off < n)]
    begin[edge] = inside[edge]
    stop[edge - 1] = inside[edge - 1]
    starts, ends = np.flatnonzero(begin), np.flatnonzero(stop) + 1
    return starts, ends, np.searchsorted(starts, off)


LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Longer words are hashed by BLAKE2.
LONG_WORD = 512
_MASKS = np.array([(1 << 8 * n) - 1 for n in range(9)], dtype=U)


def byte_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, halves: int = 2) -> list[np.ndarray]:
    """Independent 64-bit hashes of byte ranges, one or two of each.

    Eight bytes at a time go through a mixing function of the whole state, under two keys; so no sum or
    product that holds for one range holds for another, and ranges of up to eight bytes never collide."""
    size = ends - starts
    padded = np.concatenate((data, np.zeros(8, dtype=np.uint8)))
    eight = np.ndarray((len(data) + 1,), dtype="<u8", buffer=padded, strides=(1,))

    def step(half: int, state: np.ndarray, x: np.ndarray) -> np.ndarray:
        return mix(state ^ x) if half == 0 else mix((x << U(32) | x >> U(32)) + state * U(0xD6E8FEB86659FD93))

    x = eight[starts] & _MASKS[np.minimum(size, 8)]
    out = [step(half, size.astype(U) * U(0x9E3779B97F4A7C15) + U(0xA0761D6478BD642F + half), x) for half in range(halves)]
    live, at = np.flatnonzero(size > 8), 8
    while len(live) and at < LONG_WORD:
        x = eight[starts[live] + at] & _MASKS[np.minimum(size[live] - at, 8)]
        for half in range(halves):
            out[half][live] = step(half, out[half][live], x)
        at += 8
        live = live[size[live] > at]
    for i in live.tolist():
        digest = hashlib.blake2b(data[starts[i] : ends[i]].tobytes(), digest_size=16).digest()
        for half in range(halves):
            out[half][i] = int.from_bytes(digest[8 * half : 8 * half + 8], "little")
    return out


def word_digests(data: np.ndarray, off: np.ndarray, gaps: np.ndarray = SPACE, halves: int = 2) -> tuple[list[np.ndarray], np.ndarray]:
    """The hashes of each word, without case in A-Z, and the number of words before each text (one more at the end).

    What one hash finds the other, which is independent of it, can confirm."""
    starts, ends, first = words(data, off, gaps)
    return byte_hashes(LOWER[data], starts, ends, halves), first


class Places:
    """Where 64-bit keys stand in a sorted array of them: a table of their leading bits, then a short walk."""

    def __init__(self, keys: np.ndarray) -> None:
        self.keys = np.concatenate((keys.astype(U), np.zeros(1, dtype=U)))
        bits = max(8, (4 * len(keys)).bit_length())
        self.shift = U(64 - bits)
        edges = np.arange(1 << bits, dtype=U) << self.shift
        self.head = np.append(np.searchsorted(keys.astype(U), edges), len(keys)).astype(np.int32)

    def find(self, key: np.ndarray) -> np.ndarray:
        """The place of each key, -1 where it is not among them."""
        lead = (key >> self.shift).astype(np.int64)
        at, end = self.head[lead], self.head[lead + 1]
        out = np.where((self.keys[at] == key) & (at < end), at, -1)
        live = np.flatnonzero((out < 0) & (at + 1 < end))
        while len(live):
            at[live] += 1
            hit = self.keys[at[live]] == key[live]
            out[live[hit]] = at[live[hit]]
            live = live[~hit & (at[live] + 1 < end[live])]
        return out


def shingle_hashes(h: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the k-word shingles of each text, and their number before each text.

    first: number of words before each text. A text of 1 to k-1 words is one shingle; one without words has none."""
    n = np.diff(first)
    own = np.where(n >= k, n - k + 1, np.minimum(n, 1))
    before = np.concatenate(([0], np.cumsum(own)))
    row = np.repeat(np.arange(len(n)), own)
    at = first[row] + np.arange(before[-1]) - before[row]
    size = np.minimum(n[row], k)
    out = size.astype(U)
    for j in range(k):
        # the hash of a word takes part in the order of its place; short texts stop early
        valid = j < size
        term = mix(h[np.minimum(at + j, len(h) - 1)] + U((j + 1) * 0xD1342543DE82EF95 & (1 << 64) - 1)) if len(h) else out
        out = out + (term if valid.all() else np.where(valid, term, U(0)))
    return mix(out), before


# --- joins with hot keys -------------------------------------------------------------------------

#: A key is hot if it has more rows than this and more than one in MAX_GROUPS of all rows.
HOT_ROWS = 1000


def attach(rows: DataFrame, values: DataFrame, key: list[str], size: str) -> DataFrame:
    """Inner join of rows with values, which has one row a key; size: its column with the key's number of rows.

    At most MAX_GROUPS keys can have more than one in MAX_GROUPS of all rows, whatever the table, so the
    values of hot keys are broadcast and their rows stay where they lie; all other keys go by a plain join.
    Both sides are read twice, so they should be written or checkpointed tables."""
    total = values.agg(F.sum(size).alias("n")).first()["n"] or 0
    hot = F.col(size) > max(HOT_ROWS, total // MAX_GROUPS)
    few = values.where(hot)
    if few.isEmpty():
        return rows.join(values, key)
    here = rows.join(F.broadcast(few), key)
    there = rows.join(F.broadcast(few.select(*key)), key, "left_anti").join(values.where(~hot), key)
    return here.unionByName(there)


# --- bounded membership filters ------------------------------------------------------------------

#: Least and most bits of a filter: at 8 bits a key the larger one serves 8 million keys, and lets more
#: rows pass beyond that, which costs time and changes no result.
BLOOM_BITS = (1 << 18, 1 << 26)


def bloom_places(col: str, bits: int) -> list[Column]:
    """The places of a key in a filter, as columns __b0, __b1, __b2."""
    return [F.pmod(F.xxhash64(F.col(col).cast("long"), F.lit(seed)), F.lit(bits)).alias(f"__b{i}") for i, seed in enumerate((1, 2, 3))]


def bloom(keys: DataFrame, col: str) -> np.ndarray:
    """A Bloom filter of one integer column, sized by the number of keys: on the driver at most 1/8 of BLOOM_BITS' larger value in bytes."""
    keys = keys.where(F.col(col).isNotNull())
    bits = min(BLOOM_BITS[1], max(BLOOM_BITS[0], 1 << (8 * keys.count()).bit_length()))
    rows = (
        keys.select(F.explode(F.array(*bloom_places(col, bits))).alias("at"))
        .groupBy(F.shiftright("at", 5).alias("word"))
        .agg(F.expr("bit_or(shiftleft(1L, cast(pmod(at, 32) AS int)))").alias("v"))
        .toArrow()
    )
    out = np.zeros(bits >> 5, dtype=np.uint32)
    out[rows.column("word").to_numpy()] = rows.column("v").to_numpy().astype(np.uint32)
    return out


def probe(table: np.ndarray, places: list[pa.Array]) -> np.ndarray:
    """Which keys may be in a filter; none that is in it is missed."""
    ok = np.ones(len(places[0]), dtype=bool)
    for x in places:
        at = x.fill_null(0).to_numpy(zero_copy_only=False)
        ok &= ((table[at >> 5] >> (at & 31).astype(np.uint32)) & np.uint32(1)).astype(bool)
    return ok


def in_bloom(df: DataFrame, table: np.ndarray, col: str) -> DataFrame:
    """The rows of df whose key may be in the filter, and those without a key; only the places of the key go to Python."""
    held = send(df, table)

    @F.arrow_udf("boolean")
    def among(a: pa.Array, b: pa.Array, c: pa.Array) -> pa.Array:
        return pa.array(probe(held.value, [a, b, c]))

    return df.where(F.col(col).isNull() | among(*bloom_places(col, len(table) * 32)))
