"""Near-duplicate documents by SuperMinHash, banding, verification and union-find.

SuperMinHash: element e draws, in round j, a fraction r and the j-th entry p of a random permutation
of the M slots (a Fisher-Yates shuffle carried from round to round), and slot p takes the minimum of
j + r. Values of round j are all under j + 1, so a text is finished after the first round that leaves
no slot empty. Rounds run for all texts of a chunk at once.

Words are known by two independent 64-bit hashes. Signatures come from one of them; sizes, classes and
links are settled on the other as well, so unlike words do not pass for equal ones.

Texts with the same set are one class from the start. Band keys of the classes are grouped; each
bucket first compares its members with the smallest of them, as a star. Buckets whose members then are
in different components are compared further, in blocks: members outside the bucket's largest
component meet all its members, a block of sets against a slice of sets in one matrix product that
returns links only. So a bucket of near copies costs one comparison a member, no pairs are written
out, and no link between different texts that share a bucket is lost. Every link is confirmed on the
full sets.

Defined cases: a null or empty text, or one without words, has no set and is linked with nothing; a
text with fewer words than a shingle has its whole sequence as the only shingle. Rows without an
identifier are linked with nothing and stay. Rows repeated under one identifier are one document. Very
long texts are read whole; an empty table gives an empty result; of a tie the smallest identifier
stands for the group. Other columns play no part, and helper columns get names that the table does not
have.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import U, attach, bloom, bloom_places, cut, free_names, mix, probe, send, settings, ship, shingle_hashes, text_chunks, tidy, word_digests
from .components import connected_components

#: 32 bands of 5 slots: a pair with similarity 0.8 is missed with probability (1 - 0.8**5)**32 = 3e-6.
BANDS, ROWS = 32, 5
SLOTS = BANDS * ROWS
#: Elements whose permutations are held at once.
ELEMENTS = 1 << 16
#: Members of one slice and of one block of a bucket; shingles of the matrices that are multiplied.
SLICE, BLOCK, WIDTH = 512, 512, 1 << 15
EMPTY = np.iinfo(np.int64).max


def signatures(h: np.ndarray, before: np.ndarray, slots: int = SLOTS) -> np.ndarray:
    """SuperMinHash values, round << 32 | fraction, of sets h[before[i]:before[i+1]]; EMPTY for an empty set."""
    sets = len(before) - 1
    out = np.full((sets, slots), EMPTY, dtype=np.int64)
    first = 0
    while first < sets:
        last = max(first + 1, int(np.searchsorted(before, before[first] + ELEMENTS, "right")) - 1)
        last = min(last, sets)
        part = h[before[first] : before[last]]
        own = np.repeat(np.arange(last - first), np.diff(before[first : last + 1]))
        sig = out[first:last].reshape(-1)
        live = np.arange(len(part))
        perm = None
        for j in range(slots):
            x = mix(part[live] + U(((j + 1) * 0x9E3779B97F4A7C15) & (1 << 64) - 1))
            k = (j + (((x & U(0xFFFFFFFF)) * U(slots - j)) >> U(32)).astype(np.int64)).astype(np.int64)
            if perm is None:
                slot = k
            else:
                slot = perm[live, k].astype(np.int64)
                perm[live, k] = perm[live, j]
            np.minimum.at(sig, own[live] * slots + slot, (j << 32) + (x >> U(32)).astype(np.int64))
            unfinished = (sig.reshape(-1, slots) == EMPTY).any(axis=1)
            stay = unfinished[own[live]]
            if not stay.any():
                break
            if perm is None:
                # permutations are needed from the second round on, by unfinished sets alone
                part, own, k = part[stay], own[stay], k[stay]
                live = np.arange(len(part))
                perm = np.tile(np.arange(slots, dtype=np.uint8 if slots <= 256 else np.uint16), (len(part), 1))
                perm[live, k] = 0
            else:
                live = live[stay]
        first = last
    return out


def band_keys(sig: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """One 64-bit key per set and band."""
    x = sig.reshape(len(sig), bands, rows).astype(U)
    out = np.broadcast_to(mix(np.arange(1, bands + 1, dtype=U)), (len(sig), bands))
    for r in range(rows):
        out = mix(out ^ x[:, :, r])
    return out.view(np.int64)


def shingle_sets(word: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text, of one of the two word hashes, and their number before each text."""
    h, before = shingle_hashes(word, first, k)
    for a, b in zip(before[:-1].tolist(), before[1:].tolist(), strict=True):
        h[a:b].sort()
    keep = np.ones(len(h), dtype=bool)
    keep[1:] = h[1:] != h[:-1]
    keep[before[:-1][before[:-1] < len(h)]] = True
    total = np.concatenate(([0], np.cumsum(keep)))
    return h[keep], total[before]


def _total(h: np.ndarray, before: np.ndarray) -> np.ndarray:
    """One number of each set, whatever its order."""
    sums = np.concatenate(([U(0)], np.cumsum(mix(h ^ U(0xA5A5A5A5)), dtype=U)))
    return (sums[before[1:]] - sums[before[:-1]]).view(np.int64)


def _profiles(k: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, data, off in text_chunks(batch.column(1)):
                word, first = word_digests(data, off)
                h, before = shingle_sets(word[0], first, k)
                other, other_before = shingle_sets(word[1], first, k)
                n = np.maximum(np.diff(before), np.diff(other_before))
                d1, d2 = _total(h, before), _total(other, other_before)
                keys = band_keys(signatures(h, before))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1) * BANDS, pa.int32()), pa.array(keys.reshape(-1)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(row, len(n)), pa.array(n), pa.array(d1), pa.array(d2), lists], ["id", "n", "d1", "d2", "keys"])
        tidy()

    return run


def _sets(own: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    """id, set (packed sorted hashes) of the rows of own that wanted may name; filter and sets share one Python worker."""
    table = bloom(wanted, "id")
    held, bits = send(own, table), len(table) * 32

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = held.value
        for batch in batches:
            batch = batch.filter(pa.array(probe(table, [batch.column(i) for i in (2, 3, 4)])))
            for row, data, off in text_chunks(batch.column(1)):
                word, first = word_digests(data, off)
                h, before = shingle_sets(word[1], first, k)
                raw = pa.Array.from_buffers(pa.large_binary(), len(before) - 1, [None, pa.py_buffer((before * 8).astype(np.int64)), pa.py_buffer(np.ascontiguousarray(h))])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(row, len(before) - 1), raw.cast(pa.binary())], ["id", "set"])
        tidy()

    return own.where("id is not null").select("id", "text", *bloom_places("id", bits)).mapInArrow(run, "id long, set binary")


def _linked(a: Column, b: Column, percent: int) -> Column:
    @F.arrow_udf("boolean")
    def linked(x: pa.Array, y: pa.Array) -> pa.Array:
        out = []
        for p, q in zip(x, y, strict=True):
            p, q = np.frombuffer(p.as_buffer(), dtype=U), np.frombuffer(q.as_buffer(), dtype=U)
            both = np.sort(np.concatenate((p, q)))
            common = int((both[1:] == both[:-1]).sum())
            out.append(100 * common >= percent * (len(p) + len(q) - common))
        return pa.array(out, pa.bool_())

    return linked(a, b)


def _verified(pairs: DataFrame, own: DataFrame, k: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets reach the similarity."""
    with settings(own.sparkSession, spark__sql__execution__arrow__maxRecordsPerBatch="500"):
        ends = pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).distinct()
        sets = _sets(own, ends, k)
        wide = pairs.join(sets.select(F.col("id").alias("a"), F.col("set").alias("sa")), "a")
        wide = wide.join(sets.select(F.col("id").alias("b"), F.col("set").alias("sb")), "b")
        return cut(wide.where(_linked(F.col("sa"), F.col("sb"), percent)).select("a", "b"))


def _cross_links(own: list[np.ndarray], comp: np.ndarray, ask: np.ndarray, answer: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions of linked sets, one of ask and one of answer, that are in different components."""
    size = np.array([len(x) for x in own], dtype=np.int64)
    found: list[tuple[np.ndarray, np.ndarray]] = []
    at = 0
    while at < len(ask):
        end = at + 1
        while end < len(ask) and size[ask[at : end + 1]].sum() <= WIDTH:
            end += 1
        part = ask[at:end]
        values = np.concatenate([own[i] for i in part])
        known = np.unique(values)
        left = np.zeros((len(part), len(known)), dtype=np.float32)
        left[np.repeat(np.arange(len(part)), size[part]), np.searchsorted(known, values)] = 1
        for i in range(0, len(answer), 256):
            group = answer[i : i + 256]
            values = np.concatenate([own[j] for j in group])
            place = np.minimum(np.searchsorted(known, values), len(known) - 1)
            hit = known[place] == values
            right = np.zeros((len(group), len(known)), dtype=np.float32)
            right[np.repeat(np.arange(len(group)), size[group])[hit], place[hit]] = 1
            common = (left @ right.T).astype(np.int64)
            union = size[part][:, None] + size[group][None, :] - common
            r, c = np.nonzero((100 * common >= percent * union) & (comp[part][:, None] != comp[group][None, :]))
            found.append((part[r], group[c]))
        at = end
    return tuple(np.concatenate([f[i] for f in found]) if found else np.zeros(0, dtype=np.int64) for i in (0, 1))


def _blocks(percent: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Links of runs of rows with the same (key, block, slice); rows are (key, block, slice, role, doc, comp, set)."""

    def links(rows: pa.Table, first: int, last: int) -> tuple[np.ndarray, np.ndarray]:
        part = rows.slice(first, last - first)
        role, doc, comp = (part.column(c).to_numpy() for c in ("role", "doc", "comp"))
        own = [np.frombuffer(x.as_buffer(), dtype=U) for x in part.column("set")]
        a, b = _cross_links(own, comp, np.flatnonzero(role > 0), np.flatnonzero(role != 1), percent)
        return doc[a], doc[b]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def whole(rows: pa.Table, close: bool) -> tuple[pa.RecordBatch | None, int]:
            """Links of the complete runs, and where the last, open run starts."""
            key, block, piece = (rows.column(c).to_numpy() for c in ("key", "block", "slice"))
            edge = np.flatnonzero((key[1:] != key[:-1]) | (block[1:] != block[:-1]) | (piece[1:] != piece[:-1])) + 1
            bounds = [0, *edge.tolist(), *([len(key)] if close else [])]
            found = [links(rows, x, y) for x, y in zip(bounds[:-1], bounds[1:], strict=True)]
            if not found:
                return None, bounds[-1]
            columns = [pa.array(np.concatenate([f[i] for f in found]), pa.int64()) for i in (0, 1)]
            return pa.RecordBatch.from_arrays(columns, ["a", "b"]), bounds[-1]

        for batch in batches:
            held.append(batch)
            rows = pa.Table.from_batches(held)
            out, start = whole(rows, close=False)
            if out is not None:
                yield out
                held = rows.slice(start).to_batches()
        if held:
            out, _ = whole(pa.Table.from_batches(held), close=True)
            if out is not None:
                yield out

    return run


def _open_buckets(labelled: DataFrame) -> DataFrame:
    """Rows (key, block, slice, role, doc, comp) of buckets with members in different components.

    Of buckets with the same members one is enough. role 0: answers; 1: asks; 2: both."""
    by_comp = labelled.groupBy("key", "comp").agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("doc").cast("decimal(38,0)")).alias("members"))
    by_key = by_comp.groupBy("key").agg(F.sum("n").alias("n"), F.sum("members").alias("members"), F.max(F.struct("n", "comp")).alias("main"))
    # pairs with the smallest member are known from the star, so two members are no news
    by_key = by_key.where("n > main.n and n > 2").groupBy("members", "n").agg(F.min(F.struct("key", "main")).alias("k"))
    by_key = cut(by_key.select("k.key", F.col("n").alias("size"), F.col("k.main.comp").alias("main"), F.col("k.main.n").alias("inside")))
    rows = attach(labelled, by_key, ["key"], "size")
    rows = rows.withColumn("slices", F.ceil(F.col("size") / SLICE).cast("int")).withColumn("blocks", F.ceil((F.col("size") - F.col("inside")) / BLOCK).cast("int"))
    asks = F.col("comp") != F.col("main")
    one = (F.col("slices") == 1) & (F.col("blocks") == 1)
    own_slice, own_block = F.pmod(F.xxhash64("doc"), F.col("slices")).cast("int"), F.pmod(F.xxhash64("doc", F.lit(1)), F.col("blocks")).cast("int")
    place = lambda block, piece, role: F.struct(block.cast("int").alias("block"), piece.cast("int").alias("slice"), role.cast("int").alias("role"))
    zero = F.lit(0)
    answers = F.transform(F.sequence(zero, F.col("blocks") - 1), lambda i: place(i, own_slice, zero))
    asking = F.transform(F.sequence(zero, F.col("slices") - 1), lambda i: place(own_block, i, F.lit(1)))
    places = F.when(one, F.array(place(zero, zero, F.when(asks, F.lit(2)).otherwise(zero)))).when(asks, F.concat(answers, asking)).otherwise(answers)
    return rows.select("key", "doc", "comp", F.explode(places).alias("p")).select("key", "p.block", "p.slice", "p.role", "doc", "comp")


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = 80) -> DataFrame:
    """id, n_shingles, component_id of every row; linked if 100 * intersection >= percent * union."""
    ship(docs.sparkSession)
    own = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    everyone = cut(own.mapInArrow(_profiles(k), "id long, n long, d1 long, d2 long, keys array<long>"))
    rows = everyone.select("id", "n", "d1", "d2")
    # one class per set; the smallest identifier stands for it
    classes = everyone.where("n > 0 and id is not null").groupBy("d1", "d2", "n").agg(F.min("id").alias("doc"), F.first("keys").alias("keys"), F.count(F.lit(1)).alias("copies"))
    classes = cut(classes)
    banded = classes.select("n", "doc", F.explode("keys").alias("key"))
    buckets = cut(banded.groupBy("key").agg(F.min("doc").alias("center"), F.count(F.lit(1)).alias("members")).where("members > 1"))
    held = cut(attach(banded, buckets, ["key"], "members").select("key", "doc", "n", "center"))

    # the star of each bucket; sizes alone rule many links out
    similar = F.least("n", "m") * 100 >= F.greatest("n", "m") * percent
    centers = held.where("doc = center").groupBy("center").agg(F.min("n").alias("m"))
    stars = held.where("doc != center").select("doc", "n", "center").distinct().join(centers, "center").where(similar)
    links = _verified(cut(stars.select(F.col("center").alias("a"), F.col("doc").alias("b"))), own, k, percent)
    labels = connected_components(links)

    labelled = cut(held.join(labels, held["doc"] == labels["node"], "left").select("key", "doc", F.coalesce("component", "doc").alias("comp")))
    left = cut(_open_buckets(labelled))
    if not left.isEmpty():
        with settings(docs.sparkSession, spark__sql__execution__arrow__maxRecordsPerBatch="500"):
            sets = _sets(own, left.select(F.col("doc").alias("id")).distinct(), k)
            wide = left.join(sets, left["doc"] == sets["id"]).select("key", "block", "slice", "role", "doc", "comp", "set")
            wide = wide.repartition("key", "block", "slice").sortWithinPartitions("key", "block", "slice")
            more = cut(wide.mapInArrow(_blocks(percent), "a long, b long").distinct())
        if not more.isEmpty():
            labels = connected_components(links.unionByName(more))

    final = classes.select("d1", "d2", "n", "doc", "copies").join(labels, F.col("doc") == F.col("node"), "left")
    final = cut(final.select("d1", "d2", "n", "copies", F.coalesce("component", "doc").alias("comp")))
    out = attach(rows.where("n > 0 and id is not null"), final, ["d1", "d2", "n"], "copies").select("id", "n", "comp")
    alone = rows.where("n = 0 or id is null").select("id", "n", F.col("id").alias("comp"))
    return out.unionByName(alone).select("id", F.col("n").alias("n_shingles"), F.col("comp").alias("component_id"))


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs of which no nearly equal row has a smaller identifier, all columns as they were."""
    (name,) = free_names(docs, "gone")
    groups = near_groups(docs, id_col, text_col, k, percent)
    gone = groups.where("component_id != id").select(F.col("id").alias(name)).distinct()
    return docs.join(gone, docs[id_col] == F.col(name), "left_anti")
