"""Language-model scoring by cross-entropy difference.

Two bigram models, one of target texts and one of the whole corpus, share one vocabulary, order and
smoothing (a bigram is interpolated with the smoothed unigram). A text's score is its mean loss per
token under the target model less that under the background model: the lower, the more like the target.

Every word is in the vocabulary, unless LEAST_SHARE is set, which makes rarer words one unknown word.
Words and bigrams are keyed by 64-bit hashes, and nothing of their number goes to the driver or is
broadcast. Documents are dealt to chunks by identifier, and so are the target's identifiers; a chunk
sends each of its distinct words and bigrams once, with its counts, to the bucket of the key's range; the
bucket sums them over all chunks and sends the sums back to each chunk that has the key, and the chunk is
scored beside them. A frequent bigram thus costs one entry a chunk, however often it occurs.

Defined cases: a null or empty text has no tokens and score 0; rows repeated under one identifier get
one score each; a row without an identifier is scored like any other; an empty target gives score
differences from smoothing alone; very long texts are scored whole; an empty table gives an empty result;
equal texts get equal scores; other columns play no part, as all work is on own columns.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import NOT_ALNUM, U, mix, send, text_chunks, word_digests, words

#: Least share of the corpus of a word of the vocabulary; 0 keeps every word.
LEAST_SHARE = 0.0
#: Weight of the bigram against the unigram; added to every unigram count.
BIGRAM_WEIGHT, ADDED = 0.7, 1.0
#: Bytes of text of one chunk, on average; distinct keys a task holds before it passes them on.
CHUNK_BYTES, HELD = 8 << 20, 1 << 20
#: Keys of the unknown word and of the start of a text.
UNKNOWN, START = 0, 1

def _tally(key: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    keys, at = np.unique(key, return_inverse=True)
    return keys, np.bincount(at, weights=n, minlength=len(keys)).astype(np.int64)


def _counting(keys_of: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(key, n): occurrences in the texts, summed within a task up to HELD keys at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0

        def merged() -> tuple[np.ndarray, np.ndarray]:
            return _tally(*(np.concatenate([p[i] for p in parts]) for i in range(2)))

        def out(rows: tuple[np.ndarray, np.ndarray]) -> Iterator[pa.RecordBatch]:
            for i in range(0, len(rows[0]), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(x[i : i + 100_000], pa.int64()) for x in rows], ["key", "n"])

        for batch in batches:
            for _, data, off in text_chunks(batch.column(0)):
                parts.append(np.unique(keys_of(data, off), return_counts=True))
                size += len(parts[-1][0])
                if size > 2 * HELD:
                    parts = [merged()]
                    size = len(parts[0][0])
                    if size > HELD:
                        yield from out(parts[0])
                        parts, size = [], 0
        if parts:
            yield from out(merged())

    return run


def _words(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    (word,), first = word_digests(data, off, NOT_ALNUM, 1)
    return word.view(np.int64), np.repeat(np.arange(len(off) - 1), np.diff(first))


def _grams(data: np.ndarray, off: np.ndarray, vocabulary: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Keys of the word, of the one before it and of both together at each place, and its text."""
    word, of = _words(data, off)
    if vocabulary is not None:
        word = np.where(np.isin(word, vocabulary), word, UNKNOWN)
    left = np.empty_like(word)
    left[1:] = word[:-1]
    left[:1] = START
    left[1:][of[1:] != of[:-1]] = START
    return word, left, mix(mix(left.view(U) + U(0x9E3779B97F4A7C15)) + word.view(U)).view(np.int64), of


def _tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n = [np.diff(words(data, off, NOT_ALNUM)[2]) for _, data, off in text_chunks(batch.column(1))]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate([np.zeros(0, dtype=np.int64), *n]), pa.int64())], ["id", "n"])


def _packed(values: np.ndarray, ends: np.ndarray, rising: bool = False) -> pa.Array:
    """Runs of values as binary, the bytes of one weight side by side; ends: 0, then the end of each run.

    Rising ones (keys) as differences, whose high bytes are equal; others (counts) compressed."""
    out = []
    for a, b in zip(ends[:-1], ends[1:], strict=True):
        run = np.diff(values[a:b], prepend=0) if rising else values[a:b]
        planes = run.astype("<i8").view(np.uint8).reshape(-1, 8).T.tobytes()
        out.append(planes if rising else zlib.compress(planes, 1))
    return pa.array(out, pa.binary())


def _unpacked(blobs: list[bytes], rising: bool = False) -> list[np.ndarray]:
    out = []
    for x in blobs:
        planes = np.frombuffer(x if rising else zlib.decompress(x), dtype=np.uint8).reshape(8, -1)
        run = np.ascontiguousarray(planes.T).view("<i8").ravel()
        out.append(np.cumsum(run) if rising else run)
    return out


def _joined(runs: list[np.ndarray]) -> np.ndarray:
    return np.concatenate([np.zeros(0, dtype=np.int64), *runs])


def _sent(held, buckets: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """The keys of a chunk with their counts in it, of all texts and of target texts, a row for each bucket."""

    def run(rows: pa.Table, targets: pa.Table) -> pa.Table:
        target = np.unique(targets.column("id").to_numpy())
        parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = [(np.zeros(0, dtype=np.int64),) * 3]
        for batch in rows.to_batches():
            doc = batch.column("id")
            wanted = np.isin(doc.fill_null(-1).to_numpy(zero_copy_only=False), target) & ~np.asarray(doc.is_null())
            for row, data, off in text_chunks(batch.column("text")):
                word, left, pair, of = _grams(data, off, held.value)
                first = left == START
                key, at = np.unique(np.concatenate((word, pair, left[first])), return_inverse=True)
                of_target = wanted[row + np.concatenate((of, of, of[first]))]
                parts.append((key, np.bincount(at, minlength=len(key)), np.bincount(at[of_target], minlength=len(key))))
        key, n, t = (np.concatenate([p[i] for p in parts]) for i in range(3))
        (key, n), t = _tally(key, n), _tally(key, t)[1]
        bucket = ((key >> 34) + (1 << 29)) * buckets >> 30
        ends = np.concatenate((np.flatnonzero(np.diff(bucket, prepend=-1)), [len(key)]))
        chunk = rows.column("chunk")[0].as_py() if rows.num_rows else 0
        size = len(ends) - 1
        return pa.table({"bucket": pa.array(bucket[ends[:-1]], pa.int64()), "chunk": pa.array(np.full(size, chunk), pa.int64())} | {"k": _packed(key, ends, True), "n": _packed(n, ends), "t": _packed(t, ends)})

    return run


def _summed(rows: pa.Table) -> pa.Table:
    """The counts of a bucket's keys over all chunks, for each chunk in the order of its own keys."""
    runs = _unpacked(rows.column("k").to_pylist(), True)
    ends = np.concatenate(([0], np.cumsum([len(x) for x in runs]))).astype(np.int64)
    keys, at = np.unique(_joined(runs), return_inverse=True)
    n, t = (np.bincount(at, weights=_joined(_unpacked(rows.column(c).to_pylist())), minlength=len(keys)).astype(np.int64)[at] for c in "nt")
    return pa.table({"chunk": rows.column("chunk"), "bucket": rows.column("bucket"), "n": _packed(n, ends), "t": _packed(t, ends)})


def _scores(held, size: int, totals: tuple[int, int]) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """size: words of the vocabulary and the unknown one; totals: tokens of all texts and of target texts."""

    def run(rows: pa.Table, counts: pa.Table) -> pa.Table:
        pieces, base = [], 0
        for texts in rows.column("text").chunks:
            for row, data, off in text_chunks(texts):
                word, left, pair, of = _grams(data, off, held.value)
                pair, first, again = np.unique(pair, return_index=True, return_inverse=True)
                pieces.append((base + row, len(off) - 1, word[first], left[first], pair, again, of))
            base += len(texts)
        # the keys that this chunk sent; buckets are ranges of keys, so the answers in their order are in that of the keys
        key = np.unique(_joined([np.unique(np.concatenate(p[2:5])) for p in pieces]))
        order = np.argsort(counts.column("bucket").to_numpy())
        n, t = (_joined(_unpacked(counts.column(c).take(pa.array(order)).to_pylist())) for c in "nt")

        def difference(word: np.ndarray, left: np.ndarray, pair: np.ndarray) -> np.ndarray:
            """Loss under the target model less loss under the background model."""
            word, left, pair = (np.searchsorted(key, x) for x in (word, left, pair))
            loss = []
            for count, total in ((n, totals[0]), (t, totals[1])):
                single = (count[word] + ADDED) / (total + ADDED * size)
                before = count[left]
                both = np.where(before > 0, count[pair] / np.maximum(before, 1), single)
                loss.append(-np.log(BIGRAM_WEIGHT * both + (1 - BIGRAM_WEIGHT) * single))
            return loss[1] - loss[0]

        score, tokens = np.zeros(rows.num_rows), np.zeros(rows.num_rows, dtype=np.int64)
        for row, texts_in, word, left, pair, again, of in pieces:
            own = np.bincount(of, minlength=texts_in)
            total = np.bincount(of, weights=difference(word, left, pair)[again], minlength=texts_in)
            at = slice(row, row + texts_in)
            tokens[at], score[at] = own, total / np.maximum(own, 1)
        return pa.table({"id": rows.column("id"), "n_tokens": pa.array(tokens), "score": pa.array(score)})

    return run


def cross_entropy_difference(docs: DataFrame, targets: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_tokens, score of every row of docs; targets: identifiers of the rows the target model is of."""
    own = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    wanted = targets.select(F.col(id_col).cast("long").alias("id")).where("id is not null").distinct()
    send(docs, None)
    bytes_in = own.agg(F.sum(F.octet_length("text")).alias("b")).first()["b"] or 0
    of_target = own.mapInArrow(_tokens, "id long, n long").join(wanted, "id", "left_semi").agg(F.sum("n").alias("n")).first()["n"] or 0
    single = own.select("text").mapInArrow(_counting(lambda data, off: _words(data, off)[0]), "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))
    if LEAST_SHARE:
        single = single.persist()
    total = single.agg(F.count(F.lit(1)).alias("words"), F.sum("n").alias("n")).first()
    vocabulary, size = None, total["words"] + 1
    if LEAST_SHARE:
        vocabulary = single.where(F.col("n") >= (total["n"] or 0) * LEAST_SHARE).toPandas()["key"].to_numpy(dtype=np.int64)
        size = len(vocabulary) + 1
        single.unpersist()

    held = send(docs, vocabulary)
    chunks = max(1, -(-bytes_in // CHUNK_BYTES))
    chunk = lambda by: F.pmod(F.xxhash64(by), F.lit(chunks)).cast("long")
    dealt = own.withColumn("chunk", chunk(F.coalesce("id", F.xxhash64("text")))).groupBy("chunk")
    sent = dealt.cogroup(wanted.withColumn("chunk", chunk("id")).groupBy("chunk")).applyInArrow(_sent(held, chunks), "bucket long, chunk long, k binary, n binary, t binary")
    counts = sent.groupBy("bucket").applyInArrow(_summed, "chunk long, bucket long, n binary, t binary")
    return dealt.cogroup(counts.groupBy("chunk")).applyInArrow(_scores(held, size, (total["n"] or 0, of_target)), "id long, n_tokens long, score double")
