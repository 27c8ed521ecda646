"""Byte-level BPE encoding and decoding with a segment tree over byte positions.

Leaf i of a piece's tree holds rank * width + i of the pair that starts at position i, so the root is
the leftmost pair of minimum rank. A merge rewrites three leaves (its own, its right neighbour's and
its left neighbour's) and their ancestors. Short pieces are merged many at a time, one tree per row
of a matrix; long ones one by one. Encoded pieces are remembered in a bounded table.

Defined cases: a null or empty text has no ids and decodes to nothing; texts of any length are read
whole, in pieces; rows repeated get the same ids; of equal ranks the leftmost pair merges first; an empty
table gives an empty result; results are columns of expressions, so other columns cannot clash with them.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import send, text_chunks, tidy

NONE = np.iinfo(np.int64).max
#: Encoded pieces remembered by one Python worker; the table starts anew when full.
REMEMBERED = 200_000
#: Longest piece that is merged together with others; longer ones have a tree of their own.
WIDE = 256
#: Largest vocabulary file, as it is broadcast.
MAX_FILE = 64 << 20


class Decoder:
    """The bytes of each id of one vocabulary: lines of base64 token and rank."""

    def __init__(self, ranks_file: bytes, pattern: str) -> None:
        self.load({base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks_file.splitlines())})

    def load(self, ranks: dict[bytes, int]) -> None:
        tokens = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            tokens[rank] = token
        self.lengths = np.array([len(t) for t in tokens], dtype=np.int64)
        self.starts = np.concatenate(([0], np.cumsum(self.lengths)[:-1]))
        self.bytes = np.frombuffer(b"".join(tokens), dtype=np.uint8)

    def decode(self, ids: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of all rows of ids, and the number of bytes before each row."""
        size = self.lengths[ids]
        ends = np.concatenate(([0], np.cumsum(size)))
        at = np.arange(ends[-1]) + np.repeat(self.starts[ids] - ends[:-1], size)
        return self.bytes[at], ends[before]


class Encoder(Decoder):
    """Encodes as well: ranks of tokens and of joined pairs of ids."""

    def __init__(self, ranks_file: bytes, pattern: str) -> None:
        super().__init__(ranks_file, pattern)
        self.split = regex.compile(pattern).findall

    def load(self, ranks: dict[bytes, int]) -> None:
        super().load(ranks)
        self.ranks = ranks
        self.kind = np.uint16 if len(self.lengths) <= 1 << 16 else np.uint32
        self.byte_ids = np.array([ranks[bytes([b])] for b in range(256)], dtype=np.int64)
        pairs = {}
        for token, rank in self.ranks.items():
            for cut in range(1, len(token)):
                a, b = self.ranks.get(token[:cut]), self.ranks.get(token[cut:])
                if a is not None and b is not None:
                    pairs[a << 32 | b] = rank
        self.pair_keys = np.array(sorted(pairs), dtype=np.int64)
        self.pair_ranks = np.array([pairs[k] for k in self.pair_keys.tolist()], dtype=np.int64)
        self.known: dict[str, bytes] = {}

    def rank_of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of each joined pair of ids, NONE where the vocabulary lacks it."""
        key = (a << 32) | b
        at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == key, self.pair_ranks[at], NONE)

    def merge_many(self, pieces: list[bytes], width: int) -> list[np.ndarray]:
        """Ids of pieces of at most width bytes (a power of two), one segment tree per row."""
        rows, size = len(pieces), np.array([len(p) for p in pieces], dtype=np.int64)
        inside = np.arange(width) < size[:, None]
        ids = np.full((rows, width + 1), 0, dtype=np.int64)
        ids[:, :width][inside] = self.byte_ids[np.frombuffer(b"".join(pieces), dtype=np.uint8)]
        after = np.broadcast_to(np.arange(1, width + 2), (rows, width + 1)).copy()
        before = after - 2
        alive = inside.copy()
        pos = np.arange(width)
        tree = np.full((rows, 2 * width), NONE, dtype=np.int64)
        r, c = np.nonzero(inside & (pos + 1 < size[:, None]))
        rank = self.rank_of(ids[r, c], ids[r, c + 1])
        tree[r, width + c] = np.where(rank == NONE, NONE, rank * width + c)
        level = width
        while level > 1:
            half = level // 2
            tree[:, half:level] = np.minimum(tree[:, level : 2 * level : 2], tree[:, level + 1 : 2 * level : 2])
            level = half
        row = np.flatnonzero(tree[:, 1] != NONE)
        while len(row):
            best = tree[row, 1]
            at = best % width
            ids[row, at] = best // width
            gone = after[row, at]
            nxt = after[row, gone]
            after[row, at] = nxt
            before[row, np.minimum(nxt, width)] = at
            alive[row, gone] = False
            prev = before[row, at]
            right = np.where(nxt < size[row], self.rank_of(ids[row, at], ids[row, np.minimum(nxt, width)]), NONE)
            left = np.where(prev >= 0, self.rank_of(ids[row, prev], ids[row, at]), NONE)
            tree[row, width + gone] = NONE
            tree[row, width + at] = np.where(right == NONE, NONE, right * width + at)
            has = prev >= 0
            tree[row[has], width + prev[has]] = np.where(left == NONE, NONE, left * width + prev)[has]
            up = np.stack([gone, at, np.where(has, prev, at)]) + width
            while up[0, 0] > 1:
                up >>= 1
                tree[row, up] = np.minimum(tree[row, 2 * up], tree[row, 2 * up + 1])
            row = row[tree[row, 1] != NONE]
        flat, ends = ids[:, :width][alive], np.cumsum(alive.sum(1))
        return np.split(flat, ends[:-1])

    def merge_one(self, piece: bytes) -> list[int]:
        """Ids of one long piece, on a tree of plain integers."""
        n, ranks = len(piece), self.ranks
        width = 1 << max(1, (n - 1).bit_length())
        ids = self.byte_ids[np.frombuffer(piece, dtype=np.uint8)].tolist()
        none = 1 << 62
        tree = [none] * (2 * width)
        for i in range(n - 1):
            rank = ranks.get(piece[i : i + 2])
            if rank is not None:
                tree[width + i] = rank * width + i
        for i in range(width - 1, 0, -1):
            tree[i] = min(tree[2 * i], tree[2 * i + 1])
        after, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n

        def put(i: int, value: int) -> None:
            i += width
            tree[i] = value
            i >>= 1
            while i:
                a, b = tree[2 * i], tree[2 * i + 1]
                a = a if a < b else b
                if tree[i] == a:
                    break
                tree[i] = a
                i >>= 1

        while tree[1] < none:
            rank, at = divmod(tree[1], width)
            gone = after[at]
            nxt = after[gone]
            ids[at], after[at], alive[gone] = rank, nxt, False
            if nxt < n:
                before[nxt] = at
            put(gone, none)
            rank = ranks.get(piece[at : after[nxt]]) if nxt < n else None
            put(at, none if rank is None else rank * width + at)
            prev = before[at]
            if prev >= 0:
                rank = ranks.get(piece[prev:nxt])
                put(prev, none if rank is None else rank * width + prev)
        return [x for x, ok in zip(ids, alive, strict=True) if ok]

    def learn(self, pieces: set[str]) -> None:
        """Encode pieces not seen before."""
        if len(self.known) + len(pieces) > REMEMBERED:
            self.known.clear()
        by_width: dict[int, list[tuple[str, bytes]]] = {}
        for piece in pieces:
            raw = piece.encode()
            rank = self.ranks.get(raw)
            if rank is not None:
                self.known[piece] = np.array([rank], dtype=self.kind).tobytes()
            elif len(raw) > WIDE:
                self.known[piece] = np.array(self.merge_one(raw), dtype=self.kind).tobytes()
            else:
                by_width.setdefault(1 << max(1, (len(raw) - 1).bit_length()), []).append((piece, raw))
        for width, group in by_width.items():
            step = max(1, (1 << 18) // width)
            for i in range(0, len(group), step):
                part = group[i : i + step]
                for (piece, _), ids in zip(part, self.merge_many([raw for _, raw in part], width), strict=True):
                    self.known[piece] = ids.astype(self.kind).tobytes()

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and the number of ids before each text."""
        pieces = [self.split(t) if t else [] for t in texts]
        new = set().union(*pieces).difference(self.known)
        if new:
            if len(self.known) + len(new) > REMEMBERED:
                self.known.clear()
                new = set().union(*pieces)
            self.learn(new)
        known = self.known.__getitem__
        coded = [b"".join(map(known, p)) for p in pieces]
        ids = np.frombuffer(b"".join(coded), dtype=self.kind)
        counts = np.array([len(x) for x in coded], dtype=np.int64) // np.dtype(self.kind).itemsize
        return ids, np.concatenate(([0], np.cumsum(counts)))


_CODERS: dict[tuple[type, str], Decoder] = {}


def coder(kind: type[Decoder], ranks_file: bytes, pattern: str) -> Decoder:
    """The coder of a vocabulary, built once per Python process."""
    key = (kind, hashlib.sha256(ranks_file + pattern.encode()).hexdigest())
    if key not in _CODERS:
        _CODERS[key] = kind(ranks_file, pattern)
    return _CODERS[key]


def _vocabulary(path: str) -> bytes:
    with open(path, "rb") as f:
        blob = f.read(MAX_FILE + 1)
    if len(blob) > MAX_FILE:
        raise ValueError(f"{path} has more than {MAX_FILE} bytes")
    return blob


def _encoded(enc: Encoder, batch: pa.Array) -> pa.Array:
    ids, counts = [np.zeros(0, dtype=np.int32)], [np.zeros(1, dtype=np.int64)]
    for row, _, off in text_chunks(batch):
        own, before = enc.encode(batch.slice(row, len(off) - 1).to_pylist())
        ids.append(own.astype(np.int32))
        counts.append(np.diff(before))
    return pa.ListArray.from_arrays(pa.array(np.cumsum(np.concatenate(counts)), pa.int32()), pa.array(np.concatenate(ids)))


def _decoded(dec: Decoder, batch: pa.Array) -> pa.Array:
    size = batch.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = batch.flatten().to_numpy(zero_copy_only=False)
    out, off = dec.decode(flat, np.concatenate(([0], np.cumsum(size))))
    return pa.Array.from_buffers(pa.binary(), len(batch), [None, pa.py_buffer(off.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(out))])


def bpe_encode(text: str, df: DataFrame, path: str, pattern: str) -> Column:
    """A column of arrays of ids for one text column of df; the file is read on the driver and sent once."""
    held = send(df, (_vocabulary(path), pattern))

    @F.arrow_udf("array<int>")
    def encode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        enc = coder(Encoder, *held.value)
        for batch in batches:
            yield _encoded(enc, batch)
        tidy()

    return encode(F.col(text))


def bpe_decode(ids: str, df: DataFrame, path: str, pattern: str) -> Column:
    """A binary column: the bytes that a column of arrays of ids stands for; null reads as empty."""
    held = send(df, (_vocabulary(path), pattern))

    @F.arrow_udf("binary")
    def decode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        dec = coder(Decoder, *held.value)
        for batch in batches:
            yield _decoded(dec, batch)
        tidy()

    return decode(F.col(ids))


def bpe_both(text: str, df: DataFrame, path: str, pattern: str) -> Column:
    """A column struct<ids, decoded> of one text column: encoded, and decoded from the ids, in one Python worker."""
    held = send(df, (_vocabulary(path), pattern))

    @F.arrow_udf("ids array<int>, decoded binary")
    def both(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        enc = coder(Encoder, *held.value)
        for batch in batches:
            ids = _encoded(enc, batch)
            yield pa.StructArray.from_arrays([ids, _decoded(enc, ids)], ["ids", "decoded"])
        tidy()

    return both(F.col(text))
