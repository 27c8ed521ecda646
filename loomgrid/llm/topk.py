"""Exact top-k inner-product search by columnar branch and bound.

Candidates lie in vertical layout: one row per dimension. For a query, partial products are summed
block by block of dimensions; after each block a candidate survives only if its partial sum plus the
largest product that the remaining mass allows (the norms of what is left of both vectors) can still
reach the query's k-th best score so far, and the survivors are compacted before the next block.

Queries are sent in blocks of bounded bytes; every block meets all candidates where they lie, so
candidates are never shuffled. A task returns k rows a query, and a ranked window merges them block by block.

Defined cases: vectors that are null, or hold null or non-finite components, and rows without an
identifier take no part; shorter vectors count as padded with zeros, so an empty one scores 0; of rows repeated under one
identifier the smallest vector is the query and all are candidates; ties go to the smaller identifier;
an empty table gives an empty result. Other columns play no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut, send

#: Bytes of queries sent to the executors at once, on average; dimensions of one block; candidates of one chunk.
QUERY_BYTES, DIMS, CHUNK = 16 << 20, 8, 8192
EXACT = float(1 << 53)


def quantised(vector: Column, scale: int = 256) -> Column:
    """floor(scale * x) of every component as bigint; null for a vector that takes no part."""
    fine = F.forall(vector, lambda x: F.coalesce(F.abs(x.cast("double")) < float("inf"), F.lit(False)))
    return F.when(F.coalesce(fine, F.lit(False)), F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("long")))


def _matrix(lists: pa.Array, dims: int) -> np.ndarray:
    """Vertical layout: dims rows, one column per vector; missing components are 0."""
    size = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    row = np.repeat(np.arange(len(size)), size)
    at = np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)
    out = np.zeros((dims, len(size)), dtype=np.int64)
    keep = at < dims
    out[at[keep], row[keep]] = flat[keep]
    return out


class Search:
    """A block of queries against chunks of candidates; keeps each query's best k."""

    def __init__(self, ids: np.ndarray, queries: np.ndarray, k: int) -> None:
        self.ids, self.raw, self.k = ids, queries, k
        weight = np.add.reduceat((queries.astype(np.float64) ** 2).sum(axis=0), np.arange(0, queries.shape[1], DIMS))
        self.blocks = [np.arange(b * DIMS, min((b + 1) * DIMS, queries.shape[1])) for b in np.argsort(-weight, kind="stable")]
        self.queries = queries.astype(np.float64)
        self.rest = self._mass(self.queries.T)
        self.scores = np.full((len(ids), k), -np.inf)
        self.found = np.full((len(ids), k), -1, dtype=np.int64)
        self.big: list[tuple[int, int, int]] = []

    def _mass(self, vertical: np.ndarray) -> list[np.ndarray]:
        """Norm of what is left of each column after each block, rounded up a little."""
        total, out = np.zeros(vertical.shape[1]), []
        for dims in reversed(self.blocks):
            out.append(np.sqrt(total) * (1 + 1e-9))
            total = total + (vertical[dims] ** 2).sum(axis=0)
        return out[::-1]

    def add(self, ids: np.ndarray, vertical: np.ndarray) -> None:
        if float(np.abs(self.raw).max(initial=0)) * float(np.abs(vertical).max(initial=0)) * len(vertical) >= EXACT:
            self._add_exactly(ids, vertical)
            return
        columns = vertical.astype(np.float64)
        blocks = [np.ascontiguousarray(columns[d]) for d in self.blocks]
        mass = self._mass(columns)
        for q, own in enumerate(self.ids):
            live = np.flatnonzero(ids != own)
            partial, least = np.zeros(len(live)), self.scores[q, -1]
            for b, dims in enumerate(self.blocks):
                full = len(live) == len(ids)
                partial = partial + self.queries[q, dims] @ (blocks[b] if full else blocks[b][:, live])
                reach = partial + self.rest[b][q] * (mass[b] if full else mass[b][live])
                keep = reach >= least - 1e-6 * abs(least) - 1e-6 if np.isfinite(least) else None
                if keep is not None and not keep.all():
                    live, partial = live[keep], partial[keep]
                if not len(live):
                    break
            if len(live):
                self._keep(q, ids[live], partial)

    def _keep(self, q: int, ids: np.ndarray, scores: np.ndarray) -> None:
        if len(ids) > self.k:
            # all ties of the k-th score stay for the tie rule
            edge = np.partition(scores, len(scores) - self.k)[len(scores) - self.k]
            ids, scores = ids[scores >= edge], scores[scores >= edge]
        ids, scores = np.concatenate((self.found[q], ids)), np.concatenate((self.scores[q], scores))
        order = np.lexsort((ids, -scores))[: self.k]
        self.found[q], self.scores[q] = ids[order], scores[order]

    def _add_exactly(self, ids: np.ndarray, vertical: np.ndarray) -> None:
        """Components so large that doubles could round: plain integers, scores held to the range of a long."""
        lo, hi = -(1 << 63), (1 << 63) - 1
        for q, own in enumerate(self.ids.tolist()):
            row = [int(x) for x in self.raw[q]]
            scored = [(-max(lo, min(hi, sum(a * int(b) for a, b in zip(row, vertical[:, i], strict=True)))), int(x)) for i, x in enumerate(ids) if x != own]
            self.big += [(q, -s, x) for s, x in sorted(scored)[: self.k]]

    def result(self) -> pa.RecordBatch:
        q, r = np.nonzero(np.isfinite(self.scores))
        rows = [self.ids[q].tolist(), self.found[q, r].tolist(), self.scores[q, r].astype(np.int64).tolist()]
        for q, score, x in self.big:
            for column, value in zip(rows, (int(self.ids[q]), x, score), strict=True):
                column.append(value)
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in rows], ["query_id", "id", "score"])


def exact_top_k(vectors: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """query_id, rank, id, score of the k best of vectors (id, vector) for each of queries (id, vector), itself excluded."""
    spark = vectors.sparkSession
    usable = "id is not null and vector is not null"
    vectors, queries = vectors.where(usable), queries.where(usable)
    queries = queries.groupBy("id").agg(F.min("vector").alias("vector"))
    queries = cut(queries)
    size = queries.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("vector")).alias("dims")).first()
    blocks = max(1, -(-size["n"] * max(1, size["dims"] or 0) * 8 // QUERY_BYTES))
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "id")
    parts = []
    for block in range(blocks if size["n"] else 0):
        part = queries.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == block).toArrow().sort_by("id")
        if not part.num_rows:
            continue
        lists = part.column("vector").combine_chunks()
        dims = max(1, int(lists.value_lengths().to_numpy(zero_copy_only=False).max()))
        ids, q = part.column("id").to_numpy(), np.ascontiguousarray(_matrix(lists, dims).T)
        held = send(vectors, (ids, q, k))

        def scan(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            ids, q, k = held.value
            search, waiting, rows = Search(ids, q, k), [], 0

            def run() -> None:
                table = pa.Table.from_batches(waiting).combine_chunks()
                search.add(table.column(0).to_numpy(), _matrix(table.column(1).combine_chunks(), q.shape[1]))

            for batch in batches:
                waiting.append(batch)
                rows += batch.num_rows
                if rows >= CHUNK:
                    run()
                    waiting, rows = [], 0
            if rows:
                run()
            yield search.result()

        found = vectors.select("id", "vector").mapInArrow(scan, "query_id long, id long, score long")
        best = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "id", "score")
        parts.append(cut(best) if blocks > 1 else best)
    if not parts:
        return spark.createDataFrame([], "query_id long, rank int, id long, score long")
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    return out
