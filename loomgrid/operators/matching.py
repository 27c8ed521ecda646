"""Nearest-template matching: scores, top-k candidates, pools, margins, evaluation."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..session import ship
from .common import BROADCAST_ROWS, bound, if_small

SQRT2 = 2.0**0.5


def squared_l2(a: Column, b: Column) -> Column:
    """Squared Euclidean distance of two numeric arrays, in doubles."""
    gap = F.zip_with(a, b, lambda x, y: x.cast("double") - y.cast("double"))
    return F.aggregate(gap, F.lit(0.0), lambda acc, d: acc + d * d)


def rounded(value: Column, digits: int) -> Column:
    """Doubles rounded half away from zero after scaling, as DuckDB's SQL does; Spark's round goes by their decimals."""
    scaled = F.abs(value) * 10.0**digits
    whole = F.floor(scaled)
    near = F.when(scaled < 2.0**52, whole + (scaled - whole >= 0.5).cast("int")).otherwise(scaled) / 10.0**digits
    return F.when(near == float("inf"), value).otherwise(F.signum(value) * near)


def templates_first(items: DataFrame, label: str, order: str) -> DataFrame:
    """The first item of each label: one combined aggregation, no sort."""
    return items.groupBy(label).agg(F.min_by(F.struct("*"), order).alias("t")).select("t.*")


def nearest(items: DataFrame, templates: DataFrame, distance: Column, k: int, key: str, tie: str, on: str | None = None) -> DataFrame:
    """The k templates of least distance per item, ranked from 1; ties to the smaller template.

    Templates are a dimension: broadcast if they are few, so every item meets them where it lies.
    With on, only templates of the same pool are met, by an equi-join."""
    pairs = items.join(if_small(templates), on) if on else items.crossJoin(if_small(templates))
    scored = pairs.withColumn("distance", distance)
    order = W.partitionBy(key).orderBy("distance", tie)
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


class Vectors:
    """The distinct vectors of some items: their components (0 where one is lacking), what is lacking, and squared norms.

    own: the number of each item's vector; odd: vectors that lack components or hold some too large for a bound."""

    def __init__(self, lists: pa.Array, dims: int) -> None:
        size = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        flat = lists.flatten().cast(pa.float64())
        row, at = np.repeat(np.arange(len(size)), size), np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)
        values, lacks = np.zeros((len(size), dims)), np.ones((len(size), dims), dtype=bool)
        lacks[row, at] = flat.is_null().to_numpy(zero_copy_only=False)
        values[row, at] = flat.fill_null(0).to_numpy(zero_copy_only=False) + 0.0
        whole = np.ascontiguousarray(np.concatenate((values, lacks), axis=1))
        _, first, self.own = np.unique(whole.view(f"V{whole.itemsize * (2 * dims)}").ravel(), return_index=True, return_inverse=True)
        self.values, self.lacks = values[first], lacks[first]
        self.odd = self.lacks.any(axis=1) | ~(np.abs(self.values) < 1e100).all(axis=1)
        self.safe = np.where(self.odd[:, None], 0.0, self.values)
        self.norms = (self.safe**2).sum(axis=1)


def exact_distances(a: Vectors, i: np.ndarray, b: Vectors, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Squared distances of vectors i of a and j of b over the components that both have, summed in their order and
    rounded to nine digits as SQL does; and whether none is shared."""
    out, none = np.zeros(len(i)), np.zeros(len(i), dtype=bool)
    step = max(1, (1 << 21) // max(1, a.values.shape[1]))
    for n in range(0, len(i), step):
        p, q = i[n : n + step], j[n : n + step]
        lacks = (a.lacks[p] | b.lacks[q]).T if a.odd[p].any() or b.odd[q].any() else None
        with np.errstate(invalid="ignore", over="ignore"):
            gap = (a.values[p] - b.values[q]).T
            if lacks is not None:
                gap[lacks] = 0
                none[n : n + step] = lacks.all(axis=0)
            total = np.zeros(len(p))
            for part in gap:
                total += part * part
            whole = np.floor(total * 1e9)
            near = (whole + (total * 1e9 - whole >= 0.5)) / 1e9
        out[n : n + step] = np.where(np.isfinite(near), near, total)
    return out, none


def nearest_of_block(ids: np.ndarray, lists: pa.Array, ref_ids: np.ndarray, ref_lists: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For items and references of one pool: item, reference id, distance, and whether that is null, of each item's k nearest.

    Distances by a matrix product, less what its rounding can be, leave out the references that are too far;
    all others are measured exactly. Of references alike only as many as can be among the k are looked at."""
    dims = max(1, *(pc.max(pc.list_value_length(x)).as_py() or 0 for x in (lists, ref_lists)))
    items, refs = Vectors(lists, dims), Vectors(ref_lists, dims)
    # of each vector's references the later ids come first; k + 1 ids are enough, as one may be the item's own
    order = np.lexsort((~ref_ids, refs.own))
    own, named = refs.own[order], ref_ids[order]
    fresh = np.ones(len(own), dtype=bool)
    fresh[1:] = (own[1:] != own[:-1]) | (named[1:] != named[:-1])
    start = np.searchsorted(own, own)
    id_number = np.cumsum(fresh)
    copy = np.arange(len(own)) - np.maximum.accumulate(np.where(fresh, np.arange(len(own)), 0))
    keep = (id_number - id_number[start] <= k) & (copy < k)
    own, named = own[keep], named[keep]
    first = np.searchsorted(own, np.arange(len(refs.values) + 1))
    # the id of vectors that stand under one id only
    alone = named[first[:-1]] == named[first[1:] - 1]
    single = named[first[:-1]]
    unit = np.finfo(float).eps * 8 * (dims + 8)
    found, step = [], max(1, (1 << 19) // len(refs.values))
    for n in range(0, len(ids), step):
        me, mine = ids[n : n + step], items.own[n : n + step]
        about = items.norms[mine][:, None] + refs.norms - 2 * (items.safe[mine] @ refs.safe.T)
        about[:, refs.odd] = np.inf
        met = np.flatnonzero(np.isin(me, single))
        row, vector = np.nonzero((me[met, None] == single) & alone)
        about[met[row], vector] = np.inf
        edge = np.partition(about, k - 1, axis=1)[:, k - 1] if about.shape[1] >= k else np.full(len(me), np.inf)
        edge = edge + 1.001e-9 + unit * (items.norms[mine] + refs.norms.max())
        edge[items.odd[mine]] = np.inf
        q, c = np.nonzero((about <= edge[:, None]) | refs.odd)
        far, none = exact_distances(items, mine[q], refs, c)
        many = (first[1:] - first[:-1])[c]
        pair = np.repeat(np.arange(len(q)), many)
        ref = named[np.arange(len(pair)) - np.repeat(np.cumsum(many) - many, many) + first[c][pair]]
        other = ref != me[q[pair]]
        pair, ref = pair[other], ref[other]
        by = np.lexsort((~ref, far[pair], none[pair], q[pair]))
        pair, ref = pair[by], ref[by]
        item = q[pair]
        best = np.arange(len(item)) - np.searchsorted(item, item) < k
        found.append((item[best] + n, ref[best], far[pair[best]], none[pair[best]]))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def nearest_in_pool(items: DataFrame, key: str, pool: str, vector: str, k: int, block: int = 4096) -> DataFrame:
    """key, pool, ref_id, distance, rank of the k nearest other items of the same pool, of the whole pool, ranked from 1;
    ties, at nine digits, to the later item. Keys are whole numbers.

    A pool is cut into blocks of about so many items, and every block meets every block of its pool in a matrix product,
    so no task holds a pool; each pair of blocks leaves k rows an item. Components that either vector lacks are left out;
    the distance is null, and last, if none is shared. Items without key or pool take no part."""
    items = items.select(F.col(key).cast("long").alias(key), pool, F.col(vector).alias("v")).where(F.col(key).isNotNull() & F.col(pool).isNotNull())
    sizes = items.groupBy(pool).agg(F.greatest(F.lit(1), F.ceil(F.count(F.lit(1)) / block)).alias("blocks"))
    dealt = items.join(if_small(sizes), pool).withColumn("own", F.pmod(F.xxhash64(key), F.col("blocks")))
    each = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))
    left = dealt.withColumn("other", each).select(pool, "own", "other", key, "v")
    # under new names, as both sides are of one table
    right = dealt.withColumnRenamed("own", "other").withColumn("own", each).select(*[F.col(c).alias(c) for c in left.columns])

    def run(ours: pa.Table, theirs: pa.Table) -> pa.Table:
        if not ours.num_rows or not theirs.num_rows:
            return schema.empty_table()
        ours, theirs = ours.combine_chunks(), theirs.combine_chunks()
        ids, refs = (t.column(3).to_numpy() for t in (ours, theirs))
        lists = [t.column(4).combine_chunks() for t in (ours, theirs)]
        item, ref, far, none = nearest_of_block(ids, lists[0], refs, lists[1], k)
        columns = [pa.array(ids[item], pa.int64()), ours.column(0).take(pa.array(item)), pa.array(ref, pa.int64()), pa.array(far, pa.float64(), mask=none)]
        return pa.Table.from_arrays(columns, schema=schema)

    kind = items.schema[pool].dataType
    schema = pa.schema([(key, pa.int64()), (pool, to_arrow_type(kind)), ("ref_id", pa.int64()), ("distance", pa.float64())])
    ship(items.sparkSession)
    cut = ("own", "other")
    near = left.groupBy(pool, *cut).cogroup(right.groupBy(pool, *cut)).applyInArrow(run, f"`{key}` long, `{pool}` {kind.simpleString()}, ref_id long, distance double")
    # of equal distances the later reference comes first
    order = W.partitionBy(key).orderBy(F.asc_nulls_last("distance"), F.desc("ref_id"))
    return near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def accuracy_at(ranked: DataFrame, key: str, truth: Column, predicted: Column, ks: tuple[int, ...]) -> DataFrame:
    """n and, for each k, the number of keys whose truth is among the first k candidates."""
    hit = ranked.groupBy(key).agg(F.min(F.when(truth == predicted, F.col("rank"))).alias("at"))
    return hit.agg(F.count(F.lit(1)).alias("n"), *[F.count(F.when(F.col("at") <= k, 1)).alias(f"top{k}") for k in ks])


def ink_mask(vector: Column) -> Column:
    """1 for positive components, else 0."""
    return F.transform(vector, lambda v: (v > 0).cast("int"))


def octile(dx: Column, dy: Column) -> Column:
    """Length of the shortest 8-connected path: diagonal steps cost the square root of 2."""
    a, b = F.abs(dx), F.abs(dy)
    return F.greatest(a, b) - F.least(a, b) + SQRT2 * F.least(a, b)


def distance_field(mask: Column, width: int) -> Column:
    """For every cell of a row-major mask, the octile distance to the nearest ink; null without ink."""
    cells = F.sequence(F.lit(0), F.size(mask) - 1)
    x, y = lambda i: i % width, lambda i: F.floor(i / width)
    far = lambda ink, i: F.array_min(F.transform(ink, lambda j: octile(x(i) - x(j), y(i) - y(j))))
    ink = bound(mask, lambda own: F.filter(cells, lambda i: F.element_at(own, i + 1) == 1))
    return bound(ink, lambda own: F.transform(cells, lambda i: far(own, i)))


def mean_where(field: Column, mask: Column) -> Column:
    """Mean of field over the ink of mask; null without ink or field."""
    on = F.zip_with(field, mask, lambda d, m: F.when(m == 1, d))
    total = F.aggregate(on, F.lit(0.0), lambda a, d: a + F.coalesce(d, F.lit(0.0)))
    return F.try_divide(total, F.aggregate(mask, F.lit(0), lambda a, m: a + m).cast("double"))


def chamfer_similarity(field_a: Column, mask_a: Column, field_b: Column, mask_b: Column) -> Column:
    """1 / (1 + half the sum of the two mean nearest distances); 0 if either mask is empty."""
    both = (mean_where(field_b, mask_a) + mean_where(field_a, mask_b)) / 2
    return F.coalesce(1 / (1 + both), F.lit(0.0))


def octile_table(width: int, cells: int) -> np.ndarray:
    """Octile distance between every two cells of a row-major bitmap."""
    y, x = np.divmod(np.arange(cells), width)
    a, b = np.abs(x[:, None] - x), np.abs(y[:, None] - y)
    return np.maximum(a, b) - np.minimum(a, b) + SQRT2 * np.minimum(a, b)


def distance_fields(masks: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Distance of every cell to the nearest ink of its own mask, one row a mask; infinite without ink."""
    out, step = np.empty(masks.shape), max(1, (1 << 22) // table.size)
    for i in range(0, len(masks), step):
        out[i : i + step] = np.where(masks[i : i + step, None, :], table, np.inf).min(axis=2)
    return out


def chamfer_scores(masks: np.ndarray, templates: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Similarity of every mask (row) with every template (column): two matrix products; 0 if either is empty."""
    far, template_far = distance_fields(masks, table), distance_fields(templates, table)
    ink, template_ink = masks.sum(axis=1)[:, None], templates.sum(axis=1)
    there = (ink > 0) & (template_ink > 0)
    finite = lambda f: np.where(np.isfinite(f), f, 0.0)
    both = masks @ finite(template_far).T / np.maximum(ink, 1) + finite(far) @ templates.T / np.maximum(template_ink, 1)
    return np.where(there, 1 / (1 + both / 2), 0.0)


def chamfer_nearest(items: DataFrame, templates: DataFrame, key: str, width: int) -> DataFrame:
    """key, t_id, t_label, score of the best template of each item; ties, at nine digits, to the smaller t_id.

    items: key, mask; templates: t_id, t_label, mask, at most BROADCAST_ROWS, which are sent to every task once,
    with nothing shuffled. Masks are compared a batch at a time."""
    rows = templates.select("t_id", "t_label", "mask").limit(BROADCAST_ROWS + 1).toArrow().sort_by("t_id")
    if rows.num_rows > BROADCAST_ROWS:
        raise ValueError(f"more than {BROADCAST_ROWS} templates")
    ids, labels = rows.column("t_id").to_numpy(), rows.column("t_label").to_numpy()
    book = np.array(rows.column("mask").to_pylist(), dtype=bool)
    schema = f"{key} long, t_id long, t_label int, score double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows or not len(book):
                continue
            masks = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1).astype(bool)
            score = chamfer_scores(masks, book, octile_table(width, masks.shape[1]))
            best = np.round(score, 9).argmax(axis=1)
            columns = [batch.column(0).cast(pa.int64()), pa.array(ids[best], pa.int64()), pa.array(labels[best], pa.int32()), pa.array(score[np.arange(len(best)), best])]
            yield pa.RecordBatch.from_arrays(columns, [key, "t_id", "t_label", "score"])

    ship(items.sparkSession)
    return items.select(key, "mask").where("mask is not null").mapInArrow(run, schema)
