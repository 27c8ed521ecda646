"""Photographed sheets: corners, straightening, the sheet's number, and the ink of its cells.

Every image is read by itself, a batch at a time in numpy; only manifests are joined, by the number of the sheet."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import from_bits
from ..session import ship
from .common import if_small, image_batches, slices
from .raster import component_labels

#: Fixed values of corner marks: least share of the image, least fill, bounds of width by height and of the size by
#: the largest one's.
LEAST_AREA, LEAST_FILL, ASPECT, LIKE = 0.0004, 0.55, (0.6, 1.7), (0.6, 1.6)
#: Fixed values of the number's bits: the margin left out on each side, and the share of white below which a bit is set.
INSET, DARK = 0.25, 0.6

Box = tuple[int, int, int, int]


@dataclass(frozen=True)
class Layout:
    """A straightened sheet: its size, the centres of its marks (upper left, upper right, lower right, lower left), and
    the boxes (x, y, width, height) of white paper and of the number's bits, the most significant first."""

    width: int
    height: int
    marks: tuple[tuple[float, float], ...]
    paper: Box
    bits: tuple[Box, ...]


def homographies(to: np.ndarray, corners: np.ndarray) -> np.ndarray:
    """The 3 x 3 projective maps that take four corners to four points each, from an 8 x 8 system a row."""
    a = np.zeros((len(to), 8, 8))
    for i, (x, y) in enumerate(corners):
        u, v = to[:, i, 0], to[:, i, 1]
        a[:, 2 * i, :3], a[:, 2 * i + 1, 3:6] = (x, y, 1), (x, y, 1)
        a[:, 2 * i, 6], a[:, 2 * i, 7] = -x * u, -y * u
        a[:, 2 * i + 1, 6], a[:, 2 * i + 1, 7] = -x * v, -y * v
    h = np.linalg.solve(a, to.reshape(-1, 8, 1))[:, :, 0]
    return np.concatenate((h, np.ones((len(h), 1))), axis=1).reshape(-1, 3, 3)


def warped(images: np.ndarray, maps: np.ndarray, white: float = 255.0, size: tuple[int, int] | None = None) -> np.ndarray:
    """Images (n, height, width) read at the places that each map gives to the cells, bilinearly; white outside.

    size: height and width of the results, if other than the images'."""
    n, height, width = images.shape
    rows, columns = size or (height, width)
    y, x = np.divmod(np.arange(rows * columns), columns)
    at = maps @ np.stack((x, y, np.ones(rows * columns)))
    px, py = at[:, 0] / at[:, 2], at[:, 1] / at[:, 2]
    left, upper = np.floor(px).astype(int), np.floor(py).astype(int)
    out = np.zeros((n, rows * columns))
    for dx, dy in ((0, 0), (1, 0), (0, 1), (1, 1)):
        sx, sy = left + dx, upper + dy
        inside = (sx >= 0) & (sx < width) & (sy >= 0) & (sy < height)
        value = np.where(inside, images[np.arange(n)[:, None], np.clip(sy, 0, height - 1), np.clip(sx, 0, width - 1)], white)
        out += value * np.where(dx, px - left, 1 - px + left) * np.where(dy, py - upper, 1 - py + upper)
    return out.reshape(n, rows, columns)


def otsu_cut(grey: np.ndarray) -> int:
    """The smallest threshold of greatest between-class variance over the whole values; -1 if all are equal."""
    counts = np.bincount(np.floor(grey).astype(int).ravel().clip(0, 255), minlength=256).astype(float)
    w0, s0 = np.cumsum(counts), np.cumsum(counts * np.arange(256))
    w1 = w0[-1] - w0
    with np.errstate(divide="ignore", invalid="ignore"):
        between = np.nan_to_num(w0 * w1 * (s0 / w0 - (s0[-1] - s0) / w1) ** 2, posinf=0.0)
    return int(between.argmax()) if between.max() > 0 else -1


def corner_marks(grey: np.ndarray) -> np.ndarray:
    """Centres of the four corner marks in the order of Layout.marks; ValueError where there are none.

    The marks are the four largest solid, squarish parts alike in size; the ring among them, bright in its middle or
    else the least filled, is the lower right one, the one farthest from it the upper left."""
    cut = otsu_cut(grey)
    ink = np.floor(grey) <= cut
    y, x = np.nonzero(ink)
    _, part, area = np.unique(component_labels(ink[None])[0][ink], return_inverse=True, return_counts=True)
    low, high = np.full((len(area), 2), max(grey.shape)), np.full((len(area), 2), -1)
    for d, place in enumerate((x, y)):
        np.minimum.at(low[:, d], part, place)
        np.maximum.at(high[:, d], part, place)
    box, middle = high - low + 1, (high + low) / 2
    fill, aspect, side = area / box.prod(axis=1), box[:, 0] / box[:, 1], box.mean(axis=1)
    solid = np.flatnonzero((area >= round(grey.size * LEAST_AREA)) & (fill > LEAST_FILL) & (aspect > ASPECT[0]) & (aspect < ASPECT[1]))
    solid = solid[np.argsort(-area[solid], kind="stable")]
    alike = [k for k in solid if LIKE[0] < side[k] / side[solid[0]] < LIKE[1]][:4]
    if len(alike) < 4:
        raise ValueError(f"{len(alike)} of 4 corner marks")
    centre = np.floor(middle + 0.5).astype(int)
    ring = min(alike, key=lambda k: (grey[centre[k, 1], centre[k, 0]] <= cut, fill[k]))
    from_ring = middle - middle[ring]
    first = max((k for k in alike if k != ring), key=lambda k: (from_ring[k] ** 2).sum())
    rest = [k for k in alike if k not in (ring, first)]
    rest.sort(key=lambda k: -(from_ring[first, 0] * from_ring[k, 1] - from_ring[first, 1] * from_ring[k, 0]))
    return middle[[first, rest[0], ring, rest[1]]]


def straightened(captures: DataFrame, layout: Layout) -> DataFrame:
    """id, grey (the straightened sheet, row by row; null without corners) and reason of captures (id, width, grey).

    Null, empty or ragged images stay as rows with a reason."""

    def image(grey: np.ndarray | None, width: float) -> np.ndarray:
        if grey is None or not width > 0 or not len(grey) or len(grey) % int(width):
            raise ValueError("no image")
        seen = np.asarray(grey, dtype=float).reshape(-1, int(width))
        if not np.isfinite(seen).all():
            raise ValueError("no image")
        try:
            to_image = homographies(corner_marks(seen)[None], np.array(layout.marks))
        except np.linalg.LinAlgError:
            raise ValueError("corner marks in one line") from None
        return warped(seen[None], to_image, size=(layout.height, layout.width)).ravel()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # a batch of a thousand images would be held several times over
        for batch in slices(batches, 8 * layout.width * layout.height):
            rows = []
            for r in batch.itertuples(index=False):
                try:
                    rows.append((r.id, image(r.grey, r.width), None))
                except ValueError as problem:
                    rows.append((r.id, None, str(problem)))
            yield pd.DataFrame(rows, columns=["id", "grey", "reason"])

    image_batches(ship(captures.sparkSession))
    return captures.select("id", "width", "grey").mapInPandas(run, "id long, grey array<double>, reason string")


def _box_mean(grey: Column, width: int, box: Box, inset: float = 0.0) -> Column:
    x, y, w, h = box
    half_up = lambda v: int(v + 0.5)
    across, down = (range(half_up(a + n * inset), half_up(a + n * (1 - inset))) for a, n in ((x, w), (y, h)))
    cells = [F.get(grey, F.lit(b * width + a)) for b in down for a in across]
    return F.aggregate(F.array(*cells), F.lit(0.0), lambda s, v: s + v) / len(cells)


def sheet_number(grey: Column, layout: Layout) -> Column:
    """The number in a straightened sheet's strip, its bits told by the white beside them; null if no bit is set."""
    white = _box_mean(grey, layout.width, layout.paper)
    return from_bits(F.array(*[(_box_mean(grey, layout.width, b, INSET) < DARK * white).cast("int") for b in layout.bits]))


def with_cells(sheets: DataFrame, manifests: DataFrame) -> DataFrame:
    """sheets (id, grey, sheet) with the cells of their manifest (sheet, cells); null without one.

    At most one manifest has no sheet number: it is that of all sheets which no other manifest fits."""
    known = manifests.where("sheet IS NOT NULL")
    # the aggregate is one row, whatever the manifests
    other = manifests.where("sheet IS NULL").agg(F.first("cells").alias("other"))
    rows = sheets.join(if_small(known), "sheet", "left").crossJoin(F.broadcast(other))
    return rows.withColumn("cells", F.coalesce("cells", "other")).drop("other")


def levelled_ink(grey: np.ndarray, radius: int) -> np.ndarray:
    """Ink of an image after each value is taken against the mean of its clipped window, and the best cut of all."""
    height, width = grey.shape
    sums = np.pad(grey.cumsum(axis=0).cumsum(axis=1), ((1, 0), (1, 0)))
    y, x = np.arange(height)[:, None], np.arange(width)[None]
    top, bottom, left, right = np.maximum(y - radius, 0), np.minimum(y + radius + 1, height), np.maximum(x - radius, 0), np.minimum(x + radius + 1, width)
    mean = (sums[bottom, right] - sums[top, right] - sums[bottom, left] + sums[top, left]) / ((bottom - top) * (right - left))
    level = np.floor(np.clip(grey - mean + 255, 0, 255))
    return level <= otsu_cut(level)


def squared(ink: np.ndarray, size: int) -> np.ndarray:
    """The ink's box, centred in a square, sampled to size x size at the middles of its cells; all False without ink."""
    out = np.zeros((size, size), dtype=bool)
    y, x = np.nonzero(ink)
    if not len(y):
        return out
    box = ink[y.min() : y.max() + 1, x.min() : x.max() + 1]
    side = max(box.shape)
    off_y, off_x = ((side - n) // 2 for n in box.shape)
    at = np.floor((np.arange(size) + 0.5) * side / size).astype(int)
    sy, sx = at - off_y, at - off_x
    in_y, in_x = (sy >= 0) & (sy < box.shape[0]), (sx >= 0) & (sx < box.shape[1])
    out[np.ix_(in_y, in_x)] = box[np.ix_(sy[in_y], sx[in_x])]
    return out


def packed(square: np.ndarray) -> int:
    """64 cells as one signed whole number, the first cell in the highest bit."""
    return int(np.packbits(square.ravel()).view(">i8")[0])


def cell_bits(sheets: DataFrame, layout: Layout, margin: int, radius: int) -> DataFrame:
    """One row per cell of sheets (id, sheet, grey, cells, reason): id, sheet, reason, index, text and the cell's ink,
    squared, as 64 bits.

    Cells (index, x, y, w, h, text) are cropped with a margin, white where it leaves the sheet. A sheet without an image
    or without cells stays as one row whose index is null, so that no second reading of the images is needed for it."""

    def bits(grey: np.ndarray, cell: dict) -> int:
        framed = np.pad(grey, margin, constant_values=255.0)  # the margin moves the origin by as much
        crop = framed[max(0, cell["y"]) : cell["y"] + cell["h"] + 2 * margin, max(0, cell["x"]) : cell["x"] + cell["w"] + 2 * margin]
        if not crop.size:
            return 0
        return packed(squared(levelled_ink(crop, radius), 8))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for r in batch.astype({"id": object, "sheet": object}).itertuples(index=False):
                head = (None if pd.isna(r.id) else int(r.id), None if pd.isna(r.sheet) else int(r.sheet), r.reason)
                if r.grey is None or r.cells is None or not len(r.cells):
                    rows.append((*head, None, None, None))
                    continue
                grey = np.asarray(r.grey, dtype=float).reshape(layout.height, layout.width)
                rows += [(*head, c["index"], c["text"], bits(grey, c)) for c in r.cells]
            yield pd.DataFrame(rows, columns=["id", "sheet", "reason", "index", "text", "bits"], dtype=object)

    image_batches(sheets.sparkSession)
    ready = sheets.select("id", F.col("sheet").cast("long").alias("sheet"), "grey", "cells", "reason")
    return ready.mapInPandas(run, "id long, sheet long, reason string, index int, text string, bits long")
