"""Operators on small bitmaps held as row-major arrays of 0 and 1: all but labelling are row-local expressions."""

from __future__ import annotations

import json
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bound


def ink_cells(mask: Column) -> Column:
    """Positions, from 0, of the ink."""
    return F.filter(F.sequence(F.lit(0), F.size(mask) - 1), lambda i: F.element_at(mask, i + 1) == 1)


def bbox(mask: Column, width: int) -> Column:
    """Struct x, y, w, h of the ink; null without ink. The right and lower edges are exclusive."""
    ink = ink_cells(mask)
    xs, ys = F.transform(ink, lambda i: i % width), F.transform(ink, lambda i: F.floor(i / width).cast("int"))
    x, y = F.array_min(xs), F.array_min(ys)
    box = F.struct(x.alias("x"), y.alias("y"), (F.array_max(xs) - x + 1).alias("w"), (F.array_max(ys) - y + 1).alias("h"))
    return F.when(F.size(ink) > 0, box)


def resample(mask: Column, width: int, out_width: int, out_height: int, source_x, source_y, inside) -> Column:
    """A mask whose cell (x, y) is the source cell that the two maps give, 0 where inside is false."""
    cells = F.sequence(F.lit(0), F.lit(out_width * out_height - 1))

    def cell(own: Column, t: Column) -> Column:
        x, y = t % out_width, F.floor(t / out_width).cast("int")
        sx, sy = source_x(x), source_y(y)
        return F.when(inside(sx, sy), F.try_element_at(own, (sy * width + sx + 1).cast("int"))).otherwise(F.lit(0))

    return bound(mask, lambda own: F.transform(cells, lambda t: cell(own, t)))


def truncated(c: Column) -> Column:
    """Towards zero, as an int."""
    return F.when(c >= 0, F.floor(c)).otherwise(F.ceil(c)).cast("int")


def normalised(mask: Column, box: Column, width: int, size: int) -> Column:
    """The ink's box, centred in a square, sampled to size x size by nearest neighbour; all 0 without ink."""
    # mask, box and what follows from the box are worked out once a row, not once a cell
    side = F.greatest(box["w"], box["h"])
    half = lambda c: F.floor((side - box[c]) / 2).cast("int")
    known = F.struct(mask.alias("mask"), *[box[c].alias(c) for c in "xywh"], side.alias("side"), half("w").alias("off_x"), half("h").alias("off_y"))

    def cell(k: Column, t: Column) -> Column:
        place = lambda i, off: truncated(i * k["side"] / size - k[off])
        x, y = place(t % size, "off_x"), place(F.floor(t / size), "off_y")
        inside = (x >= 0) & (x < k["w"]) & (y >= 0) & (y < k["h"])
        return F.when(inside, F.try_element_at(k["mask"], ((y + k["y"]) * width + x + k["x"] + 1).cast("int"))).otherwise(F.lit(0))

    cells = F.sequence(F.lit(0), F.lit(size * size - 1))
    return F.when(box.isNull(), F.array_repeat(F.lit(0), size * size)).otherwise(bound(known, lambda k: F.transform(cells, lambda t: cell(k, t))))


def stretched(mask: Column, box: Column, width: int, size: int) -> Column:
    """The ink's box stretched to size x size, without padding."""
    sx = lambda t: box["x"] + F.floor(t * box["w"] / size).cast("int")
    sy = lambda t: box["y"] + F.floor(t * box["h"] / size).cast("int")
    return F.when(box.isNull(), F.array_repeat(F.lit(0), size * size)).otherwise(resample(mask, width, size, size, sx, sy, lambda a, b: F.lit(True)))


def aligned(mask: Column, box: Column, width: int, height: int, canvas: int, bottom: int, center: int, target: int) -> Column:
    """The ink scaled to a target height, its lowest row at `bottom`, centred at `center`; places round half up."""
    scale = F.lit(float(target)) / box["h"]
    middle, low = (box["x"] + box["x"] + box["w"] - 1) / 2, box["y"] + box["h"] - 1
    half_up = lambda c: F.floor(c + 0.5).cast("int")
    sx = lambda t: half_up(middle + (t - center) / scale)
    sy = lambda t: half_up(low + (t - bottom) / scale)
    inside = lambda a, b: (a >= 0) & (a < width) & (b >= 0) & (b < height)
    return F.when(box.isNull(), F.array_repeat(F.lit(0), canvas * canvas)).otherwise(resample(mask, width, canvas, canvas, sx, sy, inside))


def reoriented(mask: Column, width: int, height: int, orientation: int) -> Column:
    """A mask turned or mirrored as image orientation tag 1 to 8 asks; 5 to 8 swap width and height."""
    last_x, last_y = width - 1, height - 1
    maps = {
        2: lambda x, y: (last_x - x, y), 3: lambda x, y: (last_x - x, last_y - y), 4: lambda x, y: (x, last_y - y), 5: lambda x, y: (y, x),
        6: lambda x, y: (y, last_y - x), 7: lambda x, y: (last_x - y, last_y - x), 8: lambda x, y: (last_x - y, x),
    }
    if orientation not in maps:
        return mask
    w, h = (height, width) if orientation >= 5 else (width, height)

    def cell(own: Column, t: Column) -> Column:
        sx, sy = maps[orientation](t % w, F.floor(t / w).cast("int"))
        return F.element_at(own, (sy * width + sx + 1).cast("int"))

    return bound(mask, lambda own: F.transform(F.sequence(F.lit(0), F.lit(w * h - 1)), lambda t: cell(own, t)))


def cropped(mask: Column, width: int, height: int, left: int, upper: int, out_width: int, out_height: int) -> Column:
    """A window of a mask, its upper left cell at (left, upper); cells outside the mask are 0."""
    inside = lambda a, b: (a >= 0) & (a < width) & (b >= 0) & (b < height)
    return resample(mask, width, out_width, out_height, lambda t: t + left, lambda t: t + upper, inside)


def turned(mask: Column, width: int, height: int, degrees: float) -> Column:
    """A mask turned around its centre, nearest cells; what comes from outside is 0."""
    cos, sin = math.cos(math.radians(degrees)), math.sin(math.radians(degrees))
    mid_x, mid_y = (width - 1) / 2, (height - 1) / 2

    def cell(own: Column, t: Column) -> Column:
        x, y = t % width - mid_x, F.floor(t / width) - mid_y
        sx, sy = F.floor(mid_x + cos * x + sin * y + 0.5).cast("int"), F.floor(mid_y - sin * x + cos * y + 0.5).cast("int")
        inside = (sx >= 0) & (sx < width) & (sy >= 0) & (sy < height)
        return F.when(inside, F.try_element_at(own, sy * width + sx + 1)).otherwise(F.lit(0))

    return bound(mask, lambda own: F.transform(F.sequence(F.lit(0), F.lit(width * height - 1)), lambda t: cell(own, t)))


def softened(values: Column, width: int, height: int) -> Column:
    """3 x 3 mean of the cells inside the image."""
    total = lambda own, n: F.aggregate(n, F.lit(0.0), lambda s, j: s + F.element_at(own, j))
    return bound(values, lambda own: F.transform(_near(width, height, 1), lambda n: total(own, n) / F.size(n)))


def _near(width: int, height: int, radius: int) -> Column:
    """For each cell, the positions from 1 of the cells of its clipped square window: one folded literal."""
    cells = [(x, y) for y in range(height) for x in range(width)]
    near = [[b * width + a + 1 for b in range(max(0, y - radius), min(height, y + radius + 1)) for a in range(max(0, x - radius), min(width, x + radius + 1))] for x, y in cells]
    return F.from_json(F.lit(json.dumps(near)), "array<array<int>>")


def levelled(values: Column, width: int, height: int, radius: int) -> Column:
    """Value less the mean of its clipped window plus 255, held to [0, 255]."""
    total = lambda own, n: F.aggregate(n, F.lit(0.0), lambda s, j: s + F.element_at(own, j))
    means = bound(values, lambda own: F.transform(_near(width, height, radius), lambda n: total(own, n) / F.size(n)))
    return F.zip_with(values, means, lambda v, m: F.least(F.lit(255.0), F.greatest(F.lit(0.0), v - m + 255)))


def morphed(mask: Column, width: int, height: int, grow: bool) -> Column:
    """3 x 3 maximum (grow) or minimum of the cells inside the image."""
    pick = F.array_max if grow else F.array_min
    return bound(mask, lambda own: F.transform(_near(width, height, 1), lambda n: pick(F.transform(n, lambda j: F.element_at(own, j)))))


def box_blurred(values: Column, width: int, height: int, radius: int) -> Column:
    """Mean along rows, then along columns, with the edge cells repeated."""

    def near(along_x: bool) -> Column:
        clamp = lambda v, size: min(size - 1, max(0, v))
        cells = [(x, y) for y in range(height) for x in range(width)]
        steps = range(-radius, radius + 1)
        lists = [[(y * width + clamp(x + k, width) if along_x else clamp(y + k, height) * width + x) + 1 for k in steps] for x, y in cells]
        return F.from_json(F.lit(json.dumps(lists)), "array<array<int>>")

    def once(own: Column, along_x: bool) -> Column:
        return F.transform(near(along_x), lambda n: F.aggregate(n, F.lit(0.0), lambda s, j: s + F.element_at(own, j)) / (2 * radius + 1))

    return bound(bound(values, lambda own: once(own, True)), lambda own: once(own, False))


def component_labels(ink: np.ndarray, diagonal: bool = True) -> np.ndarray:
    """The position of its component's first cell for each cell of ink (mask, y, x), all masks at once."""
    steps = [(dx, dy) for dx in (-1, 0, 1) for dy in (-1, 0, 1) if (dx or dy) and (diagonal or not (dx and dy))]
    n, height, width = ink.shape
    none = height * width
    own = np.where(ink, np.arange(none).reshape(height, width), none)
    while True:
        framed = np.pad(own, ((0, 0), (1, 1), (1, 1)), constant_values=none)
        near = [framed[:, 1 + dy : 1 + dy + height, 1 + dx : 1 + dx + width] for dx, dy in steps]
        new = np.where(ink, np.minimum.reduce([own, *near]), none)
        # each cell then follows the label of the cell that its label names
        flat = np.concatenate((new.reshape(n, none), np.full((n, 1), none)), axis=1)
        new = np.take_along_axis(flat, new.reshape(n, none), axis=1).reshape(own.shape)
        if (new == own).all():
            return own
        own = new


COMPONENT = "id long, component int, x int, y int, w int, h int, pixels int"


def components(df: DataFrame, id_col: str, mask_col: str, width: int, least: int = 1, diagonal: bool = True) -> DataFrame:
    """Connected ink of each mask: number (in order of the first cell), box and number of cells; small ones go.

    Labels spread over all masks of an Arrow batch at once, and nothing is shuffled."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(pc.greater(pc.list_value_length(batch.column(1)), 0))
            for size in np.unique(pc.list_value_length(batch.column(1)).to_numpy(zero_copy_only=False)):
                part = batch.filter(pc.equal(pc.list_value_length(batch.column(1)), int(size)))
                ink = part.column(1).flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, -1, width) > 0
                row, y, x = np.nonzero(ink)
                key = row * int(size) + component_labels(ink, diagonal)[row, y, x]
                found, at, pixels = np.unique(key, return_inverse=True, return_counts=True)
                low, high = np.full((2, len(found)), size), np.full((2, len(found)), -1)
                for d, place in enumerate((x, y)):
                    np.minimum.at(low[d], at, place)
                    np.maximum.at(high[d], at, place)
                keep = pixels >= least
                owner = (found // int(size))[keep]
                number = np.arange(len(owner)) - np.searchsorted(owner, owner)
                columns = [pa.array(part.column(0).to_numpy(zero_copy_only=False)[owner], pa.int64())]
                columns += [pa.array(c, pa.int32()) for c in (number, *low[:, keep], *(high - low + 1)[:, keep], pixels[keep])]
                yield pa.RecordBatch.from_arrays(columns, ["id", "component", "x", "y", "w", "h", "pixels"])

    return df.select(F.col(id_col).cast("long").alias("id"), F.col(mask_col).alias("mask")).where("id is not null").mapInArrow(run, COMPONENT)


def role(c: str, base: str) -> Column:
    """Place of a component relative to its character's base; the first rule that holds decides."""
    bottom = lambda s: F.col(f"{s}.y") + F.col(f"{s}.h")
    return (
        F.when(F.col(f"{c}.component") == F.col(f"{base}.component"), "base").when(bottom(c) <= F.col(f"{base}.y"), "superposed")
        .when(F.col(f"{c}.y") >= bottom(base), "underposed").when(F.col(f"{c}.x") >= F.col(f"{base}.x") + F.col(f"{base}.w"), "right").otherwise("unknown")
    )
