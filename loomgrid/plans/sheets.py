"""The flow from photographed sheets to scored cells. The supplied tables hold no photographs, so they are drawn."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import decoding as D
from ..operators import matching as M
from ..operators import scanning as C
from ..operators.common import slices, spread
from ..session import ship
from .raster import SIDE
from .registry import query, table

#: The sheet, its three cells, the margin around a cell and the radius of levelling.
LAYOUT = C.Layout(128, 96, ((12, 12), (116, 12), (116, 84), (12, 84)), (28, 6, 12, 12), tuple((44 + 16 * i, 6, 6, 12) for i in range(4)))
CELLS = [(14 + 35 * k, 36, 30, 30) for k in range(3)]
MARGIN, RADIUS = 1, 12
#: Sheets with a manifest; any other number, and none, is read by the manifest without a number.
SHEETS = 6
#: A photograph is larger than the sheet by this much on each side; half the side of a mark, and the cells of a glyph's pixel.
AROUND, HALF, SCALE = 8, 7, 3


def _text(sheet: int, k: int) -> int:
    """What stands in a cell: the label of a glyph."""
    return (sheet * 3 + k * 4) % 10


def draw(vec_id: int, embedding: np.ndarray, glyphs: dict[int, np.ndarray]) -> np.ndarray:
    """A photograph of sheet vec_id % 8: skewed by the first eight values, darker to the left, grained by all values.

    Every fortieth sheet has lost a corner."""
    page = np.full((LAYOUT.height, LAYOUT.width), 250.0)
    for i, (x, y) in enumerate(LAYOUT.marks):
        if vec_id % 40 == 39 and i == 1:
            continue
        page[y - HALF : y + HALF + 1, x - HALF : x + HALF + 1] = 20
        if i == 2:
            page[y - 2 : y + 3, x - 2 : x + 3] = 250
    sheet = vec_id % 8
    for i, (x, y, w, h) in enumerate(LAYOUT.bits):
        if sheet >> (len(LAYOUT.bits) - 1 - i) & 1:
            page[y : y + h, x : x + w] = 20
    for k, (x, y, _, _) in enumerate(CELLS):
        glyph = glyphs.get(_text(sheet if 1 <= sheet <= SHEETS else 0, k))
        if glyph is not None:
            ink = np.kron(glyph.reshape(SIDE, SIDE), np.ones((SCALE, SCALE)))
            page[y + 3 : y + 3 + SIDE * SCALE, x + 3 : x + 3 + SIDE * SCALE] -= 200 * ink
    edge = np.array([(0, 0), (LAYOUT.width - 1, 0), (LAYOUT.width - 1, LAYOUT.height - 1), (0, LAYOUT.height - 1)], dtype=float)
    seen = edge + AROUND + 8 * np.clip(embedding[:8].reshape(4, 2), -0.5, 0.5)
    height, width = LAYOUT.height + 2 * AROUND, LAYOUT.width + 2 * AROUND
    photo = C.warped(page[None], np.linalg.inv(C.homographies(seen[None], edge)), 250.0, (height, width))[0]
    return photo * np.linspace(0.8, 1.0, width) + np.resize(4 * embedding, photo.shape)


def photographs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, dict[int, np.ndarray]]:
    """Photographs (id, width, grey), and the glyph of each label: its first bitmap."""
    items = table(spark, sf_dir, "embeddings").select("vec_id", "label", F.transform("embedding", lambda v: (v > 0.12).cast("int")).alias("mask"))
    # a row a label of those that stand on sheets, ten at most
    glyphs = {r["label"]: np.array(r["mask"]) for r in M.templates_first(items.where("label BETWEEN 0 AND 9"), "label", "vec_id").collect()}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in slices(batches, 8 * (LAYOUT.width + 2 * AROUND) * (LAYOUT.height + 2 * AROUND)):
            photos = [draw(v, np.asarray(e, dtype=float), glyphs) for v, e in zip(batch["vec_id"], batch["embedding"], strict=True)]
            yield pd.DataFrame({"id": batch["vec_id"], "width": [p.shape[1] for p in photos], "grey": [p.ravel() for p in photos]})

    ship(spark)
    return spread(table(spark, sf_dir, "embeddings").select("vec_id", "embedding")).mapInPandas(run, "id long, width int, grey array<double>"), glyphs


def manifests(spark: SparkSession) -> DataFrame:
    """sheet, cells of the numbered sheets and of the one without a number."""
    rows = [(s or None, [(k, *CELLS[k], str(_text(s, k))) for k in range(len(CELLS))]) for s in range(SHEETS + 1)]
    return spark.createDataFrame(rows, "sheet int, cells array<struct<index: int, x: int, y: int, w: int, h: int, text: string>>")


@query()
def q_sheet_reading(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Photographs set straight by their corner marks, numbered by their strips, joined to manifests, their cells cropped,
    levelled, read by the glyphs and compared with what the manifest says; one without its corners stays, with a status."""
    captures, glyphs = photographs(spark, sf_dir)
    sheets = C.straightened(captures, LAYOUT).withColumn("sheet", C.sheet_number(F.col("grey"), LAYOUT))
    cells = C.cell_bits(C.with_cells(sheets, manifests(spark)), LAYOUT, MARGIN, RADIUS)
    known = [("glyph", label, label, C.packed(C.squared(mask.reshape(SIDE, SIDE) > 0, SIDE))) for label, mask in sorted(glyphs.items())]
    book = spark.createDataFrame(known, "pool string, id long, label int, bits long")
    found = D.best(F.col("bits"), D.zone(0, 64), "glyph")["label"].cast("string")
    rows = cells.crossJoin(D.book(book)).withColumn("ok", found == F.col("text"))
    status = F.when(F.first("reason").isNotNull(), "no corners").when(F.count("index") == 0, "no manifest").otherwise("read")
    by = rows.groupBy(F.col("id").alias("vec_id")).agg(F.first("sheet").alias("sheet"), status.alias("status"), F.count("index").alias("cells"), F.count(F.when(F.col("ok"), 1)).alias("ok"))
    return by.select("sheet", "vec_id", "status", "cells", "ok")
