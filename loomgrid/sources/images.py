"""Image sources and sinks: PNG in numpy and zlib, JPEG by Spark's image source, orientation, datasets, sheets, SVG."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

IMAGE = "path string, width int, height int, data binary, ok boolean, reason string"
_SIGNATURE = b"\x89PNG\r\n\x1a\n"
#: Fixed values of the file format: channels of each colour type, and the interlace passes as x and y of the first
#: pixel and the steps from pixel to pixel.
_CHANNELS = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}
_PASSES = ((0, 0, 8, 8), (4, 0, 8, 8), (0, 4, 4, 8), (2, 0, 4, 4), (0, 2, 2, 4), (1, 0, 2, 2), (0, 1, 1, 2))


def encode_png(rgba: np.ndarray) -> bytes:
    """PNG bytes of an array of shape (height, width, 4)."""
    height, width = rgba.shape[:2]

    def chunk(kind: bytes, body: bytes) -> bytes:
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    raw = np.concatenate((np.zeros((height, 1), dtype=np.uint8), rgba.astype(np.uint8).reshape(height, width * 4)), axis=1).tobytes()
    return _SIGNATURE + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 6, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def _unfiltered(rows: np.ndarray, step: int) -> np.ndarray:
    """Bytes of lines whose first byte names the filter of the others; step: bytes from a pixel to the one before."""
    out = np.zeros((len(rows), rows.shape[1] - 1), dtype=np.uint8)
    above = np.zeros(out.shape[1], dtype=np.uint8)
    for y, (kind, line) in enumerate(zip(rows[:, 0], rows[:, 1:], strict=True)):
        if kind == 0:
            out[y] = line
        elif kind == 1:
            for k in range(step):
                out[y, k::step] = np.cumsum(line[k::step], dtype=np.uint8)
        elif kind == 2:
            out[y] = line + above
        elif kind in (3, 4):
            own = [0] * step + line.tolist()
            up = [0] * step + above.tolist()
            for x in range(step, len(own)):
                a, b, c = own[x - step], up[x], up[x - step]
                guess = (a + b) // 2 if kind == 3 else min((a, b, c), key=lambda v: abs(a + b - c - v))
                own[x] = (own[x] + guess) & 255
            out[y] = own[step:]
        else:
            raise ValueError("unknown filter")
        above = out[y]
    return out


def _samples(body: bytes, at: int, width: int, height: int, depth: int, channels: int) -> tuple[np.ndarray, int]:
    """Samples (height, width, channel) of an image or of one pass of it, and where its bytes end."""
    line, step = (width * channels * depth + 7) // 8, max(1, channels * depth // 8)
    end = at + height * (line + 1)
    if end > len(body):
        raise ValueError("too few bytes")
    raw = _unfiltered(np.frombuffer(body, np.uint8, end - at, at).reshape(height, line + 1), step)
    if depth == 16:
        values = raw.view(">u2").astype(np.uint16)
    elif depth == 8:
        values = raw
    else:
        places = np.arange(8 // depth - 1, -1, -1, dtype=np.uint8) * depth
        values = ((raw[:, :, None] >> places) & ((1 << depth) - 1)).reshape(height, -1)
    return values[:, : width * channels].reshape(height, width, channels), end


def decode_png(data: bytes) -> np.ndarray:
    """Array of shape (height, width, 4), 8 bits a channel, of a PNG of any colour type, depth and interlacing.

    Samples of 16 bits keep their upper half, those of fewer than 8 are spread over the whole range; the colours and
    opacities of a palette, or the one transparent colour, become RGBA."""
    if data[:8] != _SIGNATURE:
        raise ValueError("not a PNG")
    at, body, head, palette, clear = 8, [], None, None, b""
    while at + 8 <= len(data):
        size, kind = struct.unpack(">I4s", data[at : at + 8])
        part = data[at + 8 : at + 8 + size]
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", part)
        elif kind == b"PLTE":
            palette = np.frombuffer(part, np.uint8).reshape(-1, 3)
        elif kind == b"tRNS":
            clear = part
        elif kind == b"IDAT":
            body.append(part)
        at += 12 + size
    if head is None or head[3] not in _CHANNELS or head[2] not in (1, 2, 4, 8, 16) or (head[3] == 3 and palette is None):
        raise ValueError("unsupported kind of PNG")
    width, height, depth, colours, interlaced = head[0], head[1], head[2], head[3], head[6]
    channels, raw = _CHANNELS[colours], zlib.decompress(b"".join(body))
    if interlaced:
        pixels, at = np.zeros((height, width, channels), dtype=np.uint16), 0
        for x, y, dx, dy in _PASSES:
            if x < width and y < height:
                pixels[y::dy, x::dx], at = _samples(raw, at, -(-(width - x) // dx), -(-(height - y) // dy), depth, channels)
    else:
        pixels, _ = _samples(raw, 0, width, height, depth, channels)
    opaque = np.full((height, width, 1), 255, dtype=np.uint8)
    if colours == 3:
        if pixels.size and pixels.max() >= len(palette):
            raise ValueError("colour outside the palette")
        alphas = np.concatenate((np.frombuffer(clear, np.uint8), np.full(256, 255, dtype=np.uint8)))
        return np.concatenate((palette[pixels[:, :, 0]], alphas[pixels]), axis=2)
    if clear and colours in (0, 2):
        opaque[(pixels == np.frombuffer(clear, ">u2")[:channels]).all(axis=2)] = 0
    pixels = (pixels >> 8 if depth == 16 else pixels * (255 // ((1 << depth) - 1))).astype(np.uint8)
    colour = pixels[:, :, :3] if channels >= 3 else np.repeat(pixels[:, :, :1], 3, axis=2)
    return np.concatenate((colour, pixels[:, :, -1:] if channels in (2, 4) else opaque), axis=2)


def jpeg_orientation(data: bytes) -> int:
    """The orientation tag (1 to 8) of a JPEG, in either byte order; 1 without one."""
    at = 2
    while at + 4 <= len(data) and data[at] == 0xFF:
        size = struct.unpack(">H", data[at + 2 : at + 4])[0]
        if data[at + 1] == 0xE1 and data[at + 4 : at + 10] == b"Exif\0\0":
            tiff = data[at + 10 : at + 2 + size]
            order = "<" if tiff[:2] == b"II" else ">"
            first = struct.unpack(order + "I", tiff[4:8])[0]
            for i in range(struct.unpack(order + "H", tiff[first : first + 2])[0]):
                entry = tiff[first + 2 + 12 * i : first + 14 + 12 * i]
                if len(entry) == 12 and struct.unpack(order + "H", entry[:2])[0] == 0x0112:
                    value = struct.unpack(order + "H", entry[8:10])[0]
                    return value if 1 <= value <= 8 else 1
        at += 2 + size
    return 1


def oriented(pixels: np.ndarray, orientation: int) -> np.ndarray:
    """Pixels (height, width, channel) turned or mirrored as orientation tag 1 to 8 asks."""
    if orientation >= 5:
        pixels = pixels.transpose(1, 0, 2)
    if orientation in (2, 3, 6, 7):
        pixels = pixels[:, ::-1]
    if orientation in (3, 4, 7, 8):
        pixels = pixels[::-1]
    return pixels


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """One row per file of a folder: size and RGBA bytes, or why it could not be read. The kind is told by content.

    JPEG files are decoded by Spark's own image source and then turned as their orientation tag asks; files that
    it cannot decode stay as rows with a reason. PNG files are decoded here."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    is_jpeg = F.hex(F.substring("content", 1, 3)) == "FFD8FF"
    tagged = files.where(is_jpeg).select(F.regexp_replace("path", "^file:/+", "/").alias("at"), "path", "content")
    decoded = spark.read.format("image").option("dropInvalid", True).load(path).select("image.*")
    decoded = decoded.select(F.regexp_replace("origin", "^file:/+", "/").alias("at"), "height", "width", "nChannels", F.col("data").alias("raw"))

    def png(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame([_row(name, lambda c=content: decode_png(c)) for name, content in zip(batch["path"], batch["content"], strict=True)], columns=_COLUMNS)

    def jpeg(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def pixels(r) -> np.ndarray:
            if r.raw is None:
                raise ValueError(f"undecodable JPEG; orientation {jpeg_orientation(r.content)}")
            image = np.frombuffer(r.raw, dtype=np.uint8).reshape(int(r.height), int(r.width), int(r.nChannels))
            colour = image[:, :, 2::-1] if r.nChannels >= 3 else np.repeat(image, 3, axis=2)  # blue comes first
            rgba = np.concatenate((colour, np.full((*image.shape[:2], 1), 255, dtype=np.uint8)), axis=2)
            return oriented(rgba, jpeg_orientation(r.content))

        for batch in batches:
            yield pd.DataFrame([_row(r.path, lambda r=r: pixels(r)) for r in batch.itertuples(index=False)], columns=_COLUMNS)

    turned = tagged.join(decoded, "at", "left").select("path", "content", "height", "width", "nChannels", "raw")
    return files.where(~is_jpeg).mapInPandas(png, IMAGE).unionByName(turned.mapInPandas(jpeg, IMAGE))


_COLUMNS = ["path", "width", "height", "data", "ok", "reason"]


def _row(name: str, decode: Callable[[], np.ndarray]) -> tuple:
    """A file's row: its pixels, or the reason why there are none."""
    try:
        image = decode()
        return name, image.shape[1], image.shape[0], image.tobytes(), True, None
    except (ValueError, struct.error, zlib.error) as problem:
        return name, None, None, None, False, str(problem)


def svg_wrapper(path: Column, x_min: Column, y_min: Column, x_max: Column, y_max: Column) -> Column:
    """An SVG document of one outline in font coordinates, whose y axis points up: the view box is mirrored."""
    view = F.concat_ws(" ", *[c.cast("string") for c in (x_min, -y_max, x_max - x_min, y_max - y_min)])
    return F.concat(F.lit('<svg xmlns="http://www.w3.org/2000/svg" viewBox="'), view, F.lit('"><g transform="scale(1 -1)"><path d="'), path, F.lit('"/></g></svg>'))


def write_dataset(samples: DataFrame, path: str) -> None:
    """Images (class, file, png bytes) as a dataset: a table in one folder per class, and a manifest of all samples.

    The manifest has one line a sample, written by as many tasks as there are parts, so its size does not matter."""
    samples.select("class", "file", "png").write.mode("overwrite").partitionBy("class").parquet(f"{path}/images")
    samples.drop("png").write.mode("overwrite").json(f"{path}/manifest")


def write_sheets(cells: DataFrame, path: str) -> None:
    """Capture sheets: one JSON document per sheet with its cells in order; a sheet has a bounded number of cells."""
    names = [c for c in cells.columns if c != "sheetId"]
    listed = F.array_sort(F.collect_list(F.struct(*names)))
    cells.groupBy("sheetId").agg(listed.alias("cells")).withColumn("sheet", F.col("sheetId")).write.mode("overwrite").partitionBy("sheet").json(path)
