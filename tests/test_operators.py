"""Edge cases on hand-written inputs."""

import json
import math
import random
import struct

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomgrid.functions import geometry as G
from loomgrid.functions import text as T
from loomgrid.operators import aggregates as A
from loomgrid.operators import heads
from loomgrid.operators import lookups as L
from loomgrid.operators import matching as M
from loomgrid.operators import raster as R
from loomgrid.operators import sampling as P
from loomgrid.operators import sequences as S
from loomgrid.plans import decoders, raster
from loomgrid.sources import images, records


def bitmap(*lines):
    return [int(c == "#") for line in lines for c in line]


def one(spark, mask, *columns):
    return spark.createDataFrame([(mask,)], "m array<int>").select(*columns).first()


def test_box_and_empty(spark):
    m = bitmap("....", ".##.", "..#.", "....")
    assert tuple(one(spark, m, R.bbox(F.col("m"), 4).alias("b"))["b"]) == (1, 1, 2, 2)
    assert one(spark, [0] * 16, R.bbox(F.col("m"), 4).alias("b"))["b"] is None


def test_normalised_does_not_depend_on_place_or_scale(spark):
    small, big = bitmap("#...", "##..", "....", "...."), bitmap("........", "........", "..##....", "..##....", "..####..", "..####..", "........", "........")
    norm = lambda m, w: one(spark, m, R.normalised(F.col("m"), R.bbox(F.col("m"), w), w, 8).alias("n"))["n"]
    assert norm(small, 4) == norm(big, 8)
    assert sum(norm([0] * 16, 4)) == 0


def test_normalised_truncates_towards_zero(spark):
    # a 1 x 3 bar is centred in a 3 x 3 square: the column left of it maps into it as well
    m = bitmap("#..", "#..", "#..")
    got = one(spark, m, R.normalised(F.col("m"), R.bbox(F.col("m"), 3), 3, 6).alias("n"))["n"]
    assert got[:6] == [0, 1, 1, 1, 0, 0]


def test_orientation_inverse(spark):
    m = bitmap("##..", "#...", "....", "...#")
    turned = one(spark, m, R.reoriented(F.col("m"), 4, 4, 6).alias("t"))["t"]
    assert one(spark, turned, R.reoriented(F.col("m"), 4, 4, 8).alias("t"))["t"] == m
    assert one(spark, m, R.reoriented(F.col("m"), 4, 4, 1).alias("t"))["t"] == m


def test_components_connectivity(spark):
    df = spark.createDataFrame([(1, bitmap("#...", ".#..", "....", "..##")), (2, [0] * 16)], "i long, m array<int>")
    assert sorted(r["pixels"] for r in R.components(df, "i", "m", 4).collect()) == [2, 2]
    assert sorted(r["pixels"] for r in R.components(df, "i", "m", 4, diagonal=False).collect()) == [1, 1, 2]
    assert R.components(df, "i", "m", 4, least=3).count() == 0


def test_distance_field_and_similarity(spark):
    m = bitmap(".....", ".....", "..#..", ".....", ".....")
    field = one(spark, m, M.distance_field(F.col("m"), 5).alias("f"))["f"]
    assert field[12] == 0 and field[11] == 1 and math.isclose(field[6], 2**0.5) and math.isclose(field[0], 2 * 2**0.5)
    both = spark.createDataFrame([(m, bitmap("#....", ".....", ".....", ".....", "....#"), [0] * 25)], "a array<int>, b array<int>, z array<int>")
    f = {c: M.distance_field(F.col(c), 5) for c in "abz"}
    s = lambda x, y: M.chamfer_similarity(f[x], F.col(x), f[y], F.col(y))
    r = both.select(s("a", "b").alias("ab"), s("b", "a").alias("ba"), s("a", "a").alias("aa"), s("a", "z").alias("az")).first()
    assert r["ab"] == r["ba"] and r["aa"] == 1 and r["az"] == 0 and 0 < r["ab"] < 1


def test_spans_keep_the_unterminated_one(spark):
    df = spark.createDataFrame([(i, c) for i, c in enumerate("a|bc|d|ef")], "i int, c string")
    got = S.toggle_spans(df, W.partitionBy().orderBy("i"), F.col("c") == "|").groupBy("span").agg(F.concat_ws("", F.array_sort(F.collect_list("c"))).alias("s"))
    assert sorted(map(tuple, got.collect())) == [(1, "bc"), (2, "ef")]


def test_attach_drops_what_has_no_owner(spark):
    df = spark.createDataFrame([(0, False), (1, True), (2, False), (3, True)], "i int, big boolean")
    got = df.select("i", S.attach_previous(W.partitionBy().orderBy("i"), F.col("big"), F.col("i")).alias("o")).orderBy("i").collect()
    assert [r["o"] for r in got] == [None, None, 1, 1]


def test_interval_merge_is_inclusive(spark):
    df = spark.createDataFrame([(1, 0, 4), (1, 6, 7), (1, 10, 11), (2, 0, 0)], "k int, a int, b int")
    got = S.interval_groups(df, ["k"], "a", "b", 2, ["b"]).groupBy("k").agg(F.max("group").alias("n"))
    assert dict(map(tuple, got.collect())) == {1: 2, 2: 1}


@pytest.mark.parametrize("n,k", [(0, 3), (1, 3), (3, 3), (10, 3), (11, 4), (100, 7)])
def test_even_sample(spark, n, k):
    df = spark.range(n).withColumn("g", F.lit(1))
    got = sorted(r["id"] for r in S.even_sample(df, ["g"], ["id"], k).collect())
    assert got == (list(range(n)) if n <= k else [i * n // k for i in range(k)])


def test_upper_median(spark):
    df = spark.createDataFrame([("a", 3.0), ("a", 1.0), ("a", 2.0), ("a", 9.0), ("b", 5.0)], "k string, v double")
    assert dict(map(tuple, S.upper_median(df, ["k"], "v").collect())) == {"a": 3.0, "b": 5.0}


def test_otsu_takes_the_smallest_of_equal_thresholds(spark):
    df = spark.createDataFrame([(10,)] * 5 + [(200,)] * 5, "v long")
    assert A.otsu(df, "v").first()["t"] == 10


def test_gate_slack_and_no_rows(spark):
    df = spark.createDataFrame([(95, 100), (94, 100), (0, 0)], "ok long, n long")
    assert [r[0] for r in df.select(A.gate(F.col("ok"), F.col("n"), 95.0)).collect()] == [True, False, False]


def test_quotas_fill_once_around(spark):
    df = spark.createDataFrame([("a", 3), ("b", 3), ("c", 1)], "k string, n long")
    got = dict((r["k"], r["quota"]) for r in P.quotas(df, "k", "n", 10).collect())
    assert got == {"a": 5, "b": 4, "c": 1}


def test_head_split_takes_one_at_least(spark):
    df = spark.createDataFrame([("a", i) for i in range(2)] + [("b", i) for i in range(8)], "k string, i int")
    got = {(r["k"], r["part"]): r["n"] for r in P.head_split(df, ["k"], ["i"], 0.25, 4).groupBy("k", "part").agg(F.count("*").alias("n")).collect()}
    assert got == {("a", "test"): 1, ("a", "train"): 1, ("b", "test"): 2, ("b", "train"): 4, ("b", "unused"): 2}


def scalar_draw(seed, i):
    mask, out = 0xFFFFFFFF, (seed + i * P.STEP) & 0xFFFFFFFF
    t = ((out ^ out >> 15) * (out | 1)) & mask
    t = ((t + (((t ^ t >> 7) * (t | 61)) & mask)) & mask) ^ t
    return (t ^ t >> 14) / 2**32


def test_draws(spark):
    df = spark.createDataFrame([(s, i) for s in (0, 1, 42, 2**31) for i in range(1, 20)], "s long, i long").withColumn("u", P.draw(F.col("s"), F.col("i")))
    assert all(r["u"] == scalar_draw(r["s"], r["i"]) for r in df.collect())


def test_merge_and_invert(spark):
    base = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    new = spark.createDataFrame([(2, "x"), (1, None), (3, "z")], "k int, v string")
    assert sorted(map(tuple, L.merge_update(base, new, "k", ["v"]).collect())) == [(1, "a"), (2, "x")]
    df = spark.createDataFrame([("p", 1, 0), ("q", 1, 1), ("r", 2, 2)], "k string, v int, o int")
    assert sorted((r["v"], r["k"]) for r in L.invert(df, "k", "v", "o").collect()) == [(1, "q"), (2, "r")]


def test_range_audit_statuses(spark):
    present = spark.createDataFrame([(1,), (2,), (2,), (5,)], "k long")
    ranges = spark.createDataFrame([("full", 1, 2), ("gap", 4, 6), ("one", 5, 5)], "name string, low long, high long")
    got = {r["name"]: (r["missing"], r["status"]) for r in L.range_audit(present, "k", ranges).collect()}
    assert got == {"full": (0, "EXCESS"), "gap": (2, "GAP"), "one": (0, "OK")}


def test_text_expressions(spark):
    df = spark.createDataFrame([("ač'¿é_9",)], "s string")
    r = df.select(T.slug(F.col("s")).alias("slug"), T.from_bits(T.bits(F.lit(37), 8)).alias("n"), T.from_bits(T.bits(F.lit(0), 8)).alias("z"), T.drop_lines(F.lit('{"a": 1,\n"cut": 2\n}'), '"cut"').alias("d")).first()
    assert r["slug"] == "ac_hacekapostropheiquestue9_9" and r["n"] == 37 and r["z"] is None and json.loads(r["d"]) == {"a": 1}
    fixed, status = T.add_attribute(F.col("s"), "path", 't="1"', "t")
    df = spark.createDataFrame([("<path d>",), ('<path t="1">',), ("<g>",)], "s string").select(fixed.alias("f"), status.alias("st"))
    assert [tuple(r) for r in df.collect()] == [('<path t="1" d>', "patched"), ('<path t="1">', "already_fixed"), ("<g>", "no_tag")]


def test_path_flatten():
    lines = G.flatten("M0 0L4 0V3H0Z M1 1C1 2 3 2 3 1")
    assert lines[0] == [(0, 0), (4, 0), (4, 3), (0, 3), (0, 0)] and len(lines[1]) == 1 + G.STEPS and lines[1][-1] == (3, 1)
    assert G.flatten("") == [] and G.flatten("M1 x") == []
    assert np.allclose(G.flatten("M0 0Q1 2 2 0")[0][5], (1, 1))


def test_relative_paths_equal_absolute_ones():
    same = lambda a, b: [np.round(x, 9).tolist() for x in G.flatten(a)] == [np.round(x, 9).tolist() for x in G.flatten(b)]
    assert same("m1 2l3 0h2v-1q1 1 2 0c0 1 1 1 1 0z", "M1 2L4 2H6V1Q7 2 8 1C8 2 9 2 9 1Z")
    assert same("m1 1 2 0 0 2z l1 1", "M1 1L3 1L3 3Z M1 1L2 2")
    assert same("M0 0L1 1M5 5M6 6L7 7", "M0 0L1 1M6 6L7 7") and G.flatten("M5 5") == []
    assert same("M0-1.5.5.25", "M0 -1.5 L.5 .25") and same("M1e1 2E-1l-1-1", "M10 .2L9 -.8")


@given(st.integers(1, 9), st.integers(1, 7), st.integers(0, 99))
@settings(max_examples=30, deadline=None)
def test_png_round_trip(width, height, seed):
    image = np.random.default_rng(seed).integers(0, 256, (height, width, 4), dtype=np.uint8)
    assert (images.decode_png(images.encode_png(image)) == image).all()


def test_png_filters_and_bad_files(spark, tmp_path):
    import struct
    import zlib

    raw = np.random.default_rng(1).integers(0, 256, (6, 12), dtype=np.int64)  # 4 x 6, RGB, one filter a row
    body = b""
    for y, kind in enumerate([0, 1, 2, 3, 4, 4]):
        line = bytearray()
        for x in range(12):
            a, b, c = raw[y, x - 3] if x >= 3 else 0, raw[y - 1, x] if y else 0, raw[y - 1, x - 3] if y and x >= 3 else 0
            guess = [0, a, b, (a + b) // 2, min((a, b, c), key=lambda v, p=a + b - c: abs(p - v))][kind]
            line.append((raw[y, x] - guess) % 256)
        body += bytes([kind]) + bytes(line)
    chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    data = images._SIGNATURE + chunk(b"IHDR", struct.pack(">IIBBBBB", 4, 6, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(body)) + chunk(b"IEND", b"")
    assert (images.decode_png(data)[:, :, :3].reshape(6, 12) == raw).all()
    (tmp_path / "a.jpg").write_bytes(data)  # the kind is told by content
    (tmp_path / "b.png").write_bytes(b"\xff\xd8\xff\xe1\x00\x1eExif\0\0MM\0*\0\0\0\x08\0\x01\x01\x12\0\x03\0\0\0\x01\0\x06\0\0")
    (tmp_path / "c.png").write_bytes(b"nothing")
    rows = {r["path"][-5:]: r for r in images.read_images(spark, str(tmp_path)).collect()}
    assert rows["a.jpg"]["ok"] and rows["a.jpg"]["width"] == 4 and rows["b.png"]["reason"].endswith("6") and not rows["c.png"]["ok"]


def png_of(pixels, depth, colours, interlaced, *more):
    """A PNG, without filters, of samples (height, width, channel), written bit by bit."""
    import struct
    import zlib

    def part(image):
        lines = []
        for row in image if image.size else []:
            bits = "".join(format(int(v), f"0{depth}b") for v in row.reshape(-1))
            bits += "0" * (-len(bits) % 8)
            lines.append(b"\0" + bytes(int(bits[i : i + 8], 2) for i in range(0, len(bits), 8)))
        return b"".join(lines)

    grid = ["16462646", "77777777", "56565656", "77777777", "36463646", "77777777", "56565656", "77777777"]  # the pass of each pixel of a block
    height, width = pixels.shape[:2]
    body = part(pixels)
    if interlaced:
        body = b""
        for n in "1234567":
            rows = [[pixels[y, x] for x in range(width) if grid[y % 8][x % 8] == n] for y in range(height)]
            body += part(np.array([r for r in rows if r]))
    chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    head = struct.pack(">IIBBBBB", width, height, depth, colours, 0, 0, interlaced)
    return images._SIGNATURE + chunk(b"IHDR", head) + b"".join(chunk(k, d) for k, d in more) + chunk(b"IDAT", zlib.compress(body)) + chunk(b"IEND", b"")


@pytest.mark.parametrize(("depth", "colours"), [(d, 0) for d in (1, 2, 4, 8, 16)] + [(d, 3) for d in (1, 2, 4, 8)] + [(d, c) for d in (8, 16) for c in (2, 4, 6)])
@pytest.mark.parametrize("interlaced", [0, 1])
def test_png_of_every_kind(depth, colours, interlaced):
    rng = np.random.default_rng(depth * 10 + colours)
    channels = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}[colours]
    for width, height in ((1, 1), (3, 2), (8, 8), (13, 11)):
        pixels = rng.integers(0, 2**depth, (height, width, channels))
        palette, alphas = rng.integers(0, 256, (2**min(depth, 8), 3), dtype=np.uint8), rng.integers(0, 256, 2, dtype=np.uint8)
        more = [(b"PLTE", palette.tobytes()), (b"tRNS", alphas.tobytes())] if colours == 3 else []
        if colours in (0, 2):
            more = [(b"tRNS", pixels[0, 0].astype(">u2").tobytes())]
        got = images.decode_png(png_of(pixels, depth, colours, interlaced, *more))
        for y in range(height):
            for x in range(width):
                v = [int(c) for c in pixels[y, x]]
                as_byte = [c // 256 if depth == 16 else c * 255 // (2**depth - 1) for c in v]
                want = {
                    0: lambda v=v, b=as_byte: [b[0]] * 3 + [0 if v == list(pixels[0, 0]) else 255], 2: lambda v=v, b=as_byte: b + [0 if v == list(pixels[0, 0]) else 255],
                    3: lambda v=v: [*palette[v[0]], alphas[v[0]] if v[0] < 2 else 255], 4: lambda b=as_byte: [b[0]] * 3 + [b[1]], 6: lambda b=as_byte: b,
                }[colours]()
                assert list(got[y, x]) == want


def test_png_as_another_decoder_reads_it(spark, tmp_path):
    rng = np.random.default_rng(4)
    palette = rng.integers(0, 256, (16, 3), dtype=np.uint8)
    (tmp_path / "a.png").write_bytes(png_of(rng.integers(0, 16, (9, 14, 1)), 4, 3, 1, (b"PLTE", palette.tobytes())))
    (tmp_path / "b.png").write_bytes(png_of(rng.integers(0, 256, (10, 9, 3)), 8, 2, 1))
    ours = {r["path"][-5:]: r for r in images.read_images(spark, str(tmp_path)).collect()}
    for r in spark.read.format("image").load(str(tmp_path)).select("image.*").collect():
        mine = ours[r["origin"][-5:]]
        theirs = np.frombuffer(r["data"], np.uint8).reshape(r["height"], r["width"], r["nChannels"])[:, :, 2::-1]
        assert (np.frombuffer(mine["data"], np.uint8).reshape(r["height"], r["width"], 4)[:, :, :3] == theirs).all()
    import zlib

    for bad in (b"", images._SIGNATURE, png_of(np.zeros((2, 2, 1)), 8, 3, 0), png_of(np.full((2, 2, 1), 3), 8, 3, 0, (b"PLTE", b"abc")), png_of(np.zeros((2, 2, 3)), 8, 2, 0)[:40]):
        with pytest.raises((ValueError, zlib.error)):
            images.decode_png(bad)


def test_sheets_are_read_back(spark):
    from loomgrid.plans import sheets as P

    rows = {r["vec_id"]: r for r in P.q_sheet_reading(spark, "/root/testdata/sf0.001").collect()}
    assert len(rows) == spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").count()
    for v, r in rows.items():
        torn = v % 40 == 39
        assert (r["status"], r["cells"]) == (("no corners", 0) if torn else ("read", 3))
        assert r["sheet"] == (None if torn else v % 8 or None)
    read = [r for r in rows.values() if r["cells"]]
    assert sum(r["ok"] for r in read) >= 0.97 * sum(r["cells"] for r in read)


def test_images_are_handed_on_a_few_at_a_time(spark, monkeypatch):
    """Tables of small rows fill a batch with thousands; the images made of them stay within a bound."""
    import pandas as pd

    from loomgrid.operators import scanning as C
    from loomgrid.plans import sheets as P

    runs = []
    whole = type(spark.range(0)).mapInPandas
    monkeypatch.setattr(type(spark.range(0)), "mapInPandas", lambda self, f, *a, **b: runs.append(f) or whole(self, f, *a, **b))
    photos, _ = P.photographs(spark, "/root/testdata/sf0.001")
    C.straightened(photos, P.LAYOUT)
    draw, straighten = runs
    vectors = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").select("vec_id", "embedding").toPandas().head(300)
    drawn = list(draw(iter([vectors])))
    straight = list(straighten(iter([pd.concat(drawn)])))
    for parts in (drawn, straight):
        assert [v for p in parts for v in p["id"]] == vectors["vec_id"].tolist()
        assert max(sum(8 * len(g) for g in p["grey"] if g is not None) for p in parts) <= 8 << 20


def test_parts_of_scanning(spark):
    from loomgrid.operators import scanning as C
    from loomgrid.plans import sheets as P

    rng = np.random.default_rng(5)
    for _ in range(5):
        grey = rng.integers(0, 256, (9, 11)).astype(float)
        flat = [int(v) for v in grey.ravel()]

        def between(t, flat=flat):
            low, high = [v for v in flat if v <= t], [v for v in flat if v > t]
            return len(low) * len(high) * (sum(low) / len(low) - sum(high) / len(high)) ** 2 if low and high else 0

        assert between(C.otsu_cut(grey)) == pytest.approx(max(map(between, range(256))))
        near = lambda y, x, grey=grey: grey[max(0, y - 2) : y + 3, max(0, x - 2) : x + 3].mean()
        level = np.array([[np.floor(min(255, max(0, grey[y, x] - near(y, x) + 255))) for x in range(11)] for y in range(9)])
        assert (C.levelled_ink(grey, 2) == (level <= C.otsu_cut(level))).all()
        mask = rng.integers(0, 2, (8, 8))
        assert C.packed(mask > 0) & (2**64 - 1) == int("".join(map(str, mask.ravel())), 2)
    assert C.otsu_cut(np.full((3, 3), 7.0)) == -1 and not C.squared(C.levelled_ink(np.full((3, 3), 7.0), 1), 8).any()
    # corners found on a skewed page lie where the skew puts them, however the page is turned
    page = P.draw(1, np.zeros(64), {})
    marks = np.array(P.LAYOUT.marks) + P.AROUND
    assert np.abs(C.corner_marks(page) - marks).max() <= 1
    upside = C.corner_marks(page[::-1, ::-1])
    assert np.abs(upside - (np.array(page.shape)[::-1] - 1 - marks)).max() <= 1
    bad = [(1, 4, [1.0] * 16), (2, 4, [1.0] * 15), (3, 0, [1.0]), (4, 4, []), (5, 4, None), (6, None, [1.0]), (7, 2, [1.0, float("nan")] * 2), (None, 3, None)]
    captures = spark.createDataFrame(bad, "id long, width int, grey array<double>")
    sheets = C.straightened(captures, P.LAYOUT).withColumn("sheet", C.sheet_number(F.col("grey"), P.LAYOUT))
    assert all(r["grey"] is None and r["reason"] and r["sheet"] is None for r in sheets.collect())
    cells = C.cell_bits(C.with_cells(sheets, P.manifests(spark)), P.LAYOUT, 1, 3).collect()
    assert len(cells) == len(bad) and all(c["index"] is None and c["reason"] for c in cells)
    # a cell that leaves the sheet, and a number that no manifest has
    size = P.LAYOUT.width * P.LAYOUT.height
    one = spark.createDataFrame([(1, [255.0] * size, 9, None), (2, [255.0] * size, 3, None)], "id long, grey array<double>, sheet int, reason string")
    only = spark.createDataFrame([(3, [(0, 120, 90, 20, 20, "x"), (1, 900, 0, 5, 5, "y")])], "sheet int, cells array<struct<index: int, x: int, y: int, w: int, h: int, text: string>>")
    got = sorted((r["id"], r["index"], r["bits"]) for r in C.cell_bits(C.with_cells(one, only), P.LAYOUT, 1, 3).collect() if r["index"] is not None)
    assert got == [(2, 0, 0), (2, 1, 0)]
    assert C.cell_bits(C.with_cells(one.limit(0), only), P.LAYOUT, 1, 3).count() == 0


def test_words_that_cover_letters(spark):
    from loomgrid.operators import sampling as S

    def plain(picked, pool, letters):
        picked = list(picked)
        for c in letters:
            found = [w for w in pool if c in w and w not in picked]
            if any(c in w for w in picked) or not found:
                continue
            free = [i for i, w in enumerate(picked) if len(w) == len(found[0]) and not set(w) & set(letters)]
            picked[free[0] if free else -1] = found[0]
        return picked

    rng = np.random.default_rng(2)
    for _ in range(8):
        pool = list(dict.fromkeys("".join(rng.choice(list("aeioutsnqzx"), rng.integers(2, 5))) for _ in range(40)))
        picked, letters = [w for w in pool if not set(w) & set("qz")][:6], "qzxk"
        pairs = [(c, next((w for w in pool if c in w), None)) for c in letters]
        df = spark.createDataFrame([(picked, pairs)], "p array<string>, c array<struct<letter: string, word: string>>")
        assert df.select(S.cover_letters(F.col("p"), F.col("c"), letters)).first()[0] == plain(picked, pool, letters)


def test_cached_table_and_sinks(spark, tmp_path):
    calls = []
    build = lambda: calls.append(1) or spark.range(5)
    for version in (1, 1, 2):
        assert records.cached_table(spark, str(tmp_path / "t"), version, build).count() == 5
    assert len(calls) == 2
    df = spark.createDataFrame([("a", 1), ("b", None)], "k string, n int")
    records.write_by_class(df, str(tmp_path / "j"), "k")
    assert sorted(p.name for p in (tmp_path / "j").glob("k=*")) == ["k=a", "k=b"]
    assert [r["line"] for r in records.report_lines(df, "T").collect()] == ["# T", "", "| k | n |", "|---|---|", "| a | 1 |", "| b |  |"]
    box = spark.createDataFrame([({"x1": 1, "yMin": 2, "x2": 3, "yMax": 4},)], "b struct<xMin:int,x1:int,yMin:int,y1:int,xMax:int,x2:int,yMax:int,y2:int>")
    assert tuple(box.select(records.either_box(F.col("b")).alias("o")).first()["o"]) == (1, 2, 3, 4)


def test_nearest_and_random_ties(spark):
    r = random.Random(0)
    items = spark.createDataFrame([(i, [float(r.randrange(3)) for _ in range(4)]) for i in range(30)], "i int, v array<double>")
    t = items.where("i < 6").select(F.col("i").alias("t"), F.col("v").alias("tv"))
    got = {x["i"]: x["t"] for x in M.nearest(items, t, M.squared_l2(F.col("v"), F.col("tv")), 1, "i", "t").collect()}
    data = {x["i"]: x["v"] for x in items.collect()}
    for i, v in data.items():
        assert got[i] == min(range(6), key=lambda j: (sum((a - b) ** 2 for a, b in zip(v, data[j], strict=True)), j))


def test_nearest_in_pool_meets_the_whole_pool(spark):
    rng = random.Random(4)
    rows = [(i, i % 3, [float(rng.randrange(4)) for _ in range(3)]) for i in range(120)]
    items = spark.createDataFrame(rows, "vec_id long, label int, v array<float>")
    want = set()
    for i, pool, v in rows:
        others = sorted((sum((x - y) ** 2 for x, y in zip(v, w)), -j) for j, p, w in rows if p == pool and j != i)
        want |= {(i, -j, rank + 1, d) for rank, (d, j) in enumerate(others[:3])}
    for block in (7, 500):
        got = M.nearest_in_pool(items, "vec_id", "label", "v", 3, block).collect()
        assert {(r["vec_id"], r["ref_id"], r["rank"], r["distance"]) for r in got} == want


def test_pool_crossmatch_of_odd_vectors_is_as_sql(spark, tmp_path):
    """Lacking and non-finite components, vectors too short and too long, copies, near copies, halves in the last digit."""
    import duckdb

    from loomgrid.plans import matching as P
    from loomgrid.plans.registry import ORACLE_SQL

    rng = random.Random(7)
    some = lambda n=64: [rng.uniform(-1, 1) for _ in range(n)]
    base, nan, inf = some(), float("nan"), float("inf")
    vectors = [None, None, [], some(3), some(70), [None] * 64, [None] + some(63), some(63) + [None], [nan] + some(63), [nan] * 64, [inf] + some(63), [-inf] + some(63), [1e30] * 64]
    vectors += [base] * 9 + [[x + rng.uniform(0, 3e-5) for x in base] for _ in range(9)] + [[x * 1e6 for x in some()] for _ in range(5)]
    vectors += [[rng.randrange(40) / 32 for _ in range(64)] for _ in range(15)] + [some() for _ in range(20)]
    rows = [(i, i // 3 % 2 if pool is None else pool, v) for pool in (None, 5) for i, v in enumerate(vectors, 0 if pool is None else 500)]
    rows += [(1000, 7, base), (1001, None, base), (None, 5, base), (1002, 8, base), (1003, 8, None)]
    spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>").coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    want = con.execute(f"SELECT vec_id, label, ref_id, rank, distance FROM ({ORACLE_SQL['q_pool_crossmatch']})").fetchall()
    got = [tuple(r) for r in P.q_pool_crossmatch(spark, str(tmp_path)).collect()]
    assert sorted(map(str, got)) == sorted(map(str, want))


def test_nearest_of_large_blocks(spark):
    """Two blocks of some thousand vectors, many alike, against a plain matrix of all distances."""
    import pyarrow as pa

    rng = np.random.default_rng(3)
    vectors = rng.normal(size=(2500, 16)).round(1)
    vectors[::5] = vectors[0]
    ids = rng.permutation(2500)
    for refs in (slice(0, 2500), slice(1200, 2500), slice(5, 7)):
        lists = [pa.array(list(v)) for v in (vectors[:1500], vectors[refs])]
        item, ref, far, none = M.nearest_of_block(ids[:1500], lists[0], ids[refs], lists[1], 3)
        plain = sum((vectors[:1500, None, d] - vectors[None, refs, d]) ** 2 for d in range(16)).round(9)
        plain[ids[:1500, None] == ids[refs]] = np.inf
        order = np.argsort(plain - ids[refs] * 1e-13, axis=1, kind="stable")
        want = [(i, ids[refs][j], plain[i, j]) for i in range(1500) for j in order[i, :3] if j < plain.shape[1] and plain[i, j] < np.inf]
        assert not none.any() and sorted(zip(item, ref)) == sorted((i, r) for i, r, _ in want)
        assert sorted(far) == pytest.approx(sorted(d for _, _, d in want))


def test_jpeg_is_decoded_and_turned(spark, tmp_path):
    """A JPEG written by the Java image library, as it is and with an orientation tag put in."""
    jvm = spark._jvm
    picture = jvm.java.awt.image.BufferedImage(16, 8, jvm.java.awt.image.BufferedImage.TYPE_INT_RGB)
    for x in range(16):
        for y in range(8):
            picture.setRGB(x, y, 0xE01010 if x < 8 else 0x1010E0)
    jvm.javax.imageio.ImageIO.write(picture, "jpg", jvm.java.io.File(f"{tmp_path}/a.jpg"))
    plain = (tmp_path / "a.jpg").read_bytes()
    for tag in (3, 6):
        exif = b"Exif\0\0" + b"MM\0*" + struct.pack(">IHHHIHHI", 8, 1, 0x0112, 3, 1, tag, 0, 0)
        (tmp_path / f"t{tag}.jpg").write_bytes(plain[:2] + b"\xff\xe1" + struct.pack(">H", len(exif) + 2) + exif + plain[2:])
    (tmp_path / "broken.jpg").write_bytes(plain[:3] + b"nothing")
    (tmp_path / "b.png").write_bytes(images.encode_png(np.full((2, 3, 4), 7, dtype=np.uint8)))
    rows = {r["path"].rpartition("/")[2]: r for r in images.read_images(spark, str(tmp_path)).collect()}
    assert {n for n, r in rows.items() if r["ok"]} == {"a.jpg", "t3.jpg", "t6.jpg", "b.png"} and rows["broken.jpg"]["reason"]
    shown = {n: np.frombuffer(r["data"], dtype=np.uint8).reshape(r["height"], r["width"], 4) for n, r in rows.items() if r["ok"]}
    assert shown["a.jpg"].shape == (8, 16, 4) and shown["t6.jpg"].shape == (16, 8, 4)
    red = lambda p: p[0] > 180 and p[2] < 80
    assert red(shown["a.jpg"][4, 1]) and not red(shown["a.jpg"][4, 14]) and red(shown["t3.jpg"][4, 14]) and red(shown["t6.jpg"][1, 4])


@pytest.mark.parametrize("orientation", range(1, 9))
def test_orientation_of_pixels_equals_that_of_masks(spark, orientation):
    mask = np.arange(6).reshape(2, 3)
    got = images.oriented(mask[:, :, None], orientation)[:, :, 0]
    want = one(spark, mask.ravel().tolist(), R.reoriented(F.col("m"), 3, 2, orientation).alias("r"))["r"]
    assert got.ravel().tolist() == want


def test_dataset_sheets_and_svg(spark, tmp_path):
    samples = spark.createDataFrame([("c-a", "1.png", bytearray(b"x"), True), ("c-b", "2.png", bytearray(b"y"), False)], "class string, file string, png binary, clean boolean")
    images.write_dataset(samples, f"{tmp_path}/d")
    back = spark.read.parquet(f"{tmp_path}/d/images").collect()
    assert {(r["class"], r["file"], bytes(r["png"])) for r in back} == {("c-a", "1.png", b"x"), ("c-b", "2.png", b"y")}
    assert {(r["class"], r["file"], r["clean"]) for r in spark.read.json(f"{tmp_path}/d/manifest").collect()} == {("c-a", "1.png", True), ("c-b", "2.png", False)}
    cells = spark.createDataFrame([(1, 1, "b"), (1, 0, "a"), (2, 0, "c")], "sheetId int, index int, root string")
    images.write_sheets(cells, f"{tmp_path}/s")
    sheets = {r["sheetId"]: [c["root"] for c in r["cells"]] for r in spark.read.json(f"{tmp_path}/s").collect()}
    assert sheets == {1: ["a", "b"], 2: ["c"]}
    svg = spark.range(1).select(images.svg_wrapper(F.lit("M0 0L1 1"), *(F.lit(v) for v in (-2, -5, 10, 20))).alias("s")).first()["s"]
    assert 'viewBox="-2 -20 12 25"' in svg and "scale(1 -1)" in svg and "M0 0L1 1" in svg


def test_homography_and_warp(spark):
    sf = "/root/testdata/sf0.001"
    rows = {r["vec_id"]: np.array(r["embedding"], dtype=float) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()}
    centre = {r["vec_id"]: (r["px"], r["py"]) for r in raster.q_homography(spark, sf).collect()}
    straight = {r["vec_id"]: (r["mean"], r["low"], r["high"]) for r in raster.q_warp(spark, sf).collect()}
    assert centre.keys() == straight.keys() == rows.keys()
    for vec_id, e in list(rows.items())[:60]:
        to = raster.CORNERS + e[:8].reshape(4, 2)
        # the map from the null space of the usual eight by nine system
        system = []
        for (x, y), (u, v) in zip(raster.CORNERS, to):
            system += [[x, y, 1, 0, 0, 0, -u * x, -u * y, -u], [0, 0, 0, x, y, 1, -v * x, -v * y, -v]]
        h = np.linalg.svd(np.array(system))[2][-1].reshape(3, 3)
        place = lambda x, y: (h @ (x, y, 1))[:2] / (h @ (x, y, 1))[2]
        assert np.allclose(centre[vec_id], place(3.5, 3.5), atol=1e-5)
        grey, out = (128 + 100 * e).reshape(8, 8), []
        for y in range(8):
            for x in range(8):
                px, py = place(x, y)
                left, upper = math.floor(px), math.floor(py)
                value = lambda a, b: grey[b, a] if 0 <= a < 8 and 0 <= b < 8 else 255.0
                fx, fy = px - left, py - upper
                out.append((value(left, upper) * (1 - fx) + value(left + 1, upper) * fx) * (1 - fy) + (value(left, upper + 1) * (1 - fx) + value(left + 1, upper + 1) * fx) * fy)
        assert abs(straight[vec_id][0] - np.mean(out)) < 0.1


def test_classify_regions_equals_plain_code(spark):
    sf = "/root/testdata/sf0.001"
    rows = {r["vec_id"]: r for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()}
    shown = {}
    for vec_id, r in rows.items():
        ink = {(i % 8, i // 8) for i, v in enumerate(r["embedding"]) if v > 0.12}
        parts, order = [], sorted(ink, key=lambda p: (p[1], p[0]))
        left = set(ink)
        for p in order:
            if p in left:
                part, todo = set(), [p]
                left.discard(p)
                while todo:
                    x, y = todo.pop()
                    part.add((x, y))
                    near = {(x + a, y + b) for a in (-1, 0, 1) for b in (-1, 0, 1)} & left
                    left -= near
                    todo += near
                if len(part) >= 3:
                    parts.append(part)
        if not parts:
            continue
        base = max(parts, key=len)  # the first of the largest
        x0, y0 = min(x for x, _ in base), min(y for _, y in base)
        w, h = max(x for x, _ in base) - x0 + 1, max(y for _, y in base) - y0 + 1
        side, cells = max(w, h), set()
        for t in range(64):
            a, b = math.trunc(t % 8 * side / 8 - (side - w) // 2), math.trunc(t // 8 * side / 8 - (side - h) // 2)
            if 0 <= a < w and 0 <= b < h and (x0 + a, y0 + b) in ink:
                cells.add((t % 8, t // 8))
        shown[vec_id] = cells
    octile = lambda p, q: max(abs(p[0] - q[0]), abs(p[1] - q[1])) + (2**0.5 - 1) * min(abs(p[0] - q[0]), abs(p[1] - q[1]))
    mean = lambda a, b: sum(min(octile(p, q) for q in b) for p in a) / len(a)
    first = {}
    for vec_id in sorted(shown):
        first.setdefault(rows[vec_id]["label"], vec_id)
    got = {r["vec_id"]: r for r in decoders.q_classify_regions(spark, sf).collect()}
    assert got.keys() == shown.keys()
    for vec_id in sorted(shown)[:80]:
        scores = {t: round(1 / (1 + (mean(shown[vec_id], shown[t]) + mean(shown[t], shown[vec_id])) / 2), 9) for t in first.values()}
        best = min(scores, key=lambda t: (-scores[t], t))
        assert got[vec_id]["t_id"] == best and abs(got[vec_id]["score"] - scores[best]) < 1e-6


def test_damaged_cache_is_built_anew(spark, tmp_path):
    build = lambda: spark.range(5).coalesce(1)
    records.cached_table(spark, str(tmp_path), 1, build)
    for part in (tmp_path / "version=1").glob("part-*"):
        part.write_bytes(b"damaged")
    for check in (tmp_path / "version=1").glob(".part-*.crc"):
        check.unlink()
    assert records.cached_table(spark, str(tmp_path), 1, build).count() == 5


def test_lexicon_drops_empty_roots(spark):
    texts = ['[{"cr": "b"}, {"cr": ""}, {"cr": null}, {"cr": "c", "x": 1}]', '{"p": {"cr": "d"}, "q": {"x": 2}}']
    for text, want in zip(texts, (["b", "c"], ["d"]), strict=True):
        df = spark.createDataFrame([(text,)], "t string")
        assert [r["cr"] for r in records.lexicon(df, "t").orderBy("ord").collect()] == want


def test_heads_learn_are_saved_and_loaded(spark, tmp_path):
    rng = np.random.default_rng(5)
    rows = [(i, rng.normal(0, 0.2, 12).tolist()) for i in range(400)]
    rows = [(i, v, int(v[0] + v[1] > 0), "ab"[v[2] > v[3]]) for i, v in rows]
    df = spark.createDataFrame(rows, "id long, g array<double>, x int, y string")
    model = heads.train_heads(heads.training_sample(df.where("id < 300"), "id", "g", ["x", "y"]), "id", ["x", "y"])
    heads.save_heads(spark, model, f"{tmp_path}/m")
    got = {r["id"]: r for r in heads.predict_heads(df.where("id >= 300"), "id", "g", heads.load_heads(spark, f"{tmp_path}/m")).collect()}
    assert len(got) == 100 and all(0.5 <= r["x_confidence"] <= 1 for r in got.values())
    assert sum(got[i]["x"] == str(x) for i, _, x, _ in rows[300:]) > 85 and sum(got[i]["y"] == y for i, _, _, y in rows[300:]) > 85
    assert heads.predict_heads(df.limit(0), "id", "g", model).count() == 0
