"""Codes and files by themselves and by what other readers say of them."""

import random
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions.hashing import xx32_of
from tessera.operators import blocks, containers, entropy, raster, resampling
from tessera.sources import gifs, jpegs, rasters, tiffs


def noise(seed, h, w, n, colors=256):
    return np.random.default_rng(seed).integers(0, colors, (h, w, n)).astype(np.uint8)


# ---- prefix codes ----


def test_lengths_are_optimal_and_prefix_free():
    rnd = random.Random(2)
    for _ in range(200):
        n = np.array([rnd.choice([1, 1, 2, 3, 5, 100, 10_000]) for _ in range(rnd.randrange(1, 60))])
        length = entropy.code_lengths(n)
        heap, cost = sorted(n.tolist()), 0
        while len(heap) > 1:
            both = heap[0] + heap[1]
            cost, heap = cost + both, sorted([*heap[2:], both])
        assert (n * length).sum() == cost
        assert len(n) == 1 or (0.5**length).sum() == 1


def test_streams_come_back(spark):
    fibonacci = [1, 1]
    while len(fibonacci) < 24:  # codes of up to 23 bits
        fibonacci.append(fibonacci[-1] + fibonacci[-2])
    texts = [b"", b"a", b"aaaa", b"ab", bytes(range(256)) * 3, b"".join(bytes([65 + k]) * n for k, n in enumerate(fibonacci)), "Ünïcödé 漢字".encode() * 50, None]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, content binary")
    table = entropy.code_table(df, "id")
    assert table.agg(F.max("length")).first()[0] == 23
    made = entropy.encode(df, table, "id")
    back = {r.id: bytes(r.content) for r in entropy.decode(made, table, "id").collect()}
    assert back == {i: t or b"" for i, t in enumerate(texts)}
    assert {r.id: r.bits for r in made.collect()}[5] == sum(int(r.n * r.length) for r in table.where("id = 5").collect())


def test_hash_has_its_public_values():
    assert (xx32_of(b""), xx32_of(b"", 1), xx32_of(b"a"), xx32_of(b"abc")) == (0x02CC5D05, 0x0B2CB792, 0x550D7456, 0x32D153FF)
    assert xx32_of(b"Nobody inspects the spammish repetition") == 0xE2293B2F


# ---- GIF ----


@pytest.mark.parametrize("colors", [1, 2, 3, 16, 200, 256])
def test_gif_codes_come_back(colors):
    for seed, (h, w) in enumerate([(1, 1), (3, 5), (40, 60), (150, 130)]):
        index = noise(seed, h, w, 1, colors)[:, :, 0]
        palette = noise(9, colors, 1, 3)[:, 0]
        got = list(gifs.each_frame(gifs.gif_file([(index, 0)], palette)))
        assert len(got) == 1 and (got[0][0][:, :, :3] == palette[index]).all()


def test_gif_is_shorter_than_stored():
    smooth = (np.add.outer(np.arange(100), np.arange(120)) // 8).astype(np.uint8)
    for index in (smooth, np.zeros((50, 50), np.uint8), noise(1, 60, 60, 1, 16)[:, :, 0]):
        stored = 9 * index.size / 8
        assert len(gifs.gif_file([(index, 0)], np.zeros((32, 3), np.uint8))) - 13 - 96 < stored


def test_animation_merges_equal_frames(spark):
    """A thousand frames, of which each repeats the one before now and then."""
    rnd = random.Random(4)
    frames, told = [], []
    for k in range(1000):
        if not k or rnd.random() < 0.6:
            data = [rnd.randrange(200) for _ in range(12)]
            told.append([data, 0])
        frames.append((7, k, k % 5 + 1, 4, list(told[-1][0])))
        told[-1][1] += k % 5 + 1
    df = spark.createDataFrame([*frames, (8, 0, 3, 2, [5, 5, 5, 5])], "file_id long, seq long, delay long, w long, data array<long>")
    made = gifs.write_animations(df)
    assert {r.file_id: r.frames for r in made.collect()} == {7: len(told), 8: 1}
    back, errors = gifs.read_animations(made.select(F.col("file_id").cast("string").alias("path"), "content"))
    got = [(list(r.data), r.delay) for r in back.where("path = '7'").orderBy("seq").collect()]
    assert got == [tuple(t) for t in told] and errors.count() == 0
    bad = spark.createDataFrame([("a", b"GIF89a"), ("b", None), ("c", bytes(made.where("file_id = 7").first().content)[:300])], "path string, content binary")
    assert gifs.read_animations(bad)[1].count() == 3
    many = spark.createDataFrame([(1, 0, 1, 300, list(range(300))), (2, 0, 1, 2, [1, 2]), (2, 1, 1, 1, [1])], df.schema)
    assert [r.content for r in gifs.write_animations(many).collect()] == [None, None]


# ---- TIFF ----


@pytest.mark.parametrize("form", list(tiffs.FORMS))
@pytest.mark.parametrize("channels", [1, 3, 4])
def test_tiff_comes_back(form, channels):
    for seed, (h, w) in enumerate([(1, 1), (7, 3), (30, 41)]):
        x = noise(seed, h, w, channels, 4)
        got = tiffs.read_tiff(tiffs.tiff_bytes(x, form, 100))
        assert (got[:, :, : min(3, channels)] == x[:, :, :3][:, :, : min(3, channels)]).all()
        assert (got[:, :, 3] == (x[:, :, 3] if channels == 4 else 255)).all()


def test_run_lengths():
    rnd = random.Random(6)
    for _ in range(300):
        row = b"".join(bytes([rnd.randrange(4)]) * rnd.choice([1, 1, 2, 3, 127, 128, 129, 300]) for _ in range(rnd.randrange(12)))
        assert tiffs.unpacked_bits(tiffs.packed_bits(row), len(row)) == row
    assert len(tiffs.packed_bits(b"\0" * 1000)) == 16


def big_endian(h, w):
    """A gray TIFF as another writer may make it: big-endian, white is zero, one strip."""
    body = bytes(range(h * w))
    tags = [(256, 3, w), (257, 3, h), (258, 3, 8), (259, 3, 1), (262, 3, 0), (273, 4, 8), (278, 3, h), (279, 4, h * w)]
    entries = b"".join(struct.pack(">HHI", t, k, 1) + (struct.pack(">HH", v, 0) if k == 3 else struct.pack(">I", v)) for t, k, v in tags)
    return struct.pack(">2sHI", b"MM", 42, 8 + len(body)) + body + struct.pack(">H", len(tags)) + entries + struct.pack(">I", 0)


def test_tiff_of_others_and_bad_ones(spark):
    assert tiffs.read_tiff(big_endian(4, 5))[:, :, 0].reshape(-1).tolist() == [255 - k for k in range(20)]
    data = tiffs.tiff_bytes(noise(1, 5, 6, 3))
    loop = bytearray(big_endian(2, 2))
    loop[-4:] = loop[4:8]
    files = spark.createDataFrame([("a", data), ("b", data[:40]), ("c", b"II*"), ("d", None), ("e", bytes(loop)), ("f", b"")], "path string, content binary")
    rows = tiffs.read_directories(files).collect()
    assert {r.path for r in rows if r.error} == {"b", "c", "d", "f"}
    assert len([r for r in rows if r.path == "e"]) == 8
    with pytest.raises(rasters.UNREADABLE):
        tiffs.read_tiff(data[:60])


# ---- PNG ----


@pytest.mark.parametrize("interlaced", [False, True])
@pytest.mark.parametrize(("depth", "channels"), [(1, 1), (2, 1), (4, 1), (8, 1), (8, 3), (8, 4), (16, 1), (16, 3), (16, 4)])
def test_png_of_every_depth(depth, channels, interlaced):
    for seed, (h, w) in enumerate([(1, 1), (1, 9), (9, 1), (13, 11)]):
        x = np.random.default_rng(seed).integers(0, 1 << depth, (h, w, channels))
        for name in rasters.FILTERS:
            got = rasters.read_png(rasters.png_bytes(x, name, None, depth, interlaced))
            want = x >> 8 if depth == 16 else x * (255 // ((1 << depth) - 1)) if depth < 8 else x
            assert (got[:, :, :3] == (want[:, :, :3] if channels >= 3 else want)).all() and (got[:, :, 3] == (want[:, :, 3] if channels == 4 else 255)).all()


def test_png_palette_with_clear_entries():
    palette = noise(1, 5, 1, 3)[:, 0]
    data = rasters.png_bytes(np.arange(5).reshape(1, 5, 1), "none", palette, 4, True)
    at = data.index(b"IDAT") - 4
    clear = struct.pack(">I", 2) + b"tRNS" + bytes([0, 128])
    got = rasters.read_png(data[:at] + clear + struct.pack(">I", zlib.crc32(clear[4:])) + data[at:])
    assert (got[0, :, :3] == palette).all() and got[0, :, 3].tolist() == [0, 128, 255, 255, 255]
    for bad in (rasters.png_bytes(noise(1, 2, 2, 3))[:50], b"\x89PNG\r\n\x1a\n"):
        with pytest.raises(rasters.UNREADABLE):
            rasters.read_png(bad)
    with pytest.raises(ValueError):
        rasters.png_bytes(noise(1, 2, 2, 3), "none", None, 4)


# ---- blocks, sizes, palettes ----


def image(spark, x, img_id=0):
    return spark.createDataFrame([(img_id, y, c, *map(int, x[y, c]), 255) for y in range(x.shape[0]) for c in range(x.shape[1])], "img_id long, y long, x long, r long, g long, b long, a long")


def test_coefficients_match_the_transform(spark):
    x = noise(3, 11, 9, 3)
    got = {(r.channel, r.by, r.bx): np.array(r.f).reshape(8, 8) for r in blocks.coefficients(blocks.planes(image(spark, x))).collect()}
    assert len(got) == 3 * 2 * 2
    c = np.array(blocks.basis())
    assert np.allclose(c @ c.T, np.eye(8))
    plane = {(r.channel, r.y, r.x): r.value for r in blocks.planes(image(spark, x)).collect()}
    for (channel, by, bx), f in got.items():
        cell = np.array([[plane[channel, min(10, by * 8 + v), min(8, bx * 8 + u)] - 128 for u in range(8)] for v in range(8)])
        assert np.allclose(f, c @ cell @ c.T)


def test_zigzag_and_divisors():
    assert blocks.zigzag()[:10] == [(0, 0), (0, 1), (1, 0), (2, 0), (1, 1), (0, 2), (0, 3), (1, 2), (2, 1), (3, 0)] and len(set(blocks.zigzag())) == 64
    assert blocks.divisors(50, blocks.LUMINANCE) == list(blocks.LUMINANCE) and set(blocks.divisors(100, blocks.LUMINANCE)) == {1}
    assert max(blocks.divisors(1, blocks.LUMINANCE)) == 255


def test_lower_quality_takes_fewer_bits(spark):
    p = image(spark, noise(5, 24, 24, 3))
    size = {q: {r.strategy: r.len for r in blocks.jpeg_candidates(p, q).collect()} for q in (10, 60, 100)}
    assert set(size[10]) == {"jpeg-color-15", "jpeg-gray-15"} and set(size[100]) == {"jpeg-color-85"}
    assert size[10]["jpeg-gray-15"] < size[10]["jpeg-color-15"] < size[60]["jpeg-color-50"] < size[100]["jpeg-color-85"]
    flat = {r.strategy: r.len for r in blocks.jpeg_candidates(image(spark, np.full((8, 8, 3), 90)), 60).collect()}
    assert flat["jpeg-gray-50"] <= 3


def test_prepared_images_have_few_colours(spark):
    p = image(spark, noise(6, 20, 20, 3))
    assert blocks.prepared(p, 30, 100).select("r", "g", "b").distinct().count() <= 64
    assert blocks.prepared(p, 60, 100).select("r", "g", "b").distinct().count() <= 128
    assert blocks.prepared(p, 60).exceptAll(p.select("img_id", "y", "x", "r", "g", "b")).count() == 0


def test_resizing(spark):
    flat = resampling.for_quality(image(spark, np.full((40, 60, 3), 77)), 30)
    assert {(r.r, r.g, r.b) for r in flat.collect()} == {(77, 77, 77)} and flat.count() == 30 * 45
    small = resampling.for_quality(image(spark, noise(1, 5, 9, 3)), 10, strong=True)  # never below eight pixels
    size = small.agg(F.max("x"), F.max("y")).first()
    assert tuple(size) == (7, 3)
    ramp = np.repeat(np.arange(0, 200, 5)[None, :, None], 8, axis=0).repeat(3, axis=2)
    row = [r.r for r in resampling.resize(image(spark, ramp), resampling.sizes(image(spark, ramp)).withColumns({"nw": F.lit(20).cast("long"), "nh": F.lit(8).cast("long")})).where("y = 3").orderBy("x").collect()]
    assert row[1:-1] == [10 * k + 3 if (10 * k + 2.5) % 1 else 10 * k + 2 for k in range(1, 19)]


def test_texts_are_coded_and_read_without_a_shuffle(spark):
    fibonacci = [1, 1]
    while len(fibonacci) < 24:  # codes of more than LOOK bits
        fibonacci.append(fibonacci[-1] + fibonacci[-2])
    texts = [b"", b"a", b"aaaa", bytes(noise(8, 1, 5000, 1).reshape(-1)), b"".join(bytes([k]) * n for k, n in enumerate(fibonacci))]
    df = spark.createDataFrame([(k, bytearray(t)) for k, t in enumerate(texts)], "id long, content binary")
    back = entropy.decoded(entropy.encoded(df.withColumn("table", entropy.code_tables("content")), "id"))
    assert {r.id: (bytes(r.content), r.n) for r in back.collect()} == {k: (t, len(t)) for k, t in enumerate(texts)}
    assert all(len(r.stream) == -(-r.bits // 8) for r in back.collect())
    assert "Exchange" not in back._jdf.queryExecution().executedPlan().toString()


def test_ways_of_a_jpeg_share_one_transform(spark):
    made = blocks.jpeg_candidates(image(spark, noise(9, 20, 27, 3)), 60)
    assert made._jdf.queryExecution().optimizedPlan().toString().count("ArrowEvalPython") == 1
    z = blocks.quantised(blocks.coefficients(blocks.planes(image(spark, noise(9, 20, 27, 3)))), 50).where("channel = 0")
    bits = blocks.scan_bits(blocks.symbols(z)).agg(F.sum("bits")).first()[0]
    assert {r.strategy: r.len for r in made.collect()}["jpeg-gray-50"] == -(-bits // 8)


def test_ladder_deals_pixels_once_and_in_squares(spark):
    p = image(spark, noise(3, 41, 29, 3)).unionByName(image(spark, noise(4, 16, 16, 3)).withColumn("img_id", F.lit(7).cast("long")))
    steps = [("a", 30, False), ("b", 20, True), ("c", 90, True), ("d", 100, False)]
    every = resampling.for_qualities(p, steps)
    rows = {(r.kind, r.img_id, r.y, r.x, r.r, r.g, r.b) for r in every.collect()}
    assert rows == {(r.kind, r.img_id, r.y, r.x, r.r, r.g, r.b) for r in resampling.for_qualities(p, steps, square=5).collect()}
    assert rows == {(name, r.img_id, r.y, r.x, r.r, r.g, r.b) for name, q, strong in steps for r in resampling.for_quality(p, q, strong).collect()}
    plan = every._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1 and plan.count("Join") == 1


def test_resize_skips_missing_pixels_and_shrinks_far(spark):
    x = noise(5, 30, 40, 3)
    p = image(spark, x).where("(x * 7 + y * 3) % 11 > 2")
    size = spark.createDataFrame([(r.img_id, 40, 30, 3, 2) for r in p.select("img_id").distinct().collect()], "img_id long, w long, h long, nw long, nh long")

    def weights(n, m):
        w = 1 - np.abs((np.arange(n) + 0.5)[None] - (np.arange(m) + 0.5)[:, None] * n / m) / max(1, n / m)
        return np.where(w > 1e-12, w, 0)

    there = np.array([[(i * 7 + j * 3) % 11 > 2 for i in range(40)] for j in range(30)], float)
    down, across = weights(30, 2), weights(40, 3)
    tall = np.einsum("oy,yxc->oxc", down, x[..., :3] * there[..., None]) / (down @ there)[..., None]
    want = np.floor(np.round(np.einsum("px,oxc->opc", across / across.sum(axis=1, keepdims=True), tall), 6) + 0.5)
    for square in (512, 7):
        got = {(r.y, r.x): (r.r, r.g, r.b) for r in resampling.resize(p, size, square).collect()}
        assert got == {(o, q): tuple(want[o, q]) for o in range(2) for q in range(3)}


def test_learned_palettes_get_better(spark):
    p = image(spark, noise(7, 30, 30, 3)).unionByName(image(spark, np.zeros((2, 2, 3), int), 1))
    start = raster.median_cut(p, 3).withColumnRenamed("bucket", "idx")
    palettes, errors = raster.learned_palettes(p, start, 5)
    by = [r.error for r in errors.where("img_id = 0").orderBy("round").collect()]
    assert by == sorted(by, reverse=True) and by[-1] < by[0]
    assert [r.error for r in errors.where("img_id = 1").collect()] == [0] * 5
    last = palettes.where("round = 5 and img_id = 0")
    assert last.count() <= 8 and last.agg(F.sum("n")).first()[0] == 900


# ---- JPEG ----


def quantised_planes(x, quality):
    """Quantised blocks of an image by plain numpy: the first plane is brightness."""
    r, g, b = (x[:, :, k].astype(np.int64) for k in range(3))
    yuv = [(77 * r + 150 * g + 29 * b + 128) >> 8, ((-43 * r - 85 * g + 128 * b + 128) >> 8) + 128, ((128 * r - 107 * g - 21 * b + 128) >> 8) + 128]
    out, c, order = [], np.array(blocks.basis()), [v * 8 + u for v, u in blocks.zigzag()]
    for k, plane in enumerate(yuv):
        h, w = plane.shape
        plane = np.pad(np.clip(plane, 0, 255), ((0, -h % 8), (0, -w % 8)), mode="edge") - 128
        cells = plane.reshape(plane.shape[0] // 8, 8, -1, 8).transpose(0, 2, 1, 3).reshape(-1, 8, 8)
        f = (c @ cells @ c.T).reshape(-1, 64) / np.array(blocks.divisors(quality, blocks.CHROMINANCE if k else blocks.LUMINANCE))
        out.append((np.sign(f) * np.floor(np.abs(np.round(f, 6)) + 0.5)).astype(np.int64)[:, order])
    return out


@pytest.mark.parametrize("quality", [1, 30, 50, 90, 100])
def test_jpeg_is_near_what_was_given(quality):
    for h, w in ((1, 1), (8, 8), (17, 23), (40, 31)):
        smooth = np.stack([np.add.outer(np.arange(h) * a, np.arange(w) * b) % 200 for a, b in ((1, 2), (2, 1), (1, 1))], axis=2)
        got = jpegs.read_jpeg(jpegs.jpeg_bytes(quantised_planes(smooth, quality), w, h, quality))
        assert got.shape == (h, w, 4)
        if quality >= 90:
            assert np.abs(got[:, :, :3].astype(int) - smooth).mean() < (4 if quality == 100 else 12)


def test_jpeg_of_noise_and_gray_and_runs():
    x = noise(3, 33, 47, 3)
    planes = quantised_planes(x, 100)
    got = jpegs.read_jpeg(jpegs.jpeg_bytes(planes, 47, 33, 100))
    assert np.abs(got[:, :, :3].astype(int) - x).mean() < 4
    gray = jpegs.read_jpeg(jpegs.jpeg_bytes(planes[:1], 47, 33, 100))
    assert (gray[:, :, 0] == gray[:, :, 2]).all()
    lonely = np.zeros((6, 64), np.int64)
    lonely[1, 63], lonely[2, 40], lonely[3, 17], lonely[4, 0] = 5, -3, 1000, -800
    data = jpegs.jpeg_bytes([lonely], 16, 24, 50)
    again = jpegs.read_jpeg(data)
    assert again.shape == (24, 16, 4) and len(np.unique(again[:8, :8, :3])) == 1
    for bad in (data[:100], b"\xff\xd8\xff", data[:-30], data.replace(b"\xff\xc0", b"\xff\xc2"), b""):
        with pytest.raises(rasters.UNREADABLE):
            jpegs.read_jpeg(bad)


def test_code_lengths_stay_within_sixteen():
    rnd = random.Random(9)
    fibonacci = [1, 1]
    while len(fibonacci) < 40:
        fibonacci.append(fibonacci[-1] + fibonacci[-2])
    for counts in ([dict(enumerate(fibonacci)), {5: 3}, {1: 1, 2: 1}] + [{k: rnd.choice([1, 2, 7, 10**6]) for k in range(rnd.randrange(1, 160))} for _ in range(50)]):
        length = jpegs.limited_lengths(counts)
        assert set(length) == set(counts) and max(length.values()) <= 16
        assert sum(2.0**-n for n in length.values()) <= 1 - 2.0**-16
        codes = jpegs.canonical(length)
        assert all(c != (1 << n) - 1 for c, n in codes.values())
        as_bits = sorted(f"{c:0{n}b}" for c, n in codes.values())
        assert not any(b.startswith(a) for a, b in zip(as_bits, as_bits[1:], strict=False))


def test_jpeg_with_fewer_colours_and_restarts():
    """A file as other writers make it: colours at half the size, restarts after each group of blocks."""
    y, u, v = np.zeros((4, 64), np.int64), np.zeros((1, 64), np.int64), np.zeros((1, 64), np.int64)
    y[:, 0], u[0, 0], v[0, 0] = [10, 20, 30, 40], 8, -8
    # In order: four blocks of brightness, then one of each colour; differences start anew after a restart, here there is one group only.
    plain = jpegs.jpeg_bytes([y], 16, 16, 50)
    assert jpegs.read_jpeg(plain)[0, 0, 0] == 128 + 10 * 16 // 8
    said = [(0, d) for d in (10, 10, 10, 10)] + [(1, 8), (2, -8)]
    bits = ""
    for c, d in said:
        n = abs(d).bit_length()
        bits += f"{n - 4:01b}" + f"{d if d > 0 else d + (1 << n) - 1:0{n}b}" + "0"
    bits += "1" * (-len(bits) % 8)
    scan = bytes(int(bits[i : i + 8], 2) for i in range(0, len(bits), 8)).replace(b"\xff", b"\xff\x00")
    seg = lambda m, d: struct.pack(">BBH", 0xFF, m, len(d) + 2) + d
    dqt = seg(0xDB, b"\0" + bytes([16] + [1] * 63))
    first = seg(0xC4, bytes([0x00, 0, 2, *[0] * 14])[:1] + bytes([1, 0, *[0] * 14]) + bytes([4]))
    others = seg(0xC4, b"\x10" + bytes([1, *[0] * 15]) + b"\0")
    frame = seg(0xC0, struct.pack(">BHHB", 8, 16, 16, 3) + bytes([1, 0x22, 0, 2, 0x11, 0, 3, 0x11, 0]))
    start = seg(0xDA, bytes([3, 1, 0, 2, 0, 3, 0, 0, 63, 0]))
    got = jpegs.read_jpeg(b"\xff\xd8" + dqt + frame + first + others + seg(0xDD, b"\0\x01") + start + scan + b"\xff\xd9")
    assert got.shape == (16, 16, 4)
    want = [128 + 2 * k for k in (10, 20, 30, 40)]
    tone = lambda y: [y + (359 * -16 + 128 >> 8), y - (88 * 16 + 183 * -16 + 128 >> 8), y + (454 * 16 + 128 >> 8)]
    for k, (r, c) in enumerate(((0, 0), (0, 8), (8, 0), (8, 8))):
        assert (got[r : r + 8, c : c + 8, :3] == np.clip(tone(want[k]), 0, 255)).all()


# ---- containers ----


def test_segments_and_chunks_that_the_rules_keep(spark):
    data = jpegs.jpeg_bytes(quantised_planes(noise(2, 9, 9, 3), 50), 9, 9, 50)
    segment = lambda m, d: struct.pack(">BBH", 0xFF, m, len(d) + 2) + d
    long = data[:2] + segment(0xE1, b"Exif\0\0") + segment(0xFE, b"") + segment(0xE2, b"\xff\xd9") + data[2:]
    assert containers.kept_segments(long, 50) == data == containers.kept_segments(long[:-2], 50)
    assert containers.kept_segments(long, 100) == long and containers.kept_segments(long, 85) == data[:2] + segment(0xE1, b"Exif\0\0") + data[2:]
    chunk = lambda t, d: t + struct.pack("<I", len(d)) + d + b"\0" * (len(d) % 2)
    riff = lambda body: b"RIFF" + struct.pack("<I", 4 + len(body)) + b"WEBP" + body
    kept, dropped = chunk(b"VP8 ", b"abc"), chunk(b"EXIF", b"x")
    assert containers.kept_riff(riff(kept + dropped)[:-1], 50) == riff(kept)  # padding that is missing is no fault
    frames = b"".join(chunk(b"ANMF", bytes([k])) for k in range(25))
    assert containers.kept_riff(riff(frames), 30, "webp_animated") == riff(frames[: 20 * 10])
    files = [("a", "Jpeg", long), ("b", "Jpeg", b"\xff\xd8"), ("c", "WebP", riff(kept + dropped)), ("d", "WebP", b"RIFF"), ("e", "WebP", None), ("f", "Jpeg", long[:30]), ("g", "Png", b"x")]
    rows = {r.path: r for r in containers.rewritten(spark.createDataFrame(files, "path string, format string, content binary"), 50).collect()}
    assert set(rows) == set("abcdef") and bytes(rows["a"].content) == data and bytes(rows["c"].content) == riff(kept)
    assert all(rows[k].content is None and rows[k].error for k in "bdef")


def test_only_the_wanted_form_is_made_and_tasks_give_on_a_few_files_at_once(spark, monkeypatch):
    px = spark.createDataFrame([(i, y, x, y * 9, x * 7, i, 255 - i % 2) for i in range(6) for y in range(5) for x in range(4)], "img_id long, y long, x long, r long, g long, b long, a long")
    every = rasters.png_candidates(rasters.images(px))
    for wanted in ("rgb-paeth", "rgba-average", "palette-none"):
        one = rasters.png_candidates(rasters.images(px), wanted)
        assert sorted(map(tuple, one.collect())) == sorted(map(tuple, every.where(F.col("strategy") == wanted).collect()))
    monkeypatch.setattr(rasters, "AT_ONCE", 200)
    schema = rasters.pa.schema([("k", rasters.pa.int64()), ("content", rasters.pa.binary())])
    assert [b.num_rows for b in rasters._in_parts(((k, b"x" * 50) for k in range(5)), schema)] == [2, 2, 1]


def test_jpeg_blocks_move_each_pixel_once(spark):
    """The transform of pixels is that of their planes, with edges that repeat; pixels are shuffled once, as one row each, and the size of an image needs no second look at them."""
    pixels = image(spark, noise(4, 21, 13, 3))
    got = {(r.channel, r.by, r.bx): r for r in blocks.transformed(pixels).collect()}
    want = {(r.channel, r.by, r.bx): r.f for r in blocks.coefficients(blocks.planes(pixels)).collect()}
    assert got.keys() == want.keys()
    assert all(np.allclose(got[k].f, want[k], atol=1e-9) for k in want)
    assert {(r.w, r.h) for k, r in got.items() if k[1:] == (2, 1)} == {(13, 21)}
    whole = blocks.quantised(blocks.coefficients(blocks.planes(pixels)), 50)
    assert {(r.channel, r.by, r.bx): r.z for r in blocks.transformed(pixels, 50).collect()} == {(r.channel, r.by, r.bx): r.z for r in whole.collect()}
    plan = jpegs.write_jpegs(pixels, 50)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and plan.count("Repartition") == 1


def test_code_tables_are_as_wide_as_their_longest_code():
    table = jpegs._table(bytes([0, 2, 1, *[0] * 13, 5, 6, 7]))
    assert table == ([5, 5, 6, 6, 7, 0, 0, 0], [2, 2, 2, 2, 3, 0, 0, 0], 13)


# ---- forms of PNG ----


def test_png_forms_with_alpha_come_back():
    few = noise(1, 3, 4, 4, 2) * 100
    gray = np.concatenate([np.repeat(noise(2, 40, 40, 1), 3, axis=2), noise(3, 40, 40, 1)], axis=2)
    for x, want in ((few, ["rgba", "palette"]), (gray, ["rgba", "graya"]), (few[:, :, [0, 0, 0, 3]], ["rgba", "palette", "graya"])):
        made = list(rasters.forms(x))
        assert [name for name, _, _ in made] == want
        for _, own, palette in made:
            for f in rasters.FILTERS:
                assert (rasters.read_png(rasters.png_bytes(own, f, palette)) == x).all()


@pytest.mark.parametrize(("colors", "held"), [(256, True), (257, False)])
def test_a_palette_has_as_many_colors_as_a_byte_tells(colors, held):
    x = np.arange(colors, dtype=np.uint32)[None, :].astype("<u4").view(np.uint8).reshape(1, colors, 4)
    assert ("palette" in [name for name, _, _ in rasters.forms(x)]) == held
    assert all((rasters.read_png(rasters.png_bytes(own, "adaptive", palette)) == x).all() for _, own, palette in rasters.forms(x))


def test_gif_of_an_image_that_is_not_opaque_is_null(spark):
    pixels = spark.createDataFrame([(i, 0, x, 5, 6, 7, 255 - i * x) for i in range(2) for x in range(3)], "img_id long, y long, x long, r long, g long, b long, a long")
    assert {r.img_id: r.content is None for r in rasters.write_gif(rasters.images(pixels)).collect()} == {0: False, 1: True}


def test_png_reencode_takes_every_form(spark, tmp_path):
    import duckdb

    from tessera import catalog

    # Keys of parts that make an image opaque or clear: black, of one colour, of 320 colours.
    keys = {1: (256, "black"), 2: (2816, "black"), 3: (1, "one"), 4: (11, "one"), 5: (1, "many"), 6: (11, "many")}
    rows = [(i, k, p, k if kind == "many" else 0, float(k // 256 if kind == "many" else 0)) for i, (p, kind) in keys.items() for k in range(320)]
    made = spark.createDataFrame(rows, "l_suppkey long, l_linenumber int, l_partkey long, l_orderkey long, l_quantity double")
    made.selectExpr("*", "0.0d l_extendedprice", "timestamp '2020-01-01' l_shipdate").coalesce(1).write.parquet(str(tmp_path / "lineitem.parquet"))
    con = duckdb.connect()
    con.sql(f"create view lineitem as from '{tmp_path}/lineitem.parquet/*.parquet'")
    got = sorted(map(tuple, catalog.QUERIES["png_reencode"](spark, str(tmp_path)).select("img_id", "strategy", "n", "checksum").collect()))
    assert got == sorted(con.sql(f"select img_id,strategy,n,checksum from ({catalog.ORACLE_SQL['png_reencode']})").fetchall())
    forms = {i: {s.split("-")[0] for k, s, _, _ in got if k == i} for i in keys}
    assert forms == {1: {"rgba", "rgb", "gray", "graya", "palette"}, 2: {"rgba", "graya", "palette"}, 3: {"rgba", "rgb", "palette"}, 4: {"rgba", "palette"}, 5: {"rgba", "rgb"}, 6: {"rgba"}}
    assert len(got) == len(rasters.FILTERS) * sum(map(len, forms.values()))
