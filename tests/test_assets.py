"""Files that are written, read, shortened, and those that can't be."""

import struct
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera import sqlfunctions
from tessera.functions import markup
from tessera.operators import optimize
from tessera.sources import meshes, rasters, writers

V = "mesh_id long, vid long, x double, y double, z double"
T = "mesh_id long, fid long, i0 long, i1 long, i2 long"


def noise(h=5, w=7, channels=4):
    return np.random.default_rng(3).integers(0, 256, (h, w, channels)).astype(np.uint8)


@pytest.mark.parametrize("name", rasters.FILTERS)
def test_png_filters_are_reversed(name):
    for x in (noise(), noise(channels=3), noise(channels=1), noise(1, 1)):
        assert (rasters.read_png(rasters.png_bytes(x, name)) == rasters._rgba(x)).all()


def test_png_palette_and_limits():
    palette = noise(4, 1, 3).reshape(-1, 3)
    index = np.array([[0, 1], [3, 2]], np.uint8)[:, :, None]
    assert (rasters.read_png(rasters.png_bytes(index, "up", palette))[:, :, :3] == palette[index[:, :, 0]]).all()
    data = bytearray(rasters.png_bytes(noise()))
    data[28] = 1  # interlaced
    with pytest.raises(ValueError):
        rasters.read_png(bytes(data))
    with pytest.raises(ValueError):
        rasters.read_png(b"no png at all")


def test_tga_runs():
    head = bytes([0, 0, 10, *[0] * 9]) + struct.pack("<HHBB", 3, 2, 24, 0)
    data = head + bytes([0x82, 1, 2, 3]) + bytes([0x01, 4, 5, 6, 7, 8, 9, 0x80, 10, 11, 12])
    x = rasters.read_tga(data)
    assert x.shape == (2, 3, 4) and x[1, :, :3].tolist() == [[3, 2, 1]] * 3 and x[0, :, :3].tolist() == [[6, 5, 4], [9, 8, 7], [12, 11, 10]]


def test_files_that_cannot_be_read_are_error_rows(spark):
    rows = [("a", "Png", b"\x89PNG\r\n\x1a\nrest"), ("b", "Bmp", b"BM"), ("c", "Png", bytearray(rasters.png_bytes(noise(2, 2))))]
    files = spark.createDataFrame([(p, f, bytearray(c)) for p, f, c in rows], "path string, format string, content binary")
    pixels, errors = rasters.read_pixels(files)
    assert {r.path for r in errors.collect()} == {"a", "b"} and pixels.where("path = 'c'").count() == 4
    broken = spark.createDataFrame([("m", "Fbx", bytearray(b"Kaydara FBX Binary  \0\x1a\0" + struct.pack("<I", 7400) + struct.pack("<IIIB", 60, 1, 5, 1) + b"xQ" + bytes(40)))], "path string, format string, content binary")
    assert meshes.read_binary(broken)[2].count() == 1


def test_mesh_without_faces_and_no_mesh(spark):
    v = spark.createDataFrame([(1, 0, 0.5, 1.5, 2.5)], V)
    packed = writers.packed(v, spark.createDataFrame([], T))
    for kind, reader in (("Stl", "Stl"), ("Ply", "Ply"), ("Glb", "Glb"), ("Fbx", "Fbx")):
        files = writers.write_binary(packed, kind).select(F.lit("1").alias("path"), F.lit(reader).alias("format"), "content")
        points, faces, errors = meshes.read_binary(files)
        assert errors.count() == 0 and faces.count() == 0 and points.count() == (0 if kind == "Stl" else 1)
    assert writers.write_binary(writers.packed(v.limit(0), spark.createDataFrame([], T)), "Glb").count() == 0


def test_fbx_polygons_and_names():
    text = b"; FBX 7.4.0\nObjects: {\n Vertices: *12 {\n a: 0,0,0,1,0,0,1,1,0,0,1,0\n }\n PolygonVertexIndex: *4 {\n a: 0,1,2,-4\n }\n}\n"
    points, corners = meshes.READERS["Fbx"](text)
    assert points.shape == (4, 3) and corners.tolist() == [[0, 1, 2], [0, 2, 3]]


def test_svg_and_json_edges():
    assert markup.prune_svg(b"<svg><g> \n </g><a>x</a></svg>") == b"<svg><g/><a>x</a></svg>"
    assert markup.short_color("#AABBCC") == "#abc" and markup.short_color("#123456") == "#123456" and markup.short_color("red") == "red"
    with pytest.raises(ValueError):
        markup.prune_svg(b"<svg>")
    assert markup.prune_json({"a": {"b": {}}, "c": [], "name": "n"}, False) == {"a": {}, "name": "n"}
    assert markup.prune_json({"extras": 1, "list": [{"name": "n", "x": 0}]}, True) == {"list": [{"x": 0}]}
    glb = writers.glb_of(b'{"asset":{"version":"2.0"},"nodes":[]}', b"abc")
    pruned = markup.prune_glb(glb, False)
    assert len(pruned) % 4 == 0 and struct.unpack_from("<I", pruned, 8)[0] == len(pruned) and pruned.endswith(b"abc\0")


def test_optimize_keeps_what_it_cannot_shorten(spark):
    rows = [("broken.svg", b"<svg><g>"), ("empty", b""), ("null", None), ("text", b"not an asset"), ("broken.png", b"\x89PNG\r\n\x1a\nxxxxxxxx"), ("good.obj", b"# note\nv 0 0 0\n")]
    files = spark.createDataFrame([(p, None if c is None else bytearray(c)) for p, c in rows], "path string, content binary")
    out = {r.path: r for r in optimize.optimize(files).collect()}
    assert {p for p, r in out.items() if r.strategy == "keep"} == {"broken.svg", "empty", "null", "text", "broken.png"}
    assert bytes(out["good.obj"].content) == b"v 0 0 0" and out["null"].content is None
    assert all(p == "null" or bytes(out[p].content) == c for p, c in rows if out[p].strategy == "keep")


def test_shortest_png_of_gray_is_gray():
    gray = np.repeat(noise(16, 16, 1) // 2, 3, axis=2)
    strategy, data = optimize.shortest_png("Png", rasters.png_bytes(np.concatenate([gray, np.full((16, 16, 1), 255, np.uint8)], axis=2)))
    assert strategy.startswith("png-gray") and (rasters.read_png(data)[:, :, :3] == gray).all()


def test_sql_functions(spark):
    names = sqlfunctions.register(spark)
    assert {"detect_format", "is_png", "optimized", "parse_chunks", "parse_mesh"} <= set(names)
    png = rasters.png_bytes(noise(3, 3, 3))
    glb = writers.glb_bytes(np.array([[0.0, 0, 0], [1, 0, 0], [0, 1, 0]]), np.array([[0, 1, 2]]))
    spark.createDataFrame([("p", bytearray(png)), ("g", bytearray(glb))], "path string, content binary").createOrReplaceTempView("asset_files")
    assert {r.path: r.f for r in spark.sql("select path, detect_format(content) f from asset_files").collect()} == {"p": "image:Png", "g": "mesh:Glb"}
    tags = spark.sql("select c.tag from asset_files, lateral parse_chunks(content, 'Png') c where path = 'p' order by c.seq").collect()
    assert [r.tag for r in tags] == ["IHDR", "IDAT", "IEND"]
    assert spark.sql("select m.* from asset_files, lateral parse_mesh(content, 'Glb') m where path = 'g'").count() == 4
    assert all(r.n <= r.m for r in spark.sql("select length(optimized(content, 50)) n, length(content) m from asset_files").collect())


def test_little_numbers(spark):
    value = spark.range(1).select(rasters.little_hex(F.lit(0x01020304), 4).alias("h")).first().h
    assert value == "04030201" and zlib.crc32(b"IEND") == 0xAE426082


def test_ply_text_is_slimmed_in_proportion_to_its_lines(spark):
    n = 8_000
    text = "ply\nformat ascii 1.0\nelement vertex %d\nproperty double x\nelement face 0\nend_header\n" % n + "".join(f"{i}.50000\n" for i in range(n))
    df = spark.createDataFrame([(text,)], "s string")
    begin = time.monotonic()
    lines = df.select(markup.slim_ply(F.col("s")).alias("s")).first().s.split("\n")
    assert time.monotonic() - begin < 30
    assert lines[5:8] == ["end_header", "0.5", "1.5"] and lines[-2:] == [f"{n - 1}.5", ""]
