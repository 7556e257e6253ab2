import json
import struct
import zlib

import pytest
from pyspark.sql import functions as F

from tessera.sources import assets, chunks, meshes
from tessera.sources.files import read_files
from tessera.streaming.arrivals import arriving_files, violations_by_window


def png():
    def chunk(tag, data):
        return struct.pack(">I", len(data)) + tag + data + struct.pack(">I", zlib.crc32(tag + data))

    head = chunk(b"IHDR", struct.pack(">IIBBBBB", 1, 1, 8, 2, 0, 0, 0))
    return b"\x89PNG\r\n\x1a\n" + head + chunk(b"tEXt", b"a\0b") + chunk(b"IDAT", zlib.compress(b"\0\1\2\3")) + chunk(b"IEND", b"")


def stl(n=2):
    facet = struct.pack("<12fH", *([0.0] * 3), 0, 0, 0, 1, 0, 0, 0, 1, 0, 0)
    return b"made by a test".ljust(80) + struct.pack("<I", n) + facet * n


def ply(binary):
    head = "ply\nformat {} 1.0\nelement vertex 4\nproperty float x\nproperty float y\nproperty float z\nelement face 1\nproperty list uchar int vertex_indices\nend_header\n"
    points = [(0, 0, 0), (1, 0, 0), (1, 1, 0), (0, 1, 0)]
    if binary:
        return head.format("binary_little_endian").encode() + b"".join(struct.pack("<3f", *p) for p in points) + struct.pack("<B4i", 4, 0, 1, 2, 3)
    return (head.format("ascii") + "".join(f"{x} {y} {z}\n" for x, y, z in points) + "4 0 1 2 3\n").encode()


def glb():
    data = struct.pack("<9f", 0, 0, 0, 1, 0, 0, 0, 1, 0) + struct.pack("<3H", 0, 1, 2) + b"\0\0"
    doc = {
        "asset": {"version": "2.0"}, "buffers": [{"byteLength": len(data)}], "bufferViews": [{"buffer": 0, "byteLength": 36}, {"buffer": 0, "byteOffset": 36, "byteLength": 6}],
        "accessors": [{"bufferView": 0, "componentType": 5126, "count": 3, "type": "VEC3"}, {"bufferView": 1, "componentType": 5123, "count": 3, "type": "SCALAR"}],
        "meshes": [{"primitives": [{"attributes": {"POSITION": 0}, "indices": 1}] * 2}],
    }
    text = json.dumps(doc).encode()
    text += b" " * (-len(text) % 4)
    body = struct.pack("<I4s", len(text), b"JSON") + text + struct.pack("<I4s", len(data), b"BIN\0") + data
    return b"glTF" + struct.pack("<II", 2, 12 + len(body)) + body


FILES = {
    "a.png": png(), "cut.png": png()[:62], "b.stl": stl(), "t.stl": b"solid t\nfacet normal 0 0 1\n outer loop\n vertex 0 0 0\n vertex 1 0 0\n vertex 0 1.5 0\n endloop\nendfacet\nendsolid t\n",
    "c.ply": ply(True), "d.ply": ply(False), "e.glb": glb(), "f.obj": b"# x\no q\nv 0 0 0\nv 1 0 0\nv 1 1 0\nv 0 1 0\nvn 0 0 1\nf 1//1 2//1 3//1 4//1\nf -4 -3 -2\nf 1 2 9\n", "g.txt": b"just a plain text file",
    "empty.bin": b"", "h.gif": b"GIF89a\1\0\1\0\x80\0\0\0\0\0\xff\xff\xff!\xfe\3abc\0,\0\0\0\0\1\0\1\0\0\2\2D\1\0;", "i.ico": b"\0\0\1\0\1\0\x10\x10\0\0\1\0\x20\0\4\0\0\0\x16\0\0\0abcd",
    "j.webp": b"RIFF\x1e\0\0\0WEBPVP8L\4\0\0\0abcdEXIF\3\0\0\0abc\0", "k.svg": b'<?xml version="1.0"?><svg width="1"></svg>', "l.jpg": b"\xff\xd8\xff\xe0\0\4ab\xff\xda\0\2xyz\xff\xd9", "m.tga": bytes([0, 0, 2] + [0] * 9 + [1, 0, 1, 0, 24, 0]) + b"abc",
    "n.fbx": b"; FBX 7.4.0 project file\n", "o.gltf": b'{"asset": {"version": "2.0"}, "meshes": []}', "bad.ply": b"ply\nformat ascii 1.0\nelement vertex 3\nproperty float x\nend_header\n1\n",
}


@pytest.fixture(scope="module")
def files(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("files")
    for name, data in FILES.items():
        (folder / name).write_bytes(data)
    return read_files(spark, str(folder)).withColumn("path", F.regexp_extract("path", r"([^/]*)$", 1)), str(folder)


def test_detection(files):
    got = {r.path: r.format for r in files[0].select("path", "format").collect()}
    want = {"a.png": "image:Png", "cut.png": "image:Png", "b.stl": "mesh:Stl", "t.stl": "mesh:Stl", "c.ply": "mesh:Ply", "d.ply": "mesh:Ply", "e.glb": "mesh:Glb", "f.obj": "mesh:Obj", "g.txt": "unknown", "h.gif": "image:Gif"}
    want |= {"i.ico": "image:Ico", "j.webp": "image:WebP", "k.svg": "image:Svg", "l.jpg": "image:Jpeg", "m.tga": "image:Tga", "n.fbx": "mesh:Fbx", "o.gltf": "mesh:Gltf", "bad.ply": "mesh:Ply"}
    assert got == want
    assert files[0].where("error is not null").count() == 0  # Spark's reader passes over the empty file


def test_obj(files):
    v, f = meshes.read_obj(files[0].where("path = 'f.obj'"))
    assert v.count() == 4
    assert [tuple(r)[2:] for r in f.orderBy("fid").collect()] == [(0, 1, 2), (0, 2, 3), (0, 1, 2)]


def test_stl_text(files):
    v, f = meshes.read_stl_text(files[0].where("path = 't.stl'"))
    assert [tuple(r)[2:] for r in v.orderBy("vid").collect()] == [(0.0, 0.0, 0.0), (1.0, 0.0, 0.0), (0.0, 1.5, 0.0)]
    assert [tuple(r)[1:] for r in f.collect()] == [(0, 0, 1, 2)]


def test_binary_meshes(files):
    named = files[0].withColumn("format", F.substring_index("format", ":", -1)).where("path <> 't.stl'")
    v, f, errors = meshes.read_binary(named)
    assert {r.path: r["count"] for r in v.groupBy("path").count().collect()} == {"b.stl": 6, "c.ply": 4, "d.ply": 4, "e.glb": 6}
    faces = {}
    for r in f.orderBy("path", "fid").collect():
        faces.setdefault(r.path, []).append((r.i0, r.i1, r.i2))
    assert faces == {"b.stl": [(0, 1, 2), (3, 4, 5)], "c.ply": [(0, 1, 2), (0, 2, 3)], "d.ply": [(0, 1, 2), (0, 2, 3)], "e.glb": [(0, 1, 2), (3, 4, 5)]}
    assert [r.path for r in errors.collect()] == ["bad.ply"]


def test_chunks(files):
    named = files[0].withColumn("format", F.substring_index("format", ":", -1))
    rows = chunks.read_chunks(named).orderBy("path", "seq").collect()
    tags = {}
    for r in rows:
        tags.setdefault(r.path, []).append(r.tag)
    assert tags["a.png"] == ["IHDR", "tEXt", "IDAT", "IEND"]
    assert tags["h.gif"] == ["COMMENT", "IMAGE", "TRAILER"]
    assert tags["i.ico"] == ["16x16x32"] and tags["j.webp"] == ["VP8L", "EXIF"] and tags["e.glb"] == ["JSON", "BIN"]
    assert tags["l.jpg"] == ["SOI", "APP0", "SOS", "EOI"]
    assert [r.payload for r in rows if r.path == "i.ico"] == [b"abcd"]
    assert [r.path for r in rows if r.error] == ["cut.png"]


def test_streams(spark, files, sf):
    query = arriving_files(spark, files[1], "*.png").writeStream.format("memory").queryName("arrived").trigger(availableNow=True).start()
    query.awaitTermination(60)
    assert {r.format for r in spark.table("arrived").collect()} == {"image:Png"}
    log = spark.readStream.schema(spark.read.parquet(f"{sf}/events.parquet").schema).parquet(f"{sf}/events.parquet*")
    log = log.selectExpr("ts", "'image' as family", "value as elapsed_ms", "event_id as size")
    query = violations_by_window(log).writeStream.format("memory").queryName("violations").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination(60)
    assert spark.table("violations").agg(F.sum("operations")).first()[0] == spark.read.parquet(f"{sf}/events.parquet").count()


def test_tasks_send_no_names_of_files_to_the_driver(tmp_path):
    import pickle
    from types import SimpleNamespace

    writer = assets.AssetWriter(f"file://{tmp_path}", False)
    sent = [writer.write(iter([SimpleNamespace(name=f"f{t}\n{k}", content=b"x") for k in range(500)])) for t in range(2)]
    assert all(len(pickle.dumps(s)) < 1000 for s in sent)
    writer.commit(sent)
    assert sorted(p.name for p in tmp_path.iterdir()) == sorted(f"f{t}\n{k}" for t in range(2) for k in range(500))
