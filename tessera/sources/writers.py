"""Meshes as files: vertices (mesh_id, vid, x, y, z) and faces (mesh_id, fid, i0, i1, i2) to one row (mesh_id, content) for each mesh.

Text formats are put together by Spark's own functions, binary ones with numpy
in Arrow tasks. A file is one value, so a mesh is one row; rows are dealt by mesh.
"""

from __future__ import annotations

import base64
import json
import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.sources.meshes import PLY_TYPES


def packed(vertices: DataFrame, faces: DataFrame) -> DataFrame:
    """mesh_id, points (structs with vid, x, y, z in order), corners (structs with fid, i0, i1, i2 in order). A mesh without faces has none."""
    v = vertices.groupBy("mesh_id").agg(F.array_sort(F.collect_list(F.struct("vid", "x", "y", "z"))).alias("points"))
    f = faces.groupBy("mesh_id").agg(F.array_sort(F.collect_list(F.struct("fid", "i0", "i1", "i2"))).alias("corners"))
    return v.join(f, "mesh_id", "left").select("mesh_id", "points", F.coalesce("corners", F.array().cast("array<struct<fid:bigint,i0:bigint,i1:bigint,i2:bigint>>")).alias("corners"))


# ---- text ----


def _numbers(p: Column) -> Column:
    return F.concat_ws(" ", *(p[a].cast("string") for a in "xyz"))


def obj_text(meshes: DataFrame) -> DataFrame:
    """packed meshes -> OBJ: vertices, then faces with indices from one."""
    v = F.transform("points", lambda p: F.concat(F.lit("v "), _numbers(p)))
    f = F.transform("corners", lambda t: F.concat_ws(" ", F.lit("f"), *((t[f"i{k}"] + 1).cast("string") for k in range(3))))
    return meshes.select("mesh_id", F.encode(F.concat(F.array_join(F.concat(v, f), "\n"), F.lit("\n")), "UTF-8").alias("content"))


def ply_text(meshes: DataFrame) -> DataFrame:
    """packed meshes -> ASCII PLY."""
    head = F.concat(
        F.lit("ply\nformat ascii 1.0\nelement vertex "), F.size("points").cast("string"), F.lit("\nproperty double x\nproperty double y\nproperty double z\nelement face "), F.size("corners").cast("string"),
        F.lit("\nproperty list uchar int vertex_indices\nend_header"),
    )
    f = F.transform("corners", lambda t: F.concat_ws(" ", F.lit("3"), *(t[f"i{k}"].cast("string") for k in range(3))))
    body = F.concat(F.array(head), F.transform("points", _numbers), f)
    return meshes.select("mesh_id", F.encode(F.concat(F.array_join(body, "\n"), F.lit("\n")), "UTF-8").alias("content"))


def stl_text(meshes: DataFrame) -> DataFrame:
    """packed meshes -> ASCII STL without normals; a vertex number that is no place in `points` gives no line."""

    def facet(t: Column) -> Column:
        lines = [F.concat(F.lit("vertex "), _numbers(F.get("points", t[f"i{k}"].cast("int")))) for k in range(3)]
        return F.concat_ws("\n", F.lit("facet normal 0 0 0"), F.lit("outer loop"), *lines, F.lit("endloop"), F.lit("endfacet"))

    body = F.concat(F.array(F.lit("solid mesh")), F.transform("corners", facet), F.array(F.lit("endsolid mesh")))
    return meshes.select("mesh_id", F.encode(F.concat(F.array_join(body, "\n"), F.lit("\n")), "UTF-8").alias("content"))


# ---- binary ----


def stl_bytes(points: np.ndarray, corners: np.ndarray) -> bytes:
    record = np.dtype([("normal", "<f4", 3), ("v", "<f4", (3, 3)), ("attribute", "<u2")])
    out = np.zeros(len(corners), record)
    out["v"] = points[corners]
    return b"mesh".ljust(80, b"\0") + len(corners).to_bytes(4, "little") + out.tobytes()


def ply_bytes(points: np.ndarray, corners: np.ndarray, order: str = "<") -> bytes:
    name = "binary_little_endian" if order == "<" else "binary_big_endian"
    head = f"ply\nformat {name} 1.0\nelement vertex {len(points)}\nproperty double x\nproperty double y\nproperty double z\nelement face {len(corners)}\nproperty list uchar int vertex_indices\nend_header\n"
    rows = np.zeros(len(corners), np.dtype([("n", "u1"), ("i", f"{order}i4", 3)]))
    rows["n"], rows["i"] = 3, corners
    return head.encode("ascii") + points.astype(f"{order}f8").tobytes() + rows.tobytes()


def _gltf_parts(points: np.ndarray, corners: np.ndarray) -> tuple[dict, bytes]:
    index, xyz = corners.astype("<u4").tobytes(), points.astype("<f4").tobytes()
    doc = {
        "asset": {"version": "2.0"}, "buffers": [{"byteLength": len(xyz) + len(index)}],
        "bufferViews": [{"buffer": 0, "byteOffset": 0, "byteLength": len(xyz)}, {"buffer": 0, "byteOffset": len(xyz), "byteLength": len(index)}],
        "accessors": [{"bufferView": 0, "componentType": 5126, "count": len(points), "type": "VEC3"}, {"bufferView": 1, "componentType": 5125, "count": 3 * len(corners), "type": "SCALAR"}],
        "meshes": [{"primitives": [{"attributes": {"POSITION": 0}, "indices": 1}]}],
    }
    return doc, xyz + index


def glb_of(doc: bytes, data: bytes | None) -> bytes:
    """A GLB file of a JSON text and a buffer, padded to four bytes with spaces and zeros."""
    parts = [(b"JSON", doc + b" " * (-len(doc) % 4))] + ([(b"BIN\0", data + b"\0" * (-len(data) % 4))] if data is not None else [])
    body = b"".join(struct.pack("<I", len(d)) + tag + d for tag, d in parts)
    return b"glTF" + struct.pack("<II", 2, 12 + len(body)) + body


def glb_bytes(points: np.ndarray, corners: np.ndarray) -> bytes:
    doc, data = _gltf_parts(points, corners)
    return glb_of(json.dumps(doc, separators=(",", ":")).encode("utf-8"), data)


def gltf_bytes(points: np.ndarray, corners: np.ndarray) -> bytes:
    """glTF with its buffer as a data URI."""
    doc, data = _gltf_parts(points, corners)
    doc["buffers"][0]["uri"] = "data:application/octet-stream;base64," + base64.b64encode(data).decode("ascii")
    return json.dumps(doc).encode("utf-8")


def fbx_bytes(points: np.ndarray, corners: np.ndarray, version: int = 7400) -> bytes:
    """Binary FBX with one geometry; the last corner of a polygon is stored as its complement."""
    wide = version >= 7500

    def node(name: bytes, values: list[bytes], children: list[Callable[[int], bytes]], at: int) -> bytes:
        head = (25 if wide else 13) + len(name)
        own = b"".join(values)
        body, place = b"", at + head + len(own)
        for child in children:
            part = child(place)
            body, place = body + part, place + len(part)
        if children:
            body += bytes(25 if wide else 13)
        end = at + head + len(own) + len(body)
        return struct.pack("<QQQ" if wide else "<III", end, len(values), len(own)) + bytes([len(name)]) + name + own + body

    def array(kind: bytes, values: np.ndarray) -> bytes:
        data = zlib.compress(values.tobytes())
        return kind + struct.pack("<III", len(values), 1, len(data)) + data

    index = corners.astype("<i4").copy()
    if len(index):
        index[:, -1] = ~index[:, -1]
    leaves = [lambda at: node(b"Vertices", [array(b"d", points.astype("<f8").ravel())], [], at), lambda at: node(b"PolygonVertexIndex", [array(b"i", index.ravel())], [], at)]
    head = b"Kaydara FBX Binary  \0\x1a\0" + struct.pack("<I", version)
    return head + node(b"Objects", [], [lambda at: node(b"Geometry", [], leaves, at)], len(head)) + bytes(25 if wide else 13)


ENCODERS: dict[str, Callable[[np.ndarray, np.ndarray], bytes]] = {
    "Stl": stl_bytes, "Ply": ply_bytes, "PlyBig": lambda p, c: ply_bytes(p, c, ">"), "Glb": glb_bytes, "Gltf": gltf_bytes, "Fbx": fbx_bytes, "FbxWide": lambda p, c: fbx_bytes(p, c, 7700),
}


def write_binary(meshes: DataFrame, kind: str) -> DataFrame:
    """packed meshes -> mesh_id, content, by one of ENCODERS. A face with a number that is no place in `points` is left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for p, c in zip(b.column("p"), b.column("c"), strict=True):
                points = p.values.to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, 3)
                corners = c.values.to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, 3)
                corners = corners[((corners >= 0) & (corners < len(points))).all(axis=1)]
                out.append(ENCODERS[kind](points, corners))
            yield pa.RecordBatch.from_arrays([b.column("mesh_id"), pa.array(out, pa.binary())], ["mesh_id", "content"])

    flat = meshes.select("mesh_id", F.flatten(F.transform("points", lambda p: F.array(*(p[a] for a in "xyz")))).alias("p"), F.flatten(F.transform("corners", lambda t: F.array(*(t[f"i{k}"] for k in range(3))))).alias("c"))
    return flat.mapInArrow(run, "mesh_id bigint, content binary")


# ---- with normals and texture coordinates ----


def attributed_ply(columns: dict[str, tuple[str, np.ndarray]], corners: np.ndarray, order: str = "<") -> bytes:
    """columns: name -> (PLY's type, values) of the vertices."""
    name = "binary_little_endian" if order == "<" else "binary_big_endian"
    n = len(next(iter(columns.values()))[1])
    rows = np.zeros(n, np.dtype([(c, order + PLY_TYPES[kind]) for c, (kind, _) in columns.items()]))
    for c, (_, values) in columns.items():
        rows[c] = values
    listed = np.zeros(len(corners), np.dtype([("n", "u1"), ("i", f"{order}i4", 3)]))
    listed["n"], listed["i"] = 3, corners
    properties = "".join(f"property {kind} {c}\n" for c, (kind, _) in columns.items())
    head = f"ply\nformat {name} 1.0\nelement vertex {n}\n{properties}element face {len(corners)}\nproperty list uchar int vertex_indices\nend_header\n"
    return head.encode("ascii") + rows.tobytes() + listed.tobytes()


def attributed_glb(points: np.ndarray, normals: np.ndarray, uv: np.ndarray, corners: np.ndarray) -> bytes:
    doc, data = _gltf_parts(points, corners)
    for name, kind, values in (("NORMAL", "VEC3", normals), ("TEXCOORD_0", "VEC2", uv)):
        raw = values.astype("<f4").tobytes()
        doc["bufferViews"].append({"buffer": 0, "byteOffset": len(data), "byteLength": len(raw)})
        doc["accessors"].append({"bufferView": len(doc["bufferViews"]) - 1, "componentType": 5126, "count": len(values), "type": kind})
        doc["meshes"][0]["primitives"][0]["attributes"][name] = len(doc["accessors"]) - 1
        data += raw
    doc["buffers"][0]["byteLength"] = len(data)
    return glb_of(json.dumps(doc, separators=(",", ":")).encode("utf-8"), data)


#: The eight types of PLY's scalars, each as a property of its name with the vertex's number within its range.
SCALARS = (("char", 100), ("uchar", 200), ("short", 30_000), ("ushort", 60_000), ("int", 1 << 30), ("uint", 1 << 31), ("float", 1 << 20), ("double", 1 << 40))


def write_attributed(vertices: DataFrame, faces: DataFrame, kind: str) -> DataFrame:
    """vertices (mesh_id, vid, x, y, z, nx, ny, nz, u, v) and faces -> mesh_id, content: `Glb`, or `Ply` or `PlyBig` with a property of every scalar type besides."""
    names = ("x", "y", "z", "nx", "ny", "nz", "u", "v")
    v = vertices.groupBy("mesh_id").agg(F.array_sort(F.collect_list(F.struct("vid", *names))).alias("p"))
    f = faces.groupBy("mesh_id").agg(F.array_sort(F.collect_list(F.struct("fid", "i0", "i1", "i2"))).alias("c"))
    whole = v.join(f, "mesh_id", "left").select("mesh_id", F.flatten(F.transform("p", lambda p: F.array(*(p[c] for c in names)))).alias("p"), F.coalesce(F.flatten(F.transform("c", lambda t: F.array(*(t[f"i{k}"] for k in range(3))))), F.array().cast("array<bigint>")).alias("c"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for p, c in zip(b.column("p"), b.column("c"), strict=True):
                x = p.values.to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, 8)
                corners = c.values.to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, 3)
                if kind == "Glb":
                    out.append(attributed_glb(x[:, :3], x[:, 3:6], x[:, 6:], corners))
                else:
                    more = {f"a_{t}": (t, np.arange(len(x)) * 7919 % most) for t, most in SCALARS}
                    out.append(attributed_ply({n: ("double", x[:, k]) for k, n in enumerate(names)} | more, corners, ">" if kind == "PlyBig" else "<"))
            yield pa.RecordBatch.from_arrays([b.column("mesh_id"), pa.array(out, pa.binary())], ["mesh_id", "content"])

    return whole.mapInArrow(run, "mesh_id bigint, content binary")
