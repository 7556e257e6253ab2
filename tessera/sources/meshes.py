"""Mesh files to vertices (path, vid, x, y, z) and faces (path, fid, i0, i1, i2). Text formats are taken apart by Spark, binary ones with numpy in Arrow tasks."""

from __future__ import annotations

import base64
import json
import re
import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.sources.chunks import UNREADABLE

NUMBER = r"[-+]?[0-9]*\.?[0-9]+(?:[eE][-+]?[0-9]+)?"
#: PLY's names of scalars and numpy's (fixed values).
PLY_TYPES = {
    "char": "i1", "int8": "i1", "uchar": "u1", "uint8": "u1", "short": "i2", "int16": "i2", "ushort": "u2", "uint16": "u2",
    "int": "i4", "int32": "i4", "uint": "u4", "uint32": "u4", "float": "f4", "float32": "f4", "double": "f8", "float64": "f8",
}
#: glTF component types, and the number of components of an accessor's type (fixed values).
GLTF_COMPONENTS = {5120: "i1", 5121: "u1", 5122: "i2", 5123: "u2", 5125: "u4", 5126: "f4"}
GLTF_WIDTH = {"SCALAR": 1, "VEC2": 2, "VEC3": 3, "VEC4": 4, "MAT2": 4, "MAT3": 9, "MAT4": 16}

Mesh = tuple[np.ndarray, np.ndarray]  # vertices n x 3, triangles m x 3


def lines(files: DataFrame) -> DataFrame:
    """path, line, text, words of each line that is not blank."""
    each = files.select("path", F.posexplode(F.split(F.decode("content", "UTF-8"), r"\r?\n")).alias("line", "text"))
    return each.where(F.trim("text") != "").select("path", "line", "text", F.split(F.trim("text"), r"\s+").alias("words"))


def fan_of(corners: Column) -> Column:
    """Triangles around the first corner of a polygon."""
    return F.when(F.size(corners) >= 3, F.transform(F.sequence(F.lit(1), F.size(corners) - 2), lambda k: F.array(corners[0], corners[k], corners[k + 1])))


def _faces(triangles: DataFrame, *order: str) -> DataFrame:
    """triangles (path, *order, t) -> path, fid, i0, i1, i2."""
    fid = (F.row_number().over(Window.partitionBy("path").orderBy(*order)) - 1).cast("long")
    return triangles.select("path", fid.alias("fid"), *(F.col("t")[k].alias(f"i{k}") for k in range(3)))


def read_obj(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Vertices and faces of OBJ files. An index counts from one, or back from the vertices so far; polygons are cut in fans; faces with an index that no vertex has are left out."""
    row = lines(files).where(F.col("words")[0].isin("v", "f"))
    before = Window.partitionBy("path").orderBy("line").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("path")
    is_v = F.col("words")[0] == "v"
    row = row.withColumn("seen", F.count_if(is_v).over(before)).withColumn("n", F.count_if(is_v).over(whole))
    vertices = row.where(is_v).select("path", F.col("seen").alias("vid"), *(F.get("words", F.lit(k + 1)).try_cast("double").alias(a) for k, a in enumerate("xyz")))
    index = F.transform(F.slice("words", 2, 1 << 20), lambda w: F.split(w, "/")[0].try_cast("long"))
    corners = F.transform(index, lambda i: F.when(i < 0, F.col("seen") + i).otherwise(i - 1))
    valid = F.filter(corners, lambda i: i.isNotNull() & (i >= 0) & (i < F.col("n")))
    polygons = row.where(~is_v).select("path", "line", valid.alias("valid"), F.size(corners).alias("k")).where(F.size("valid") == F.col("k"))
    return vertices, _faces(polygons.select("path", "line", F.posexplode(fan_of(F.col("valid"))).alias("step", "t")), "line", "step")


def read_stl_text(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """ASCII STL: three vertices a facet, none of them shared."""
    pattern = rf"(?i)vertex\s+({NUMBER}\s+{NUMBER}\s+{NUMBER})"
    found = files.select("path", F.posexplode(F.regexp_extract_all(F.decode("content", "UTF-8"), F.lit(pattern), F.lit(1))).alias("vid", "p"))
    xyz = F.split("p", r"\s+")
    vertices = found.select("path", F.col("vid").cast("long").alias("vid"), *(xyz[k].cast("double").alias(a) for k, a in enumerate("xyz")))
    whole = vertices.groupBy("path").agg(F.floor(F.count("*") / 3).alias("n")).where("n > 0")
    faces = whole.select("path", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("fid"))
    return vertices, faces.select("path", "fid", *((F.col("fid") * 3 + k).alias(f"i{k}") for k in range(3)))


def _stl(data: bytes) -> Mesh:
    record = np.dtype([("normal", "<f4", 3), ("v", "<f4", (3, 3)), ("attribute", "<u2")])
    n = int.from_bytes(data[80:84], "little")
    corners = np.frombuffer(data, record, min(n, (len(data) - 84) // 50), 84)["v"].reshape(-1, 3)
    return corners, np.arange(len(corners)).reshape(-1, 3)


def _fans(polygons: list[list[int]]) -> np.ndarray:
    return np.array([(p[0], p[k], p[k + 1]) for p in polygons for k in range(1, len(p) - 1)], np.int64).reshape(-1, 3)


def _ply_elements(data: bytes) -> Iterator[tuple[str, dict[str, np.ndarray | list]]]:
    """Name and properties of each element: an array for a scalar, a list of arrays for a list."""
    head, _, _ = data.partition(b"end_header")
    body = data[data.index(b"\n", len(head)) + 1 :]
    elements: list[tuple[str, int, list[list[str]]]] = []
    order = "ascii"
    for words in (x.split() for x in head.decode("ascii", "replace").splitlines()):
        if words[:1] == ["format"]:
            order = {"binary_little_endian": "<", "binary_big_endian": ">"}.get(words[1], "ascii")
        elif words[:1] == ["element"]:
            elements.append((words[1], int(words[2]), []))
        elif words[:1] == ["property"]:
            elements[-1][2].append(words[1:])
    at, tokens = 0, iter(body.split()) if order == "ascii" else iter(())

    def take(kind: str, n: int) -> np.ndarray:
        nonlocal at
        if order == "ascii":
            return np.array([float(next(tokens)) for _ in range(n)])
        t = np.dtype(order + PLY_TYPES[kind])
        at += t.itemsize * n
        return np.frombuffer(body, t, n, at - t.itemsize * n)

    for name, n, properties in elements:
        if all(p[0] != "list" for p in properties) and order != "ascii":
            t = np.dtype([(p[1], order + PLY_TYPES[p[0]]) for p in properties])
            rows = np.frombuffer(body, t, n, at)
            at += t.itemsize * n
            yield name, {p[1]: rows[p[1]] for p in properties}
            continue
        found: dict[str, list] = {p[-1]: [] for p in properties}
        for _ in range(n):
            for p in properties:
                found[p[-1]].append(take(p[0], 1)[0] if p[0] != "list" else take(p[2], int(take(p[1], 1)[0])))
        yield name, {p[-1]: found[p[-1]] if p[0] == "list" else np.array(found[p[-1]], np.float64) for p in properties}


def _ply(data: bytes) -> Mesh:
    xyz, polygons = np.zeros((0, 3)), []
    for name, found in _ply_elements(data):
        if name == "vertex":
            xyz = np.stack([np.asarray(found[a], np.float64) for a in "xyz"], 1)
        elif name == "face":
            polygons = [[int(i) for i in row] for row in found.get("vertex_indices", found.get("vertex_index", []))]
    return xyz, _fans(polygons)


def _gltf_primitives(data: bytes) -> Iterator[dict[str, np.ndarray]]:
    """Attributes of each primitive, and its `indices` where it has some."""
    chunks: dict[bytes, bytes] = {}
    if data[:4] == b"glTF":
        at = 12
        while at + 8 <= len(data):
            n = int.from_bytes(data[at : at + 4], "little")
            chunks.setdefault(data[at + 4 : at + 8], data[at + 8 : at + 8 + n])
            at += 8 + n
    doc = json.loads(chunks.get(b"JSON", data))
    buffers = [base64.b64decode(b["uri"].partition(",")[2]) if b.get("uri", "").startswith("data:") else chunks[b"BIN\0"] for b in doc.get("buffers", [])]

    def accessor(i: int) -> np.ndarray:
        a = doc["accessors"][i]
        view = doc["bufferViews"][a["bufferView"]]
        t, width = np.dtype("<" + GLTF_COMPONENTS[a["componentType"]]), GLTF_WIDTH[a["type"]]
        start, step = view.get("byteOffset", 0) + a.get("byteOffset", 0), view.get("byteStride", t.itemsize * width)
        raw = np.ndarray((a["count"], width), t, buffers[view["buffer"]], start, (step, t.itemsize))
        return raw / np.iinfo(t).max if a.get("normalized") else raw.copy()

    for primitive in (p for m in doc.get("meshes", []) for p in m.get("primitives", [])):
        found = {name: accessor(i) for name, i in primitive["attributes"].items()}
        yield found | ({"indices": accessor(primitive["indices"])} if "indices" in primitive else {})


def _gltf(data: bytes) -> Mesh:
    points, triangles, base = [np.zeros((0, 3))], [np.zeros((0, 3), np.int64)], 0
    for found in _gltf_primitives(data):
        xyz = found["POSITION"]
        index = found["indices"].ravel() if "indices" in found else np.arange(len(xyz))
        points.append(xyz)
        triangles.append(index[: len(index) // 3 * 3].astype(np.int64).reshape(-1, 3) + base)
        base += len(xyz)
    return np.concatenate(points), np.concatenate(triangles)


# ---- what vertices carry besides their place ----

ATTRIBUTES = ("nx", "ny", "nz", "u", "v")
#: Names of texture coordinates in PLY files (fixed values).
PLY_UV = (("u", "v"), ("s", "t"), ("texture_u", "texture_v"))


def _columns(n: int, normal: np.ndarray | None, uv: np.ndarray | None) -> np.ndarray:
    out = np.full((n, 5), np.nan)
    if normal is not None:
        out[:, :3] = normal
    if uv is not None:
        out[:, 3:] = uv
    return out


def _ply_attributes(data: bytes) -> np.ndarray:
    found = next(f for name, f in _ply_elements(data) if name == "vertex")
    pick = lambda names: np.stack([np.asarray(found[c], np.float64) for c in names], 1) if all(c in found for c in names) else None
    uv = next((x for x in map(pick, PLY_UV) if x is not None), None)
    return _columns(len(found["x"]), pick(("nx", "ny", "nz")), uv)


def _gltf_attributes(data: bytes) -> np.ndarray:
    return np.concatenate([np.zeros((0, 5)), *(_columns(len(f["POSITION"]), f.get("NORMAL"), f.get("TEXCOORD_0")) for f in _gltf_primitives(data))])


CARRIERS: dict[str, Callable[[bytes], np.ndarray]] = {"Ply": _ply_attributes, "Gltf": _gltf_attributes, "Glb": _gltf_attributes}


def read_attributes(files: DataFrame) -> DataFrame:
    """files (path, format, content) of CARRIERS' formats -> path, vid, nx, ny, nz, u, v: normals and texture coordinates of vertices, null where a file has none. Files that can't be read give no row; `read_binary` says why."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, name, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                try:
                    x = CARRIERS[name](data.as_py() or b"")
                except UNREADABLE:
                    continue
                values = [pa.array(x[:, k], mask=np.isnan(x[:, k])) for k in range(5)]
                yield pa.RecordBatch.from_arrays([pa.array([path] * len(x), pa.string()), pa.array(np.arange(len(x))), *values], ["path", "vid", *ATTRIBUTES])

    return files.where(F.col("format").isin(*CARRIERS)).select("path", "format", "content").mapInArrow(run, f"path string, vid bigint, {', '.join(f'{c} double' for c in ATTRIBUTES)}")


def read_ply_scalars(files: DataFrame) -> DataFrame:
    """files (path, content) -> path, element, row, property, value: every scalar of PLY files, whatever its type. Files that can't be read give no row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, data in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                try:
                    found = [(name, c, np.asarray(v, np.float64)) for name, f in _ply_elements(data.as_py() or b"") for c, v in f.items() if isinstance(v, np.ndarray)]
                except UNREADABLE:
                    continue
                for name, c, v in found:
                    yield pa.RecordBatch.from_arrays([pa.array([path] * len(v), pa.string()), pa.array([name] * len(v), pa.string()), pa.array(np.arange(len(v))), pa.array([c] * len(v), pa.string()), pa.array(v)], ["path", "element", "row", "property", "value"])

    return files.select("path", "content").mapInArrow(run, "path string, element string, row bigint, property string, value double")


#: Types of FBX properties: scalars and arrays, with numpy's names (fixed values).
FBX_SCALARS = {"Y": "<i2", "C": "u1", "I": "<i4", "F": "<f4", "D": "<f8", "L": "<i8"}
FBX_ARRAYS = {"f": "<f4", "d": "<f8", "l": "<i8", "i": "<i4", "b": "u1"}


def _fbx_nodes(data: bytes) -> Iterator[tuple[str, list]]:
    """Name and array properties of every node, parents first."""
    wide = int.from_bytes(data[23:27], "little") >= 7500
    layout, pending = struct.Struct("<QQQB" if wide else "<IIIB"), [(27, len(data))]
    while pending:
        at, end = pending.pop()
        while at + layout.size <= end:
            stop, n, size, name = layout.unpack_from(data, at)
            if not stop:
                break
            start = at + layout.size
            label, place = data[start : start + name].decode("latin-1"), start + name
            body, values = place + size, []
            for _ in range(n):
                kind = chr(data[place])
                place += 1
                if kind in FBX_SCALARS:
                    place += np.dtype(FBX_SCALARS[kind]).itemsize
                elif kind in FBX_ARRAYS:
                    count, packing, length = struct.unpack_from("<III", data, place)
                    t = np.dtype(FBX_ARRAYS[kind])
                    raw = data[place + 12 : place + 12 + (length if packing else count * t.itemsize)]
                    values.append(np.frombuffer(zlib.decompress(raw) if packing else raw, t, count))
                    place += 12 + len(raw)
                elif kind in "SR":
                    place += 4 + int.from_bytes(data[place : place + 4], "little")
                else:
                    raise ValueError(f"property of type {kind!r}")
            yield label, values
            if body < stop:
                pending.append((stop, end))
                at, end = body, stop
                continue
            at = stop


def _polygons(index: np.ndarray) -> list[list[int]]:
    """Polygons whose last corner is stored as its complement."""
    out: list[list[int]] = [[]]
    for i in index.tolist():
        out[-1].append(~i if i < 0 else i)
        if i < 0:
            out.append([])
    return out[:-1]


def _fbx(data: bytes) -> Mesh:
    points, triangles, base, corners = [np.zeros((0, 3))], [np.zeros((0, 3), np.int64)], 0, None
    if data[:20] == b"Kaydara FBX Binary  ":
        found = [(name, values[0]) for name, values in _fbx_nodes(data) if values and name in ("Vertices", "PolygonVertexIndex")]
    else:
        text = data.decode("utf-8")
        found = [(m[1], np.array(m[2].replace("\n", " ").split(","), np.float64)) for m in re.finditer(r"(Vertices|PolygonVertexIndex):[^{}]*\{\s*a:([^}]*)\}", text)]
    for name, values in found:
        if name == "Vertices":
            corners = values.astype(np.float64)[: len(values) // 3 * 3].reshape(-1, 3)
            points.append(corners)
        elif corners is not None:
            triangles.append(_fans(_polygons(values.astype(np.int64))) + base)
            base += len(corners)
    return np.concatenate(points), np.concatenate(triangles)


READERS: dict[str, Callable[[bytes], Mesh]] = {"Stl": _stl, "Ply": _ply, "Gltf": _gltf, "Glb": _gltf, "Fbx": _fbx}


def read_binary(files: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """files (path, format, content) of READERS' formats -> vertices, faces, errors (path, error). A file that can't be read is an error row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.struct([("vertices", pa.list_(pa.float64())), ("indices", pa.list_(pa.int64())), ("error", pa.string())])
        for b in batches:
            out = []
            for name, data in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                try:
                    v, t = READERS[name](data)
                    t = t[((t >= 0) & (t < len(v))).all(axis=1)]
                    out.append({"vertices": v.astype(np.float64).ravel().tolist(), "indices": t.ravel().tolist(), "error": None})
                except UNREADABLE as e:
                    out.append({"vertices": None, "indices": None, "error": f"{type(e).__name__}: {e}"[:200]})
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, kind)], ["path", "mesh"])

    read = files.where(F.col("format").isin(*READERS)).select("path", "format", "content").mapInArrow(run, "path string, mesh struct<vertices: array<double>, indices: array<bigint>, error: string>")

    def triples(column: str, key: str, names: tuple[str, str, str]) -> DataFrame:
        groups = F.sequence(F.lit(0).cast("long"), F.floor(F.size(column) / 3) - 1)
        each = read.select("path", F.col(f"mesh.{column}").alias(column)).where(F.size(column) >= 3).withColumn(key, F.explode(groups))
        return each.select("path", key, *(F.col(column)[(F.col(key) * 3 + k).cast("int")].alias(n) for k, n in enumerate(names)))

    return triples("vertices", "vid", ("x", "y", "z")), triples("indices", "fid", ("i0", "i1", "i2")), read.select("path", F.col("mesh.error").alias("error")).where("error is not null")
