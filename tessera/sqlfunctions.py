"""The library's verbs as functions of a session, so that SQL can call them.

    register(spark)
    spark.sql("select path, detect_format(content), optimized(content, 80) from files")
"""

from __future__ import annotations

import contextlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf
from pyspark.sql.types import BinaryType, DoubleType, LongType, StringType, StructField, StructType

from tessera.operators import optimize
from tessera.sources.chunks import WALKERS
from tessera.sources.meshes import READERS
from tessera.sources.rasters import UNREADABLE

#: First bytes, in hexadecimal digits, by which SQL tells formats apart.
_HEADS = {
    "is_png": "hex(substring(content, 1, 8)) = '89504E470D0A1A0A'", "is_jpeg": "hex(substring(content, 1, 3)) = 'FFD8FF'", "is_webp": "hex(substring(content, 1, 4)) = '52494646' and hex(substring(content, 9, 4)) = '57454250'",
    "is_gif": "hex(substring(content, 1, 6)) in ('474946383761', '474946383961')", "is_bmp": "hex(substring(content, 1, 2)) = '424D'", "is_tiff": "hex(substring(content, 1, 4)) in ('49492A00', '4D4D002A')",
    "is_ico": "hex(substring(content, 1, 4)) = '00000100'", "is_glb": "hex(substring(content, 1, 4)) = '676C5446'", "is_ply": "hex(substring(content, 1, 4)) = '706C790A' or hex(substring(content, 1, 5)) = '706C790D0A'",
    "is_fbx": "decode(substring(content, 1, 32), 'ISO-8859-1') rlike '^(Kaydara FBX Binary|Autodesk FBX|; FBX )'", "is_obj": "decode(substring(content, 1, 512), 'ISO-8859-1') rlike '(?m)^(v|vn|vt|f) [-0-9+.]'",
}


@F.pandas_udf(BinaryType())
def _optimized(content: pd.Series, quality: pd.Series) -> pd.Series:
    """The shorter form of a file that a parser knows; else the file."""

    def one(data: bytes | None, q: int) -> bytes | None:
        if data is None:
            return None
        data = bytes(data)
        kind = next((k for k, head in (("Png", b"\x89PNG"), ("Bmp", b"BM"), ("Gif", b"GIF8"), ("Glb", b"glTF"), ("Svg", b"<svg"), ("Svg", b"<?xml"), ("Gltf", b"{")) if data.lstrip().startswith(head)), None)
        try:
            made = optimize._parsed(kind, data, q)[1] if kind else data
        except UNREADABLE:
            made = data
        return made if len(made) < len(data) else data

    return pd.Series([one(c, int(q)) for c, q in zip(content, quality, strict=True)])


@udtf(returnType=StructType([StructField("seq", LongType()), StructField("tag", StringType()), StructField("offset", LongType()), StructField("len", LongType())]))
class ParseChunks:
    """The chunks of one container file, as far as it can be read."""

    def eval(self, content: bytes, format: str) -> Iterator[tuple]:  # noqa: A002
        if content is not None and format in WALKERS:
            with contextlib.suppress(*UNREADABLE):
                for seq, (tag, offset, n) in enumerate(WALKERS[format](bytes(content))):
                    yield seq, tag, offset, n


@udtf(returnType=StructType([StructField("kind", StringType()), StructField("id", LongType()), *(StructField(c, DoubleType()) for c in "abc")]))
class ParseMesh:
    """The vertices and triangles of one mesh file of a binary or tree format; no row for a file that can't be read."""

    def eval(self, content: bytes, format: str) -> Iterator[tuple]:  # noqa: A002
        if content is not None and format in READERS:
            try:
                points, corners = READERS[format](bytes(content))
            except UNREADABLE:
                return
            for kind, rows in (("v", points), ("f", corners)):
                for k, (a, b, c) in enumerate(rows.tolist()):
                    yield kind, k, float(a), float(b), float(c)


def register(spark: SparkSession) -> list[str]:
    """Registers the functions with the session and gives their names. Format tests are SQL and stay in the JVM."""
    names = list(_HEADS)
    for name, rule in _HEADS.items():
        spark.sql(f"create or replace temporary function {name}(content binary) returns boolean return coalesce({rule}, false)")
    images = [("Png", "is_png"), ("Jpeg", "is_jpeg"), ("WebP", "is_webp"), ("Gif", "is_gif"), ("Bmp", "is_bmp"), ("Tiff", "is_tiff"), ("Ico", "is_ico")]
    meshes = [("Glb", "is_glb"), ("Ply", "is_ply"), ("Fbx", "is_fbx"), ("Obj", "is_obj")]
    cases = " ".join(f"when {rule} then '{family}:{k}'" for family, rules in (("image", images), ("mesh", meshes)) for k, f in rules for rule in (f"coalesce({_HEADS[f]}, false)",))
    spark.sql(f"create or replace temporary function detect_format(content binary) returns string return case {cases} else 'unknown' end")
    spark.udf.register("optimized", _optimized)
    spark.udtf.register("parse_chunks", ParseChunks)
    spark.udtf.register("parse_mesh", ParseMesh)
    return [*names, "detect_format", "optimized", "parse_chunks", "parse_mesh"]
