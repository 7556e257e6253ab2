"""From any file to the shortest form of it that shows the same: detection, candidates by format, and the least of them."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StringType, StructField, StructType

from tessera.functions import detect, markup
from tessera.sources import rasters
from tessera.sources.chunks import WALKERS

#: Blocks of a GIF that show nothing.
GIF_DROPPED = ("COMMENT", "APP")
#: Up to this quality glTF loses what a viewer does not need.
PRUNED = 90


def strip_gif(data: bytes) -> bytes:
    """A GIF without comments and application blocks."""
    out, at = b"", None
    for tag, offset, n in WALKERS["Gif"](data):
        start = offset - (1 if tag in ("IMAGE", "TRAILER") else 2)
        at = start if at is None else at
        out += b"" if tag in GIF_DROPPED else data[start : offset + n]
    if at is None:
        raise ValueError("no block")
    return data[:at] + out


def shortest_png(kind: str, data: bytes) -> tuple[str, bytes]:
    x = rasters.READERS[kind](data)
    made = [(f"png-{form}-{f}", rasters.png_bytes(own, f, palette)) for form, own, palette in rasters.forms(x) for f in rasters.FILTERS]
    return min(made, key=lambda c: len(c[1]))


def _parsed(kind: str, data: bytes, quality: int) -> tuple[str, bytes]:
    if kind == "Gif":
        return "strip-blocks", strip_gif(data)
    if kind in rasters.READERS:
        return shortest_png(kind, data)
    if kind == "Svg":
        return "prune-svg", markup.prune_svg(data, quality)
    if kind == "Glb":
        return "prune-json", markup.prune_glb(data, quality < PRUNED)
    return "prune-json", markup.compact_json(data, quality < PRUNED)


#: Formats that a parser shortens, one file at a time; texts of lines are Column expressions.
PARSED = ("Png", "Bmp", "Tga", "Tiff", "Gif", "Svg", "Glb", "Gltf")


@F.pandas_udf(StructType([StructField("strategy", StringType()), StructField("content", BinaryType())]))
def _parse(kind: pd.Series, content: pd.Series, quality: pd.Series) -> pd.DataFrame:
    """A file that can't be read, and one of no such format, gives nulls."""
    rows: list[tuple] = []
    for k, data, q in zip(kind, content, quality, strict=True):
        try:
            rows.append(_parsed(k, bytes(data), int(q)) if k is not None and data is not None else (None, None))
        except rasters.UNREADABLE:
            rows.append((None, None))
    return pd.DataFrame(rows, columns=["strategy", "content"])


def optimize(files: DataFrame, quality: Column | int = 80) -> DataFrame:
    """files (path, content) -> path, format, strategy, content, original_size, optimized_size.

    The candidate of a file's format is taken if it is shorter; else the file
    stays as it is, under the strategy `keep`. So do files of unknown format,
    null and empty ones, and those that can't be read. BMP, TGA and TIFF become PNG.
    """
    quality = F.lit(quality) if isinstance(quality, int) else quality
    found = detect.detect_format(F.col("content"))
    typed = files.select("path", "content", F.coalesce(found, F.lit("unknown")).alias("format"), quality.cast("int").alias("_quality")).withColumn("_kind", F.element_at(F.split("format", ":"), -1))
    known = F.when(F.col("_kind").isin(*PARSED), F.col("_kind"))
    text = F.decode("content", "UTF-8")
    texts = {"Obj": markup.slim_obj, "Ply": markup.slim_ply, "Stl": markup.slim_stl, "Fbx": markup.slim_fbx}
    valid = F.is_valid_utf8(F.col("content").cast("string")) & ~F.contains(text, F.lit("\0"))
    lines = F.lit(None).cast("string")
    for kind, slim in texts.items():
        lines = F.when((F.col("_kind") == kind) & valid, slim(text)).otherwise(lines)
    parsed = typed.withColumn("_p", _parse(known, F.when(known.isNotNull(), F.col("content")), F.col("_quality"))).withColumn("_t", F.encode(lines, "UTF-8"))
    made = F.coalesce(F.col("_p.content"), F.col("_t"))
    shorter = F.length(made) < F.length("content")
    return parsed.select(
        "path", "format", F.when(shorter, F.coalesce(F.col("_p.strategy"), F.lit("slim-lines"))).otherwise("keep").alias("strategy"), F.when(shorter, made).otherwise(F.col("content")).alias("content"),
        F.length("content").cast("long").alias("original_size"), F.when(shorter, F.length(made)).otherwise(F.length("content")).cast("long").alias("optimized_size"),
    )
