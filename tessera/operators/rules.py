"""Rule tables: formats, quality ladders, and the quality from which a container keeps a chunk. All are a few rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Never kept.
NEVER = 101
#: container, tag, least quality that keeps it (fixed values); "*" is any tag that is not listed.
KEEP = (
    *(("png", t, 0) for t in ("IHDR", "PLTE", "IDAT", "IEND", "tRNS", "sRGB", "gAMA")), ("png", "*", NEVER),
    *(("webp", t, 0) for t in ("VP8 ", "VP8L", "ALPH", "VP8X", "ANIM", "ANMF")), ("webp", "ICCP", 80), ("webp", "EXIF", 90), ("webp", "XMP ", NEVER), ("webp", "*", NEVER),
    *(("webp_animated", t, 0) for t in ("VP8X", "ANIM", "VP8 ", "VP8L", "ALPH", "ANMF")), ("webp_animated", "ICCP", 80), ("webp_animated", "EXIF", 90), ("webp_animated", "XMP ", 90), ("webp_animated", "*", 70),
    *(("webp_meta_only", t, NEVER) for t in ("EXIF", "XMP ")), ("webp_meta_only", "*", 0),
    *(("webp_aggressive", t, 0) for t in ("VP8X", "VP8 ", "VP8L", "ALPH", "ANIM", "ANMF")), ("webp_aggressive", "*", NEVER),
    *(("jpeg", t, 0) for t in ("SOI", "EOI", "SOS", "APP0", "SOF0", "SOF1", "SOF2", "SOF3", "DHT", "DQT", "DRI", "DNL")), ("jpeg", "APP1", 81),
    *(("jpeg", f"APP{k}", 91) for k in range(2, 16)), ("jpeg", "COM", 86), ("jpeg", "*", NEVER),
)
#: Frames of an animation that are kept at any quality, and the quality that keeps the others.
FRAMES, MORE_FRAMES = 20, 31

#: Upper quality of a band, inclusive, and the value that it gives; the last value is for the rest (fixed values).
LADDERS: dict[str, tuple[tuple[tuple[int, int], ...], int]] = {
    "aggressive_jpeg": (((20, 15), (40, 35), (60, 55), (80, 75)), 85),
    "jpeg_reencode": (((20, 15), (40, 30), (60, 50), (80, 70)), 85),
    "bmp_jpeg": (((20, 30), (35, 45), (49, 60), (60, 70), (70, 80)), 85),
    "bmp_colors": (((30, 64), (50, 128), (70, 256), (85, 512)), 1024),
    "tiff_jpeg": (((30, 40), (50, 60), (70, 75)), 85),
    "tiff_convert": (((30, 50), (50, 70), (70, 80)), 90),
    "webp_jpeg": (((20, 25), (40, 40), (60, 60), (80, 75)), 85),
    "webp_scale": (((20, 60), (40, 70), (60, 85)), 95),
    "bit_shift": (((20, 3), (40, 2)), 1),
}

#: name, extensions, MIME type, lossless, quality (fixed values).
IMAGE_FORMATS = (
    ("Png", "png", "image/png", True, False), ("Jpeg", "jpg,jpeg", "image/jpeg", False, True), ("WebP", "webp", "image/webp", True, True), ("Gif", "gif", "image/gif", True, False), ("Bmp", "bmp", "image/bmp", True, False),
    ("Tiff", "tiff,tif", "image/tiff", True, False), ("Ico", "ico", "image/x-icon", False, False), ("Svg", "svg", "image/svg+xml", False, False), ("Tga", "tga", "image/x-tga", True, False),
)
#: name, extensions, MIME type, binary, materials (fixed values).
MESH_FORMATS = (
    ("Obj", "obj", "model/obj", False, True), ("Gltf", "gltf", "model/gltf+json", False, True), ("Glb", "glb", "model/gltf-binary", True, True), ("Stl", "stl", "model/stl", True, False),
    ("Ply", "ply", "model/ply", True, False), ("Fbx", "fbx", "application/octet-stream", True, True),
)

#: format, name, textures, materials, animations, size to expect of the original's, ways to shorten it (fixed values).
MESH_INFO = (
    ("Obj", "Wavefront OBJ", True, True, False, 0.85, "Vertex welding|Normal recalculation|Mesh decimation"), ("Gltf", "GL Transmission Format", True, True, True, 0.75, "JSON minification|Buffer optimization|Mesh primitive merging"),
    ("Glb", "GL Transmission Format Binary", True, True, True, 0.95, "Conservative optimization|Metadata stripping"), ("Stl", "Stereolithography", False, False, False, 0.7, "Mesh decimation|Normal optimization|Binary conversion"),
    ("Ply", "Stanford Polygon Format", False, True, False, 0.8, "Property optimization|Binary conversion|Vertex welding"), ("Fbx", "Autodesk Filmbox", True, True, True, 0.9, "Conservative optimization|Metadata cleanup"),
)
#: Which encoders an image is tried with: format, animated, encoder, least and most quality; formats with a module of their own have one row (fixed values).
DISPATCH = (
    ("WebP", False, "webp", 0, 100), ("WebP", True, "webp", 0, 100), ("Svg", False, "svg", 0, 100), ("Ico", False, "ico", 0, 100), ("Tga", False, "tga", 0, 100), ("Png", False, "png", 0, 100), ("Jpeg", False, "jpeg", 0, 100), ("Tiff", False, "tiff", 0, 100),
    ("Gif", True, "gif", 0, 100), ("Gif", False, "png", 70, 100), ("Gif", False, "jpeg", 0, 85), ("Gif", False, "webp", 0, 80), ("Bmp", False, "png", 85, 100), ("Bmp", False, "jpeg", 0, 84),
)

#: format, strategy, least quality, most quality, where lossless is asked for: allowed (fixed values).
STRATEGIES = (
    ("Jpeg", "reencode", 0, 100, True), ("Jpeg", "webp", 0, 70, False), ("Jpeg", "png", 90, 100, True), ("Jpeg", "gray", 0, 60, False),
    ("Png", "reencode", 0, 100, True), ("Png", "palette", 0, 75, False),
    ("Tiff", "strip", 0, 100, True), ("Tiff", "lzw", 80, 100, True), ("Tiff", "colorspace", 0, 70, False), ("Tiff", "jpeg", 0, 75, False), ("Tiff", "png", 70, 100, True), ("Tiff", "webp", 0, 80, False),
    ("Gif", "strip", 0, 100, True), ("Gif", "palette", 0, 100, False), ("Gif", "png", 0, 70, False),
    ("Bmp", "png", 85, 100, True), ("Bmp", "jpeg", 0, 84, False),
)


def ladder(quality: Column, name: str) -> Column:
    bands, rest = LADDERS[name]
    out = F.when(quality <= bands[0][0], bands[0][1])
    for top, value in bands[1:]:
        out = out.when(quality <= top, value)
    return out.otherwise(rest)


def keep_rules(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(KEEP), "container string, tag string, min_quality int")


def formats(spark: SparkSession, rows: tuple = IMAGE_FORMATS) -> DataFrame:
    """One row for each extension: format, extension, mime, and two properties of the family."""
    names = "lossless boolean, quality boolean" if rows is IMAGE_FORMATS else "is_binary boolean, materials boolean"
    return spark.createDataFrame([(n, e, m, a, b) for n, es, m, a, b in rows for e in es.split(",")], f"format string, extension string, mime string, {names}")


def mesh_info(spark: SparkSession) -> DataFrame:
    """format, name, textures, materials, animations, typical_ratio, strategy: a row for each way to shorten a format."""
    rows = [(*row[:6], way) for row in MESH_INFO for way in row[6].split("|")]
    return spark.createDataFrame(rows, "format string, name string, textures boolean, materials boolean, animations boolean, typical_ratio double, strategy string")


def dispatch(files: DataFrame) -> DataFrame:
    """files (file_id, format, animated, quality) -> a row for each encoder that an image is tried with; formats that do not move count as not animated."""
    table = files.sparkSession.createDataFrame(list(DISPATCH), "format string, animated boolean, encoder string, low int, high int")
    moving = F.col("animated") & F.col("format").isin("Gif", "WebP")
    return files.withColumn("animated", moving).join(F.broadcast(table), ["format", "animated"]).where("quality between low and high").select("file_id", "format", "animated", "quality", "encoder")


def fast_path(format: Column, animated: Column, quality: Column) -> tuple[Column, Column]:  # noqa: A002
    """Encoder and quality for files that are too large for a search: animations stay, a still GIF becomes PNG, all others JPEG at eight tenths of the quality."""
    encoder = F.when(animated & format.isin("Gif", "WebP"), "keep").when(format == "Gif", "png").otherwise("jpeg")
    return encoder, F.when(encoder == "jpeg", F.floor(quality * 0.8)).otherwise(quality).cast("long")


def action(wanted: Column, found: Column) -> Column:
    """What a request for a format does to a file of a format: names are compared without regard to case."""
    return F.when(F.lower(wanted) == "auto", "optimize_auto").when(F.lower(wanted) == F.lower(found), F.concat(F.lit("optimize_"), F.lower(found))).otherwise(F.concat(F.lit("convert_to_"), F.lower(wanted)))


def strategies(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(STRATEGIES), "format string, strategy string, low int, high int, lossless_ok boolean")
