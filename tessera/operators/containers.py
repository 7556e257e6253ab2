"""Operators on container chunks (file_id, seq, tag, len), icon entries and encoding candidates."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import detect
from tessera.operators import rules
from tessera.sources.chunks import UNREADABLE, WALKERS, read_chunks
from tessera.sources.rasters import little_hex

PREFERRED = (16, 24, 32, 48, 64, 128, 256)


def keep_chunks(chunks: DataFrame, container: str, quality: int) -> DataFrame:
    """Chunks that the rules keep at that quality; of an animation's frames those after the twentieth need more."""
    table = rules.keep_rules(chunks.sparkSession).where(F.col("container") == container)
    named = table.where("tag <> '*'").select("tag", "min_quality")
    other = next(least for c, tag, least in rules.KEEP if c == container and tag == "*")
    judged = chunks.join(F.broadcast(named), "tag", "left").withColumn("least", F.coalesce("min_quality", F.lit(other)))
    if container == "webp_animated":
        frame = F.row_number().over(Window.partitionBy("file_id", "tag").orderBy("seq"))
        judged = judged.withColumn("least", F.when((F.col("tag") == "ANMF") & (frame > rules.FRAMES), rules.MORE_FRAMES).otherwise(F.col("least")))
    return judged.where(F.col("least") <= quality).select(*chunks.columns)


def container_size(chunks: DataFrame) -> DataFrame:
    """file_id, kept_bytes (payloads, headers of eight bytes, padding to even) and kept."""
    return chunks.groupBy("file_id").agg(F.sum(F.col("len") + 8 + F.col("len") % 2).alias("kept_bytes"), F.count("*").alias("kept"))


def critical_chunks(chunks: DataFrame) -> DataFrame:
    """A semi join with the tags that an image needs."""
    need = rules.keep_rules(chunks.sparkSession).where("container = 'png' and min_quality = 0").select("tag")
    return chunks.join(F.broadcast(need), "tag", "left_semi").select(*chunks.columns)


def is_animated(chunks: DataFrame, tag: str = "ANIM", frames: int = 1) -> DataFrame:
    """file_id, animated: at least so many chunks of the tag; an animated WebP has an ANIM, an animated GIF two images."""
    return chunks.groupBy("file_id").agg((F.count_if(F.col("tag") == tag) >= frames).alias("animated"))


def merge_equal_frames(frames: DataFrame) -> DataFrame:
    """frames (file_id, seq, hash, delay) -> runs of equal neighbours: file_id, seq of the first, hash, delay (their sum), frames."""
    by = Window.partitionBy("file_id").orderBy("seq")
    fresh = F.when(F.lag("hash").over(by).eqNullSafe(F.col("hash")) & F.lag("seq").over(by).isNotNull(), 0).otherwise(1)
    runs = frames.withColumn("fresh", fresh).withColumn("run", F.sum("fresh").over(by))
    return runs.groupBy("file_id", "run").agg(F.min("seq").alias("seq"), F.first("hash").alias("hash"), F.sum("delay").alias("delay"), F.count("*").alias("frames")).drop("run")


def kept_segments(data: bytes, quality: int) -> bytes:
    """A JPEG without the segments that the rules drop at that quality; the end marker is there, whether it was or not."""
    least = {t: q for c, t, q in rules.KEEP if c == "jpeg"}
    out, scan = b"\xff\xd8", False
    for tag, at, n in WALKERS["Jpeg"](data):
        if n < 0 or at + n > len(data):
            raise ValueError(f"{tag} at {at} claims {n} bytes")
        scan |= tag == "SOS"
        if tag not in ("SOI", "EOI") and least.get(tag, least["*"]) <= quality:
            out += data[at - 4 : at + n]
    if not scan:
        raise ValueError("no scan")
    return out + b"\xff\xd9"


def kept_riff(data: bytes, quality: int, container: str = "webp") -> bytes:
    """A WebP file of the chunks that the rules keep at that quality, padded to even, with a size that is right."""
    if data[:4] != b"RIFF" or data[8:12] != b"WEBP":
        raise ValueError("no WebP")
    least, frames, out = {t: q for c, t, q in rules.KEEP if c == container}, 0, b"WEBP"
    for tag, at, n in WALKERS["WebP"](data):
        if at + n > len(data):
            raise ValueError(f"{tag} at {at} claims {n} bytes")
        frames += tag == "ANMF"
        more = container == "webp_animated" and tag == "ANMF" and frames > rules.FRAMES
        if (rules.MORE_FRAMES if more else least.get(tag, least["*"])) <= quality:
            out += data[at - 8 : at + n] + b"\0" * (n % 2)
    return b"RIFF" + len(out).to_bytes(4, "little") + out


def rewritten(files: DataFrame, quality: int) -> DataFrame:
    """files (path, format, content) of JPEG and WebP -> path, content, error: what the rules keep, as a file; a file that can't be read has an error and no content."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out, errors = [], []
            for name, data in zip(b.column(1).to_pylist(), b.column(2), strict=True):
                data = data.as_py() or b""
                try:
                    animated = name == "WebP" and any(t == "ANIM" for t, _, _ in WALKERS["WebP"](data))
                    out.append(kept_segments(data, quality) if name == "Jpeg" else kept_riff(data, quality, "webp_animated" if animated else "webp"))
                    errors.append(None)
                except UNREADABLE as e:
                    out.append(None)
                    errors.append(f"{type(e).__name__}: {e}"[:200])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.binary()), pa.array(errors, pa.string())], ["path", "content", "error"])

    return files.where(F.col("format").isin("Jpeg", "WebP")).select("path", "format", "content").mapInArrow(run, "path string, content binary, error string")


def first_icons(icons: DataFrame) -> DataFrame:
    """icons (file_id, idx, w, h, bpp): the first entry of each size and depth."""
    rank = F.row_number().over(Window.partitionBy("file_id", "w", "h", "bpp").orderBy("idx"))
    return icons.withColumn("_k", rank).where("_k = 1").drop("_k")


def dedup_icons(icons: DataFrame, quality: int) -> DataFrame:
    """At quality 60 or less the first of each size and depth; of sizes that are not preferred only those with fewer than four entries kept before them.

    Entries kept before an entry of any size: the preferred ones so far, and
    the others so far, of which no more are kept once four entries are.
    """
    if quality > 60:
        return icons
    first = first_icons(icons).withColumn("preferred", F.col("w").isin(*PREFERRED) & (F.col("w") == F.col("h")))
    by = Window.partitionBy("file_id").orderBy("idx").rowsBetween(Window.unboundedPreceding, -1)
    return first.withColumn("before", F.count("*").over(by)).where("preferred or before < 4").select(*icons.columns)


def smallest(candidates: DataFrame) -> DataFrame:
    """candidates (file_id, ordinal, len, ...): the shortest of each file, ties to the lower ordinal. The original has ordinal 0, so nothing grows."""
    rest = [c for c in candidates.columns if c != "file_id"]
    best = candidates.groupBy("file_id").agg(F.min_by(F.struct(*rest), F.struct("len", "ordinal")).alias("best"))
    return best.select("file_id", *(F.col(f"best.{c}").alias(c) for c in rest))


def plan_candidates(files: DataFrame) -> DataFrame:
    """files (file_id, format, quality, lossless) -> a row for each strategy that their quality allows."""
    table = rules.strategies(files.sparkSession)
    return files.join(F.broadcast(table), "format").where("quality between low and high and (lossless_ok or not lossless)").select("file_id", "format", "quality", "strategy")


def route(family: Column, size: Column) -> Column:
    """Which path an asset takes: meshes go to theirs at any size; images by size."""
    return F.when(family == "mesh", "mesh").when(size > 2 * 1024 * 1024, "aggressive").when(size > 100_000, "fast").otherwise("full")


# ---- whole files ----


def strip_gif(files: DataFrame, drop: tuple[str, ...] = ("COMMENT", "APP")) -> DataFrame:
    """files (path, content) of GIF -> path, content without blocks of those kinds; frames, delays and colours stay as they are."""
    blocks = read_chunks(files.select("path", F.lit("Gif").alias("format"), "content"), payload=False).where("error is null")
    # A block begins one byte (images, the trailer) or two bytes (extensions) before what the walker calls its payload.
    lead = F.when(F.col("tag").isin("IMAGE", "TRAILER"), 1).otherwise(2)
    piece = F.struct("seq", (F.col("offset") - lead + 1).cast("int").alias("start"), (F.col("len") + lead).cast("int").alias("size"))
    kept = blocks.groupBy("path").agg((F.min(F.col("offset") - lead)).cast("int").alias("head"), F.array_sort(F.collect_list(F.when(~F.col("tag").isin(*drop), piece))).alias("pieces"))
    body = F.array_join(F.transform("pieces", lambda p: F.hex(F.substring("content", p["start"], p["size"]))), "")
    return files.join(kept, "path").select("path", F.unhex(F.concat(F.hex(F.substring("content", F.lit(1), F.col("head"))), body)).alias("content"))


def serialize_icons(entries: DataFrame) -> DataFrame:
    """entries (file_id, idx, w, h, bpp, data) -> file_id, content: an ICO file, its entries in order of idx, offsets counted anew."""
    by = Window.partitionBy("file_id")
    before = F.coalesce(F.sum(F.length("data")).over(by.orderBy("idx").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = entries.withColumn("n", F.count("*").over(by)).withColumn("at", 6 + 16 * F.col("n") + before)
    side = lambda c: little_hex(F.col(c) % 256, 1)
    entry = F.concat(side("w"), side("h"), F.lit("00000100"), little_hex(F.col("bpp"), 2), little_hex(F.length("data"), 4), little_hex(F.col("at"), 4))
    whole = placed.groupBy("file_id").agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct("idx", entry.alias("entry"), F.hex("data").alias("data")))).alias("e"))
    return whole.select("file_id", F.unhex(F.concat(F.lit("00000100"), little_hex(F.col("n"), 2), F.array_join(F.col("e.entry"), ""), F.array_join(F.col("e.data"), ""))).alias("content"))


def parse_icons(files: DataFrame) -> DataFrame:
    """files (path, content) of ICO -> path, seq, w, h, bpp, data."""
    found = read_chunks(files.select("path", F.lit("Ico").alias("format"), "content")).where("error is null")
    size = F.split("tag", "x")
    return found.select("path", "seq", *(size[k].cast("long").alias(c) for k, c in enumerate(("w", "h", "bpp"))), F.col("payload").alias("data"))


def dib_to_bmp(dib: Column) -> Column:
    """An icon's bitmap as a BMP file: a file header in front, and half the height, for the mask beneath is none of the image."""
    depth, colors = detect.little(dib, 14, 2), detect.little(dib, 32, 4)
    palette = F.when(depth <= 8, 4 * F.when(colors > 0, colors).otherwise(F.pow(F.lit(2.0), depth).cast("long"))).otherwise(F.lit(0))
    head = F.concat(F.lit("424D"), little_hex(F.length(dib) + 14, 4), F.lit("00000000"), little_hex(14 + detect.little(dib, 0, 4) + palette, 4))
    rest = F.concat(F.hex(F.substring(dib, 1, 8)), little_hex(F.floor(detect.little(dib, 8, 4) / 2), 4), F.hex(F.substring(dib, F.lit(13), F.length(dib))))
    return F.unhex(F.concat(head, rest))


def webp_size(content: Column) -> tuple[Column, Column]:
    """Width and height by the first chunk: VP8X, VP8L or VP8; null for any other file."""
    kind, bits = F.hex(F.substring(content, 13, 4)), detect.little(content, 21, 4)

    def of(wide: Column, lossless: Column, lossy: Column) -> Column:
        return F.when(detect.is_webp(content), F.when(kind == "56503858", wide).when(kind == "5650384C", lossless).when(kind == "56503820", lossy))

    width = of(detect.little(content, 24, 3) + 1, bits % 16384 + 1, detect.little(content, 26, 2) % 16384)
    return width, of(detect.little(content, 27, 3) + 1, F.floor(bits / 16384) % 16384 + 1, detect.little(content, 28, 2) % 16384)
