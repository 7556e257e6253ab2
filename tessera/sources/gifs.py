"""GIF with several images: LZW codes that grow, delays, equal frames merged, and the reading of all of it.

Frames are rows (file_id, seq, delay, w, data), data being the colours of the
pixels as 24-bit numbers; which frames repeat the one before is decided on
digests, and only the bytes of one file are put together in one value.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.sources.chunks import UNREADABLE, WALKERS

#: Codes of a table; the longest code.
TABLE, LONGEST = 4096, 12
#: The block that lets an animation begin anew for ever (fixed value).
FOREVER = b"\x21\xff\x0bNETSCAPE2.0\x03\x01\x00\x00\x00"


def lzw(index: np.ndarray, size: int) -> bytes:
    """Codes of the indices, of `size` + 1 bits at first; the table starts anew when it is full."""
    clear, end = 1 << size, (1 << size) + 1
    codes, widths = [clear], [size + 1]
    table: dict[int, int] = {}
    known, width, last = end + 1, size + 1, -1
    for byte in index.tolist():
        if last < 0:
            last = byte
            continue
        longer = table.get(last << 8 | byte)
        if longer is not None:
            last = longer
            continue
        codes.append(last)
        widths.append(width)
        table[last << 8 | byte] = known
        known += 1
        # A reader knows one entry less, and grows when that many fill its codes.
        if known > 1 << width and width < LONGEST:
            width += 1
        if known == TABLE:
            codes.append(clear)
            widths.append(width)
            table, known, width = {}, end + 1, size + 1
        last = byte
    if last >= 0:
        codes.append(last)
        widths.append(width)
        known += 1
        if known > 1 << width and width < LONGEST:
            width += 1
    codes.append(end)
    widths.append(width)
    code, bits = np.array(codes, np.int64), np.array(widths, np.int64)
    place = np.arange(int(bits.sum())) - np.repeat(np.cumsum(bits) - bits, bits)
    return np.packbits(((np.repeat(code, bits) >> place) & 1).astype(np.uint8), bitorder="little").tobytes()


def _image(index: np.ndarray, size: int) -> bytes:
    data = lzw(index.reshape(-1), size)
    blocks = b"".join(bytes([len(data[i : i + 255])]) + data[i : i + 255] for i in range(0, len(data), 255))
    return b"\x2c" + struct.pack("<HHHHB", 0, 0, index.shape[1], index.shape[0], 0) + bytes([size]) + blocks + b"\0"


def gif_file(frames: list[tuple[np.ndarray, int]], palette: np.ndarray) -> bytes:
    """Frames (indices (h, w), delay in hundredths) of one size and a palette (n, 3) of 256 colours at most; several frames repeat for ever."""
    h, w = frames[0][0].shape
    size = max(2, int(len(palette) - 1).bit_length())
    table = np.zeros((1 << size, 3), np.uint8)
    table[: len(palette)] = palette
    out = b"GIF89a" + struct.pack("<HHBBB", w, h, 0xF0 | (size - 1), 0, 0) + table.tobytes()
    if len(frames) > 1:
        out += FOREVER + b"".join(b"\x21\xf9\x04\x04" + struct.pack("<HBB", delay, 0, 0) + _image(index, size) for index, delay in frames)
    else:
        out += _image(frames[0][0], size)
    return out + b"\x3b"


def _unpacked(data: bytes, size: int, count: int) -> np.ndarray:
    """The indices that LZW codes of GIF stand for, `count` at most."""
    clear, end = 1 << size, (1 << size) + 1
    table: list[bytes] = []
    width, last, buffer, held, out, n = size + 1, None, 0, 0, [], 0
    for byte in data:
        buffer |= byte << held
        held += 8
        while held >= width and n < count:
            code, buffer, held = buffer & ((1 << width) - 1), buffer >> width, held - width
            if code == end:
                return np.frombuffer(b"".join(out), np.uint8)[:count]
            if code == clear:
                table, width, last = [bytes([k]) for k in range(clear)] + [b"", b""], size + 1, None
                continue
            if last is None:
                entry = table[code]
            else:
                entry = table[code] if code < len(table) else last + last[:1]
                if len(table) < 4096:
                    table.append(last + entry[:1])
                    if len(table) == 1 << width and width < 12:
                        width += 1
            out.append(entry)
            n, last = n + len(entry), entry
    return np.frombuffer(b"".join(out), np.uint8)[:count]


def each_frame(data: bytes) -> Iterator[tuple[np.ndarray, int]]:
    """(canvas (h, w, 4), delay) of every image of a GIF, each drawn over the one before; not interlaced."""
    if data[:6] not in (b"GIF87a", b"GIF89a"):
        raise ValueError("no GIF")
    w, h, flags = struct.unpack_from("<HHB", data, 6)
    shared = np.frombuffer(data, np.uint8, 3 << ((flags & 7) + 1), 13).reshape(-1, 3) if flags & 0x80 else None
    canvas, delay, seen = np.zeros((h, w, 4), np.uint8), 0, -1
    for tag, at, _ in WALKERS["Gif"](data):
        if tag == "GCE":
            delay, seen = struct.unpack_from("<H", data, at + 2)[0], data[at + 4] if data[at + 1] & 1 else -1
        if tag != "IMAGE":
            continue
        left, top, iw, ih, local = struct.unpack_from("<HHHHB", data, at)
        if local & 0x40:
            raise ValueError("only images that are not interlaced")
        at, own = at + 9, shared
        if local & 0x80:
            own = np.frombuffer(data, np.uint8, 3 << ((local & 7) + 1), at).reshape(-1, 3)
            at += 3 << ((local & 7) + 1)
        if own is None:
            raise ValueError("no colours")
        size, at, packed = data[at], at + 1, bytearray()
        while data[at]:
            packed += data[at + 1 : at + 1 + data[at]]
            at += 1 + data[at]
        index = _unpacked(bytes(packed), size, iw * ih)
        if len(index) < iw * ih:
            raise ValueError("fewer pixels than the image has")
        index = index.reshape(ih, iw)
        shown = index != seen
        part = canvas[top : top + ih, left : left + iw]
        part[shown] = np.concatenate([own, np.full((len(own), 1), 255, np.uint8)], axis=1)[index[shown]]
        yield canvas.copy(), delay
        delay, seen = 0, -1


def merged(frames: DataFrame) -> DataFrame:
    """frames (file_id, seq, delay, digest, ...) without those that repeat the frame before; their delays go to the one that stays."""
    order = Window.partitionBy("file_id").orderBy("seq")
    fresh = F.when(F.lag("digest").over(order).eqNullSafe(F.col("digest")) & (F.row_number().over(order) > 1), 0).otherwise(1)
    grouped = frames.withColumn("_fresh", fresh).withColumn("_group", F.sum("_fresh").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    total = grouped.groupBy("file_id", "_group").agg(F.sum("delay").alias("_delay"))
    return grouped.where("_fresh = 1").join(total, ["file_id", "_group"]).withColumn("delay", F.col("_delay")).select(*frames.columns)


def write_animations(frames: DataFrame) -> DataFrame:
    """frames (file_id bigint, seq, delay, w, data array of 24-bit colours) -> file_id, content, frames: GIF files of the frames that differ from the one before; null content for more than 256 colours, unequal sizes or a delay beyond two bytes."""
    digest = F.sha2(F.concat_ws(":", "w", F.array_join(F.col("data").cast("array<string>"), ",")), 256)
    kept = merged(frames.select("file_id", "seq", "delay", "w", "data", digest.alias("digest")))
    files = kept.groupBy("file_id").agg(F.array_sort(F.collect_list(F.struct("seq", "delay", "w", "data"))).alias("f"), F.count("*").alias("frames"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for own in b.column(1):
                data = [np.asarray(f["data"].values.to_numpy(zero_copy_only=False), np.int64) for f in own]
                wide, delays = [f["w"].as_py() for f in own], [f["delay"].as_py() for f in own]
                colors, index = np.unique(np.concatenate(data), return_inverse=True)
                if len(colors) > 256 or len({(len(x), w) for x, w in zip(data, wide, strict=True)}) > 1 or max(delays) > 0xFFFF:
                    out.append(None)
                    continue
                palette = np.stack([(colors >> s) & 255 for s in (16, 8, 0)], axis=1).astype(np.uint8)
                out.append(gif_file([(x.reshape(-1, wide[0]), t) for x, t in zip(index.reshape(len(data), -1), delays, strict=True)], palette))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.binary()), b.column(2)], ["file_id", "content", "frames"])

    return files.select("file_id", "f", "frames").mapInArrow(run, "file_id bigint, content binary, frames bigint")


def read_animations(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """files (path, content) -> frames (path, seq, delay, w, data), errors (path, error)."""
    kind = pa.list_(pa.struct([("seq", pa.int64()), ("delay", pa.int64()), ("w", pa.int64()), ("data", pa.list_(pa.int64()))]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out, errors = [], []
            for data in b.column(1):
                try:
                    got = list(each_frame(data.as_py() or b""))
                    out.append([{"seq": k, "delay": t, "w": x.shape[1], "data": x[:, :, :3].reshape(-1, 3).astype(np.int64) @ np.array([65536, 256, 1])} for k, (x, t) in enumerate(got)])
                    errors.append(None)
                except UNREADABLE as e:
                    out.append(None)
                    errors.append(f"{type(e).__name__}: {e}"[:200])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, kind), pa.array(errors, pa.string())], ["path", "f", "error"])

    read = files.select("path", "content").mapInArrow(run, "path string, f array<struct<seq: bigint, delay: bigint, w: bigint, data: array<bigint>>>, error string")
    return read.select("path", F.explode("f").alias("e")).select("path", "e.seq", "e.delay", "e.w", "e.data"), read.where("error is not null").select("path", "error")
