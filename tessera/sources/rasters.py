"""Images as files: pixels (img_id, y, x, r, g, b, a) to one row (img_id, content) for each image, and back.

BMP and TGA hold their pixels as they are and are put together by Spark's own
functions; PNG is filtered with numpy and deflated in Arrow tasks.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.sources import gifs, jpegs, tiffs
from tessera.sources.chunks import UNREADABLE

PNG_MAGIC = b"\x89PNG\r\n\x1a\n"
#: Channels of a PNG's colour types (fixed values).
PNG_CHANNELS = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}
#: First column and row of the passes of an interlaced PNG, and their steps (fixed values).
ADAM7 = ((0, 0, 8, 8), (4, 0, 8, 8), (0, 4, 4, 8), (2, 0, 4, 4), (0, 2, 2, 4), (1, 0, 2, 2), (0, 1, 1, 2))
#: Pixels of images, or bytes of files, that a task gives on at once: a batch of rows may hold many times as many.
AT_ONCE = 1 << 20
FILTERS = ("none", "sub", "up", "average", "paeth", "adaptive")


# ---- uncompressed formats, by Spark's functions ----


def little_hex(n: Column, width: int) -> Column:
    """Hexadecimal digits of a number in `width` bytes, the lowest first."""
    return F.concat(*(F.lpad(F.hex(F.floor(n / (1 << 8 * k)).cast("long") % 256), 2, "0") for k in range(width)))


def _rows(pixels: DataFrame, channels: str) -> DataFrame:
    """img_id, w, h, rows: for each row, from the top, the hexadecimal digits of its pixels."""
    one = F.concat(*(F.lpad(F.hex(F.col(c)), 2, "0") for c in channels))
    rows = pixels.groupBy("img_id", "y").agg(F.array_sort(F.collect_list(F.struct("x", one.alias("s")))).alias("p"))
    rows = rows.select("img_id", "y", F.size("p").cast("long").alias("w"), F.array_join(F.col("p.s"), "").alias("s"))
    whole = rows.groupBy("img_id").agg(F.max("w").alias("w"), F.count("*").alias("h"), F.array_sort(F.collect_list(F.struct("y", "s"))).alias("rows"))
    return whole.select("img_id", "w", "h", F.col("rows.s").alias("rows"))


def write_bmp(pixels: DataFrame) -> DataFrame:
    """24-bit BMP, rows from below, each padded to four bytes. Images must have whole rows."""
    image = _rows(pixels, "bgr")
    w, h = F.col("w"), F.col("h")
    pad = (4 - w * 3 % 4) % 4
    size = h * (w * 3 + pad)
    zero = F.lit(0).cast("long")
    head = F.concat(F.lit("424D"), little_hex(54 + size, 4), little_hex(zero, 4), little_hex(F.lit(54), 4), little_hex(F.lit(40), 4), little_hex(w, 4), little_hex(h, 4), F.lit("01001800"), little_hex(zero, 4), little_hex(size, 4), F.lit("00" * 16))
    padded = F.transform(F.reverse("rows"), lambda s: F.concat(s, F.repeat(F.lit("00"), pad.cast("int"))))
    return image.select("img_id", F.unhex(F.concat(head, F.array_join(padded, ""))).alias("content"))


def write_tga(pixels: DataFrame) -> DataFrame:
    """Uncompressed 32-bit TGA, rows from above."""
    image = _rows(pixels, "bgra")
    head = F.concat(F.lit("00" * 2 + "02" + "00" * 9), little_hex(F.col("w"), 2), little_hex(F.col("h"), 2), F.lit("2028"))
    return image.select("img_id", F.unhex(F.concat(head, F.array_join("rows", ""))).alias("content"))


# ---- PNG ----


def _left(x: np.ndarray) -> np.ndarray:
    return np.pad(x, ((0, 0), (1, 0), (0, 0)))[:, :-1]


def _up(x: np.ndarray) -> np.ndarray:
    return np.pad(x, ((1, 0), (0, 0), (0, 0)))[:-1]


def _paeth(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
    a, b, c = (v.astype(np.int16) for v in (a, b, c))
    p = a + b - c
    da, db, dc = abs(p - a), abs(p - b), abs(p - c)
    return np.where((da <= db) & (da <= dc), a, np.where(db <= dc, b, c)).astype(np.uint8)


def _filtered_by(x: np.ndarray, k: int) -> np.ndarray:
    if k == 0:
        return x
    if k == 1:
        return x - _left(x)
    if k == 2:
        return x - _up(x)
    left, up = _left(x), _up(x)
    return x - (((left.astype(np.uint16) + up) // 2).astype(np.uint8) if k == 3 else _paeth(left, up, _left(up)))


def filtered(x: np.ndarray, name: str) -> tuple[np.ndarray, np.ndarray]:
    """x (h, w, channels) of bytes -> the filter of each row, and the filtered rows."""
    if name != "adaptive":
        k = FILTERS.index(name)
        return np.full(len(x), k, np.uint8), _filtered_by(x, k)
    every = [_filtered_by(x, k) for k in range(5)]
    # The filter whose bytes, as signed numbers, are least in sum.
    cost = np.array([abs(e.astype(np.int8).astype(np.int64)).reshape(len(x), -1).sum(axis=1) for e in every])
    best = cost.argmin(axis=0)
    return best.astype(np.uint8), np.stack(every)[best, np.arange(len(x))]


def _chunk(tag: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + tag + data + struct.pack(">I", zlib.crc32(tag + data))


def _packed(samples: np.ndarray, depth: int) -> np.ndarray:
    """(h, w, channels) of samples -> (h, units, bytes of a unit): a unit is a pixel, or a byte where pixels are smaller."""
    h, w, n = samples.shape
    if depth == 8:
        return samples.astype(np.uint8)
    if depth == 16:
        return samples.astype(">u2").view(np.uint8).reshape(h, w, 2 * n)
    bits = ((samples.reshape(h, w * n, 1).astype(np.uint8) >> np.arange(depth - 1, -1, -1, dtype=np.uint8)) & 1).reshape(h, -1)
    return np.packbits(bits, axis=1)[:, :, None]


def _unpacked_samples(lines: np.ndarray, w: int, channels: int, depth: int) -> np.ndarray:
    """Rows of bytes -> (h, w, channels) of samples."""
    h = len(lines)
    if depth == 8:
        return lines.reshape(h, w, channels)
    if depth == 16:
        return lines.reshape(h, -1).view(">u2").astype(np.uint16).reshape(h, w, channels)
    bits = np.unpackbits(lines, axis=1)[:, : w * channels * depth].reshape(h, w * channels, depth)
    return (bits @ (1 << np.arange(depth - 1, -1, -1))).astype(np.uint8).reshape(h, w, channels)


def passes(h: int, w: int, interlaced: bool) -> Iterator[tuple[slice, slice]]:
    """Rows and columns of each pass that has pixels; a single one if not interlaced."""
    for x, y, dx, dy in ADAM7 if interlaced else ((0, 0, 1, 1),):
        if x < w and y < h:
            yield slice(y, None, dy), slice(x, None, dx)


def png_bytes(x: np.ndarray, name: str = "adaptive", palette: np.ndarray | None = None, depth: int = 8, interlaced: bool = False) -> bytes:
    """x (h, w, channels): gray, gray and alpha, RGB or RGBA samples, or with a palette (n, 3), or (n, 4) with alpha, its indices; fewer bits than eight for one channel only."""
    kind = 3 if palette is not None else {1: 0, 2: 4, 3: 2, 4: 6}[x.shape[2]]
    if depth not in (1, 2, 4, 8, 16) or (depth < 8 and x.shape[2] > 1) or (depth == 16 and kind == 3):
        raise ValueError(f"no PNG has {depth} bits in {x.shape[2]} channels")
    data = b""
    for rows, columns in passes(x.shape[0], x.shape[1], interlaced):
        body = _packed(x[rows, columns], depth)
        f, lines = filtered(body, name)
        data += np.concatenate([f[:, None], lines.reshape(len(body), -1)], axis=1).tobytes()
    head = struct.pack(">IIBBBBB", x.shape[1], x.shape[0], depth, kind, 0, 0, int(interlaced))
    colors = _chunk(b"PLTE", palette[:, :3].astype(np.uint8).tobytes()) if palette is not None else b""
    if palette is not None and palette.shape[1] == 4:
        colors += _chunk(b"tRNS", palette[:, 3].astype(np.uint8).tobytes())
    return PNG_MAGIC + _chunk(b"IHDR", head) + colors + _chunk(b"IDAT", zlib.compress(data, 9)) + _chunk(b"IEND", b"")


def _unfiltered_row(f: int, line: list[int], up: list[int], unit: int) -> list[int]:
    """A row of the filters 3 and 4, each byte of which needs those before it, and the row above, with a unit of zeros before."""
    out = [0] * unit
    if f == 3:
        for i, v in enumerate(line):
            out.append((v + ((out[i] + up[i + unit]) >> 1)) & 255)
        return out
    for i, v in enumerate(line):
        a, b, c = out[i], up[i + unit], up[i]
        da, db, dc = abs(b - c), abs(a - c), abs(a + b - c - c)
        out.append((v + (a if da <= db and da <= dc else b if db <= dc else c)) & 255)
    return out


def _unfiltered(raw: np.ndarray, unit: int) -> np.ndarray:
    """Rows of a filter and bytes -> rows of bytes."""
    h, n = len(raw), (raw.shape[1] - 1) // unit
    out = np.zeros((h + 1, n + 1, unit), np.uint8)  # a row and a unit of zeros before
    for y in range(1, h + 1):
        line = raw[y - 1, 1:].reshape(n, unit)
        f = raw[y - 1, 0]
        if f == 0:
            out[y, 1:] = line
        elif f == 1:
            out[y, 1:] = np.cumsum(line, axis=0, dtype=np.uint8)
        elif f == 2:
            out[y, 1:] = line + out[y - 1, 1:]
        else:
            out[y] = np.array(_unfiltered_row(f, raw[y - 1, 1:].tolist(), out[y - 1].reshape(-1).tolist(), unit), np.uint8).reshape(n + 1, unit)
    return out[1:, 1:].reshape(h, -1)


def read_png(data: bytes) -> np.ndarray:
    """(h, w, 4) of eight bits, from any depth, interlaced or not; of sixteen bits the upper eight."""
    at, body, palette, clear, head = 8, b"", None, b"", b""
    if data[:8] != PNG_MAGIC:
        raise ValueError("not a PNG")
    while at + 12 <= len(data):
        n, tag = int.from_bytes(data[at : at + 4], "big"), data[at + 4 : at + 8]
        own = data[at + 8 : at + 8 + n]
        if tag == b"IHDR":
            head = own
        elif tag == b"PLTE":
            palette = np.frombuffer(own, np.uint8).reshape(-1, 3)
        elif tag == b"tRNS":
            clear = own
        elif tag == b"IDAT":
            body += own
        at += 12 + n
    w, h, depth, kind, _, _, interlaced = struct.unpack(">IIBBBBB", head)
    channels = PNG_CHANNELS[kind]
    if depth not in (1, 2, 4, 8, 16) or interlaced > 1 or (depth < 8 and channels > 1):
        raise ValueError(f"no PNG has {depth} bits in {channels} channels")
    raw, out, at = np.frombuffer(zlib.decompress(body), np.uint8), np.zeros((h, w, channels), np.uint16 if depth == 16 else np.uint8), 0
    for rows, columns in passes(h, w, bool(interlaced)):
        ph, pw = out[rows, columns].shape[:2]
        line = 1 + -(-pw * channels * depth // 8)
        lines = _unfiltered(raw[at : at + ph * line].reshape(ph, line), max(1, channels * depth // 8))
        out[rows, columns] = _unpacked_samples(lines, pw, channels, depth)
        at += ph * line
    if kind == 3:
        alpha = np.full(len(palette), 255, np.uint8)
        alpha[: len(clear)] = np.frombuffer(clear, np.uint8)[: len(palette)]
        return np.concatenate([palette, alpha[:, None]], axis=1)[out[:, :, 0]]
    return _rgba((out >> 8).astype(np.uint8) if depth == 16 else out if depth == 8 else (out * (255 // ((1 << depth) - 1))).astype(np.uint8))


def _rgba(x: np.ndarray, palette: np.ndarray | None = None) -> np.ndarray:
    if palette is not None:
        x = palette[x[:, :, 0]]
    alpha = x[:, :, -1:] if x.shape[2] in (2, 4) else np.full((*x.shape[:2], 1), 255, np.uint8)
    color = x[:, :, :3] if x.shape[2] >= 3 else np.repeat(x[:, :, :1], 3, axis=2)
    return np.concatenate([color, alpha], axis=2)


def read_bmp(data: bytes) -> np.ndarray:
    """(h, w, 4) of an uncompressed BMP of 24 or 32 bits."""
    offset, w, h, depth, packing = struct.unpack_from("<I", data, 10)[0], *struct.unpack_from("<ii", data, 18), *struct.unpack_from("<HI", data, 28)
    if data[:2] != b"BM" or packing or depth not in (24, 32):
        raise ValueError("only uncompressed BMP of 24 or 32 bits")
    step = depth // 8
    stride = -(-w * step // 4) * 4
    rows = np.frombuffer(data, np.uint8, stride * abs(h), offset).reshape(abs(h), stride)[:, : w * step].reshape(abs(h), w, step)
    return _rgba((rows[::-1] if h > 0 else rows)[:, :, 2::-1])


def read_tga(data: bytes) -> np.ndarray:
    """(h, w, 4) of a true-colour or gray TGA, run-length encoded or not."""
    skip, _, kind = data[0], data[1], data[2]
    w, h, depth, flags = struct.unpack_from("<HHBB", data, 12)
    step, at = depth // 8, 18 + skip
    if kind not in (2, 3, 10, 11) or depth not in (8, 24, 32):
        raise ValueError("only gray or true colour")
    if kind < 8:
        flat = np.frombuffer(data, np.uint8, w * h * step, at)
    else:
        parts, n = [], 0
        while n < w * h:
            count = (data[at] & 127) + 1
            size = step if data[at] & 128 else step * count
            parts.append(data[at + 1 : at + 1 + size] * (count if data[at] & 128 else 1))
            at, n = at + 1 + size, n + count
        flat = np.frombuffer(b"".join(parts), np.uint8)[: w * h * step]
    rows = flat.reshape(h, w, step)
    rows = rows if flags & 0x20 else rows[::-1]
    return _rgba(rows if step == 1 else np.concatenate([rows[:, :, 2::-1], rows[:, :, 3:]], axis=2))


def read_gif(data: bytes) -> np.ndarray:
    """(h, w, 4) of the first image of a GIF, where it stands in the canvas; not interlaced."""
    return next(gifs.each_frame(data))[0]


READERS: dict[str, Callable[[bytes], np.ndarray]] = {"Png": read_png, "Bmp": read_bmp, "Tga": read_tga, "Gif": read_gif, "Tiff": tiffs.read_tiff, "Jpeg": jpegs.read_jpeg}


def read_pixels(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """files (path, format, content) of READERS' formats -> pixels (path, y, x, r, g, b, a), errors (path, error). A file that can't be read is an error row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made(rows: list[tuple]) -> pa.RecordBatch:
            paths, widths, data, errors = zip(*rows, strict=True)
            flat = np.concatenate([np.zeros(0, np.int64), *(d for d in data if d is not None)])
            sizes = np.array([0 if d is None else len(d) for d in data])
            lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(sizes)], pa.int32()), pa.array(flat), mask=pa.array([d is None for d in data]))
            image = pa.StructArray.from_arrays([pa.array(widths, pa.int64()), lists, pa.array(errors, pa.string())], ["w", "data", "error"])
            return pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), image], ["path", "image"])

        for b in batches:
            rows, held = [], 0
            for path, name, data in zip(b.column(0), b.column(1), b.column(2), strict=True):
                try:
                    x = READERS[name.as_py()](data.as_py())
                    rows.append((path.as_py(), x.shape[1], x.reshape(-1, 4).astype(np.int64) @ np.array([1 << 24, 1 << 16, 1 << 8, 1]), None))
                    held += x.size // 4
                except UNREADABLE as e:
                    rows.append((path.as_py(), None, None, f"{type(e).__name__}: {e}"[:200]))
                if held >= AT_ONCE:
                    yield made(rows)
                    rows, held = [], 0
            if rows:
                yield made(rows)

    read = files.where(F.col("format").isin(*READERS)).select("path", "format", "content").mapInArrow(run, "path string, image struct<w: bigint, data: array<bigint>, error: string>")
    each = read.select("path", F.col("image.w").alias("w"), F.posexplode("image.data").alias("at", "v"))
    pixels = each.select("path", F.floor(F.col("at") / F.col("w")).alias("y"), (F.col("at") % F.col("w")).alias("x"), *(F.floor(F.col("v") / (1 << s)).cast("long").bitwiseAND(255).alias(c) for c, s in zip("rgba", (24, 16, 8, 0), strict=True)))
    return pixels, read.select("path", F.col("image.error").alias("error")).where("error is not null")


def images(pixels: DataFrame) -> DataFrame:
    """img_id, w, data: the pixels of each image in order, four bytes in a number."""
    packed = F.col("r") * (1 << 24) + F.col("g") * (1 << 16) + F.col("b") * (1 << 8) + F.col("a")
    rows = pixels.groupBy("img_id").agg((F.max("x") + 1).alias("w"), F.array_sort(F.collect_list(F.struct("y", "x", packed.alias("v")))).alias("p"))
    return rows.select("img_id", "w", F.col("p.v").alias("data"))


def forms(x: np.ndarray) -> Iterator[tuple[str, np.ndarray, np.ndarray | None]]:
    """The ways to hold an image (h, w, 4) without loss, eight bits a sample: name, samples, palette.

    All channels; no alpha if it is opaque; gray, or gray and alpha, if it is
    gray everywhere; a palette, with alpha where it is needed, if it has at most
    256 colours. That is PNG's own bound, as an index is a byte: an image of
    more colours has no such form, and is held by its channels.
    """
    opaque, gray = bool((x[:, :, 3] == 255).all()), bool((x[:, :, :1] == x[:, :, 1:3]).all())
    yield "rgba", x, None
    if opaque:
        yield "rgb", x[:, :, :3], None
        if gray:
            yield "gray", x[:, :, :1], None
    colors, index = np.unique(np.ascontiguousarray(x).view(">u4").astype(np.uint32), return_inverse=True)
    if len(colors) <= 256:
        yield "palette", index.reshape(*x.shape[:2], 1).astype(np.uint8), colors.astype(">u4").view(np.uint8).reshape(-1, 4)[:, : 3 if opaque else 4]
    if gray:
        yield "graya", x[:, :, [0, 3]], None


def write_gif(image: DataFrame) -> DataFrame:
    """images -> img_id, content: still GIFs; null for an image of more than 256 colours or one that is not opaque."""

    schema = pa.schema([("img_id", pa.int64()), ("content", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made() -> Iterator[tuple]:
            for key, x in _each_image(batches):
                own = next(((own, palette) for name, own, palette in forms(x) if name == "palette" and palette.shape[1] == 3), None)
                yield key, None if own is None else gifs.gif_file([(own[0][:, :, 0], 0)], own[1])

        return _in_parts(made(), schema)

    return image.mapInArrow(run, "img_id bigint, content binary")


def _in_parts(rows: Iterator[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Rows whose last value is a file, in batches of about AT_ONCE bytes."""
    held: list[tuple] = []
    size = 0
    for row in rows:
        held.append(row)
        size += len(row[-1] or b"") + 64
        if size >= AT_ONCE:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), schema.types, strict=True)], schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), schema.types, strict=True)], schema=schema)


def _each_image(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray]]:
    """img_id and (h, w, 4) of each of `images`, one after another."""
    for b in batches:
        for key, w, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
            v = data.values.to_numpy(zero_copy_only=False).astype(np.int64)
            yield key, np.stack([(v >> s) & 255 for s in (24, 16, 8, 0)], axis=1).astype(np.uint8).reshape(-1, w, 4)


def png_depths(image: DataFrame, depths: tuple[int, ...] = (1, 2, 4, 8, 16)) -> DataFrame:
    """images -> img_id, depth, interlaced, content: their first channel as gray PNG of each depth, straight and interlaced; fewer bits keep the upper ones."""

    schema = pa.schema([("img_id", pa.int64()), ("depth", pa.int64()), ("interlaced", pa.bool_()), ("content", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made() -> Iterator[tuple]:
            for key, x in _each_image(batches):
                gray = x[:, :, :1].astype(np.int64)
                yield from ((key, d, i, png_bytes(gray * 257 if d == 16 else gray >> (8 - d), "adaptive", None, d, i)) for d in depths for i in (False, True))

        return _in_parts(made(), schema)

    return image.select("img_id", "w", "data").mapInArrow(run, "img_id bigint, depth bigint, interlaced boolean, content binary")


def png_candidates(image: DataFrame, wanted: str | None = None) -> DataFrame:
    """images -> img_id, ordinal, strategy, len, content: each form with each filter, or only the one that is wanted; an image that has no such form has no row."""
    schema = pa.schema([("img_id", pa.int64()), ("ordinal", pa.int64()), ("strategy", pa.string()), ("len", pa.int64()), ("content", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made() -> Iterator[tuple]:
            for key, x in _each_image(batches):
                ways = ((f"{form}-{f}", own, f, palette) for form, own, palette in forms(x) for f in FILTERS)
                for k, (strategy, own, f, palette) in enumerate(ways):
                    if wanted in (None, strategy):
                        content = png_bytes(own, f, palette)
                        yield key, k + 1, strategy, len(content), content

        return _in_parts(made(), schema)

    return image.mapInArrow(run, "img_id bigint, ordinal bigint, strategy string, len bigint, content binary")
