"""TIFF: a linked list of directories of tags as rows, and images in strips, stored, run-length encoded or deflated, with or without differences along rows."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.sources.chunks import UNREADABLE

#: Bytes and struct letters of the types of values (fixed values).
TYPES = {1: "B", 2: "B", 3: "H", 4: "I", 5: "II", 6: "b", 7: "B", 8: "h", 9: "i", 10: "ii", 11: "f", 12: "d"}
#: Tags that an image needs (fixed values).
WIDTH, HEIGHT, BITS, COMPRESSION, MEANING, OFFSETS, SAMPLES, ROWS, COUNTS, PLANAR, PREDICTOR, COLORS, EXTRA = 256, 257, 258, 259, 262, 273, 277, 278, 279, 284, 317, 320, 338
STORED, PACKBITS, DEFLATE, OLD_DEFLATE = 1, 32773, 8, 32946
#: Ways to write an image: compression, and whether rows become differences.
FORMS = {"stored": (STORED, False), "packbits": (PACKBITS, False), "deflate": (DEFLATE, False), "deflate-differences": (DEFLATE, True)}
#: Bytes of a strip, about.
STRIP = 8192


def packed_bits(row: bytes) -> bytes:
    """Runs of three bytes and more as a negative count and the byte, what is between them as a count and the bytes, 128 at most each."""
    data = np.frombuffer(row, np.uint8)
    if not len(data):
        return b""
    edge = np.flatnonzero(np.diff(data)) + 1
    start = np.concatenate([[0], edge])
    size = np.diff(np.append(start, len(data)))
    out, literal = bytearray(), bytearray()

    def flush() -> None:
        for i in range(0, len(literal), 128):
            part = literal[i : i + 128]
            out.append(len(part) - 1)
            out.extend(part)
        literal.clear()

    for s, n in zip(start.tolist(), size.tolist(), strict=True):
        if n < 3:
            literal.extend(row[s : s + n])
            continue
        flush()
        while n:
            own = min(n, 128)
            if own == 1:
                literal.append(row[s])
            else:
                out.extend((257 - own, row[s]))
            n -= own
    flush()
    return bytes(out)


def unpacked_bits(data: bytes, size: int) -> bytes:
    out, at = bytearray(), 0
    while len(out) < size:
        n = data[at]
        if n < 128:
            out += data[at + 1 : at + 2 + n]
            at += 2 + n
        else:
            out += data[at + 1 : at + 2] * (257 - n) if n > 128 else b""
            at += 2 if n > 128 else 1
    return bytes(out[:size])


def tiff_bytes(x: np.ndarray, form: str = "deflate-differences", strip: int = STRIP) -> bytes:
    """x (h, w, 1, 3 or 4) of bytes: gray, RGB or RGBA."""
    h, w, n = x.shape
    compression, differences = FORMS[form]
    per = max(1, strip // (w * n))
    body = np.concatenate([x[:, :1], x[:, 1:] - x[:, :-1]], axis=1) if differences else x
    strips = []
    for y in range(0, h, per):
        part = body[y : y + per]
        if compression == PACKBITS:
            strips.append(b"".join(packed_bits(r.tobytes()) for r in part))
        else:
            strips.append(zlib.compress(part.tobytes(), 9) if compression == DEFLATE else part.tobytes())
    tags: dict[int, tuple[int, list[int]]] = {
        WIDTH: (4, [w]), HEIGHT: (4, [h]), BITS: (3, [8] * n), COMPRESSION: (3, [compression]), MEANING: (3, [1 if n == 1 else 2]), SAMPLES: (3, [n]), ROWS: (4, [per]),
        OFFSETS: (4, (8 + np.cumsum([0, *map(len, strips)])[:-1]).tolist()), COUNTS: (4, [len(s) for s in strips]),
    }
    if differences:
        tags[PREDICTOR] = (3, [2])
    if n == 4:
        tags[EXTRA] = (3, [2])
    data = b"".join(strips)
    data += b"\0" * (len(data) % 2)
    entries = b""
    for tag, (kind, values) in sorted(tags.items()):
        packed = struct.pack(f"<{len(values)}{TYPES[kind]}", *values)
        if len(packed) > 4:
            place, data = 8 + len(data), data + packed + b"\0" * (len(packed) % 2)
            packed = struct.pack("<I", place)
        entries += struct.pack("<HHI", tag, kind, len(values)) + packed.ljust(4, b"\0")
    return struct.pack("<2sHI", b"II", 42, 8 + len(data)) + data + struct.pack("<H", len(tags)) + entries + struct.pack("<I", 0)


def directories(data: bytes) -> Iterator[tuple[int, int, int, int, list[float]]]:
    """(directory, tag, type, count, values) along the list of directories; fractions are numerator and denominator. A list that comes back to itself ends."""
    order = {b"II": "<", b"MM": ">"}.get(data[:2])
    if order is None or struct.unpack_from(order + "H", data, 2)[0] != 42:
        raise ValueError("no TIFF")
    at, seen, k = struct.unpack_from(order + "I", data, 4)[0], set(), 0
    while at and at not in seen:
        seen.add(at)
        n = struct.unpack_from(order + "H", data, at)[0]
        for e in range(n):
            entry = at + 2 + 12 * e
            tag, kind, count = struct.unpack_from(order + "HHI", data, entry)
            if kind not in TYPES:
                continue
            form = order + TYPES[kind] * count
            size = struct.calcsize(form)
            place = entry + 8 if size <= 4 else struct.unpack_from(order + "I", data, entry + 8)[0]
            yield k, tag, kind, count, list(struct.unpack_from(form, data, place))
        at, k = struct.unpack_from(order + "I", data, at + 2 + 12 * n)[0], k + 1


def read_tiff(data: bytes) -> np.ndarray:
    """(h, w, 4) of the first directory: gray, RGB, RGBA or a palette, of eight bits, in strips."""
    tags = {tag: values for k, tag, _, _, values in directories(data) if k == 0}
    w, h, n = int(tags[WIDTH][0]), int(tags[HEIGHT][0]), int(tags.get(SAMPLES, [1])[0])
    bits, compression, meaning = tags.get(BITS, [1]), tags.get(COMPRESSION, [STORED])[0], tags[MEANING][0]
    if any(b != 8 for b in bits) or meaning not in (0, 1, 2, 3) or tags.get(PLANAR, [1])[0] != 1:
        raise ValueError("only eight bits a sample, gray, palette or RGB, samples together")
    per, out = int(tags.get(ROWS, [h])[0]), np.zeros((h, w, n), np.uint8)
    for k, (offset, count) in enumerate(zip(tags[OFFSETS], tags[COUNTS], strict=True)):
        first = k * per
        rows = min(per, h - first)
        if rows <= 0:
            break
        raw = data[offset : offset + count]
        size = rows * w * n
        if compression == PACKBITS:
            raw = unpacked_bits(raw, size)
        elif compression in (DEFLATE, OLD_DEFLATE):
            raw = zlib.decompress(raw)
        elif compression != STORED:
            raise ValueError(f"compression {compression}")
        part = np.frombuffer(raw, np.uint8, size).reshape(rows, w, n)
        out[first : first + rows] = np.cumsum(part, axis=1, dtype=np.uint8) if tags.get(PREDICTOR, [1])[0] == 2 else part
    if meaning == 3:
        table = (np.array(tags[COLORS], np.int64).reshape(3, -1).T >> 8).astype(np.uint8)
        out, n = table[out[:, :, 0]], 3
    elif meaning == 0:
        out = 255 - out
    color = out[:, :, :3] if n >= 3 else np.repeat(out[:, :, :1], 3, axis=2)
    alpha = out[:, :, n - 1 : n] if n in (2, 4) else np.full((h, w, 1), 255, np.uint8)
    return np.concatenate([color, alpha], axis=2)


def read_directories(files: DataFrame) -> DataFrame:
    """files (path, content) -> path, directory, tag, type, count, values (as doubles), error: a row for each tag, or one row with the reason."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.float64()), pa.string()
        for b in batches:
            rows: list[tuple] = []
            for path, data in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                try:
                    rows += [(path, *r, None) for r in directories(data.as_py() or b"")]
                except UNREADABLE as e:
                    rows.append((path, None, None, None, None, None, f"{type(e).__name__}: {e}"[:200]))
            columns = list(zip(*rows, strict=True)) or [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["path", "directory", "tag", "type", "count", "values", "error"])

    return files.select("path", "content").mapInArrow(run, "path string, directory bigint, tag bigint, type bigint, count bigint, values array<double>, error string")


def tiff_candidates(image: DataFrame, strip: int = STRIP) -> DataFrame:
    """images (img_id, w, data: four bytes in a number) -> img_id, ordinal, strategy, len, content: each of FORMS, without alpha where the image is opaque."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.binary()
        for b in batches:
            rows: list[tuple] = []
            for key, w, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                v = data.values.to_numpy(zero_copy_only=False).astype(np.int64)
                x = np.stack([(v >> s) & 255 for s in (24, 16, 8, 0)], axis=1).astype(np.uint8).reshape(-1, w, 4)
                own = x[:, :, :3] if (x[:, :, 3] == 255).all() else x
                made = [(f"tiff-{form}", tiff_bytes(own, form, strip)) for form in FORMS]
                rows += [(key, k + 1, s, len(c), c) for k, (s, c) in enumerate(made)]
            columns = list(zip(*rows, strict=True)) or [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["img_id", "ordinal", "strategy", "len", "content"])

    return image.select("img_id", "w", "data").mapInArrow(run, "img_id bigint, ordinal bigint, strategy string, len bigint, content binary")


def with_png(candidates: DataFrame, png: DataFrame) -> DataFrame:
    """Candidates of both kinds, those of PNG after the others."""
    return candidates.unionByName(png.withColumn("ordinal", F.col("ordinal") + len(FORMS)))
