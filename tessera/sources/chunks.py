"""Container files to one table of chunks: path, seq, container, tag, offset (of the payload), len, payload."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: What a reader raises for a file that it can't read.
UNREADABLE = (ValueError, KeyError, IndexError, TypeError, ArithmeticError, StopIteration, RuntimeError, struct.error, zlib.error)
Chunk = tuple[str, int, int]  # tag, offset and length of the payload
#: JPEG markers without a payload, and names of some others (fixed values).
_BARE = {0xD8: "SOI", 0xD9: "EOI", 0x01: "TEM", **{0xD0 + k: f"RST{k}" for k in range(8)}}
_NAMED = {0xC4: "DHT", 0xDB: "DQT", 0xDD: "DRI", 0xDC: "DNL", 0xDA: "SOS", 0xFE: "COM", 0xCC: "DAC", **{0xE0 + k: f"APP{k}" for k in range(16)}}


def _png(d: bytes) -> Iterator[Chunk]:
    at = 8
    while at + 12 <= len(d):
        n, tag = int.from_bytes(d[at : at + 4], "big"), d[at + 4 : at + 8].decode("latin-1")
        yield tag, at + 8, n
        if tag == "IEND":
            return
        at += 12 + n


def _riff(d: bytes) -> Iterator[Chunk]:
    at = 12
    while at + 8 <= len(d):
        n = int.from_bytes(d[at + 4 : at + 8], "little")
        yield d[at : at + 4].decode("latin-1"), at + 8, n
        at += 8 + n + n % 2


def _glb(d: bytes) -> Iterator[Chunk]:
    at = 12
    while at + 8 <= len(d):
        n = int.from_bytes(d[at : at + 4], "little")
        yield d[at + 4 : at + 8].rstrip(b"\0 ").decode("latin-1"), at + 8, n
        at += 8 + n


def _jpeg(d: bytes) -> Iterator[Chunk]:
    at = 0
    while at + 2 <= len(d) and d[at] == 0xFF:
        marker = d[at + 1]
        if marker in _BARE:
            yield _BARE[marker], at + 2, 0
            at += 2
            continue
        n = int.from_bytes(d[at + 2 : at + 4], "big")
        tag = _NAMED.get(marker) or (f"SOF{marker - 0xC0}" if 0xC0 <= marker <= 0xCF else f"{marker:02X}")
        if tag == "SOS":  # the scan lasts until the end marker
            end = d.rfind(b"\xff\xd9")
            yield tag, at + 4, (end if end > at else len(d)) - at - 4
            if end > at:
                yield "EOI", end + 2, 0
            return
        yield tag, at + 4, n - 2
        at += 2 + n


def _gif(d: bytes) -> Iterator[Chunk]:
    def blocks(at: int) -> int:
        while at < len(d) and d[at]:
            at += 1 + d[at]
        return at + 1

    at = 13 + (3 << ((d[10] & 7) + 1) if d[10] & 0x80 else 0)
    while at < len(d):
        if d[at] == 0x2C:
            flags = d[at + 9]
            start = at + 10 + (3 << ((flags & 7) + 1) if flags & 0x80 else 0)
            end = blocks(start + 1)
            yield "IMAGE", at + 1, end - at - 1
        elif d[at] == 0x21:
            end = blocks(at + 2)
            yield {0xF9: "GCE", 0xFE: "COMMENT", 0xFF: "APP", 0x01: "TEXT"}.get(d[at + 1], "EXT"), at + 2, end - at - 2
        else:
            if d[at] == 0x3B:
                yield "TRAILER", at + 1, 0
            return
        at = end


def _ico(d: bytes) -> Iterator[Chunk]:
    for k in range(int.from_bytes(d[4:6], "little")):
        e = d[6 + 16 * k : 22 + 16 * k]
        width, height, depth = e[0] or 256, e[1] or 256, int.from_bytes(e[6:8], "little")
        yield f"{width}x{height}x{depth}", int.from_bytes(e[12:16], "little"), int.from_bytes(e[8:12], "little")


def _tiff(d: bytes) -> Iterator[Chunk]:
    order = "little" if d[:2] == b"II" else "big"
    at, seen = int.from_bytes(d[4:8], order), set()
    while at and at + 2 <= len(d) and at not in seen:
        seen.add(at)
        n = int.from_bytes(d[at : at + 2], order)
        for k in range(n):
            entry = at + 2 + 12 * k
            yield str(int.from_bytes(d[entry : entry + 2], order)), entry, 12
        at = int.from_bytes(d[at + 2 + 12 * n : at + 6 + 12 * n], order)


WALKERS = {"Png": _png, "WebP": _riff, "Glb": _glb, "Jpeg": _jpeg, "Gif": _gif, "Ico": _ico, "Tiff": _tiff}


def read_chunks(files: DataFrame, payload: bool = True) -> DataFrame:
    """files (path, format, content) -> path, seq, container, tag, offset, len, payload (null unless wanted), error.

    A chunk that claims more than the file has ends the walk with a row whose
    tag is null and whose error says so.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows: list[tuple] = []
            for path, name, d in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
                seq = 0
                try:
                    for tag, offset, n in WALKERS[name](d):
                        if n < 0 or offset + n > len(d):
                            raise ValueError(f"{tag} at {offset} claims {n} bytes")
                        rows.append((path, seq, name, tag, offset, n, d[offset : offset + n] if payload else None, None))
                        seq += 1
                except (ValueError, IndexError) as e:
                    rows.append((path, seq, name, None, None, None, None, str(e)))
            kinds = pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.binary(), pa.string()
            columns = list(zip(*rows, strict=True)) or [()] * 8
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["path", "seq", "container", "tag", "offset", "len", "payload", "error"])

    schema = "path string, seq bigint, container string, tag string, offset bigint, len bigint, payload binary, error string"
    return files.where(F.col("format").isin(*WALKERS)).select("path", "format", "content").mapInArrow(run, schema)
