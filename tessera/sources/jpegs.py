"""Baseline JPEG: quantised blocks to files with codes of their own, and files to pixels."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators import blocks, entropy

#: The longest code of a table, and codes of what can't be written (fixed values).
LONGEST, ZEROS, END = 16, 0xF0, 0x00
_ORDER = np.array([v * blocks.SIDE + u for v, u in blocks.zigzag()])
_BASIS = np.array(blocks.basis())


def limited_lengths(counts: dict[int, int]) -> dict[int, int]:
    """Lengths of codes for the symbols, none over LONGEST, and none of ones alone: room is left for one symbol more, rarer than all.

    Codes that are too long give way in pairs: one of a pair takes the place of
    their common beginning, the other that of a shorter code, which grows by a bit.
    """
    symbols = sorted(counts)
    length = entropy.code_lengths(np.array([0, *(counts[s] for s in symbols)], np.int64))
    if len(symbols) == 1:
        return {symbols[0]: 1}
    often = np.bincount(length, minlength=LONGEST + 2).tolist()
    for n in range(len(often) - 1, LONGEST, -1):
        while often[n]:
            shorter = next(k for k in range(n - 2, 0, -1) if often[k])
            often[n] -= 2
            often[n - 1] += 1
            often[shorter + 1] += 2
            often[shorter] -= 1
    often[max(k for k in range(LONGEST + 1) if often[k])] -= 1  # the one that is left out
    sizes = [n for n in range(1, LONGEST + 1) for _ in range(often[n])]
    return dict(zip(sorted(symbols, key=lambda s: (-counts[s], s)), sizes, strict=True))


def canonical(length: dict[int, int]) -> dict[int, tuple[int, int]]:
    """symbol -> (code, length), shorter ones first."""
    out, code, last = {}, 0, 0
    for s, n in sorted(length.items(), key=lambda x: (x[1], x[0])):
        code <<= n - last
        out[s] = code, n
        code, last = code + 1, n
    return out


def _written(z: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(symbol, bits, number of bits) of the coefficients of a block but its first, in zigzag order."""
    last = 0
    for k in np.flatnonzero(z[1:]).tolist():
        k, v = k + 1, int(z[k + 1])
        run = k - last - 1
        for _ in range(run // 16):
            yield ZEROS, 0, 0
        n = abs(v).bit_length()
        yield run % 16 * 16 + n, v if v > 0 else v + (1 << n) - 1, n
        last = k
    if last < blocks.SIDE**2 - 1:
        yield END, 0, 0


def _segment(marker: int, data: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(data) + 2) + data


def jpeg_bytes(planes: list[np.ndarray], w: int, h: int, quality: int) -> bytes:
    """planes: one (gray) or three arrays (blocks, 64) of quantised coefficients in zigzag order, blocks row by row."""
    said: list[tuple[int, int, int, int]] = []  # table, symbol, bits, number of bits
    last = [0] * len(planes)
    for k in range(len(planes[0])):
        for c, plane in enumerate(planes):
            table = 2 * (c > 0)
            d, last[c] = int(plane[k, 0]) - last[c], int(plane[k, 0])
            n = abs(d).bit_length()
            said.append((table, n, d if d >= 0 else d + (1 << n) - 1, n))
            said += [(table + 1, *s) for s in _written(plane[k])]
    rows = np.array(said, np.int64)
    code, size = np.zeros((4, 256), np.int64), np.zeros((4, 256), np.int64)
    head = b""
    for t in range(4 if len(planes) > 1 else 2):
        symbol, n = np.unique(rows[rows[:, 0] == t, 1], return_counts=True)
        own = canonical(limited_lengths(dict(zip(symbol.tolist(), n.tolist(), strict=True))))
        for s, (c, m) in own.items():
            code[t, s], size[t, s] = c, m
        listed = sorted(own, key=lambda s: (own[s][1], own[s][0]))
        head += _segment(0xC4, bytes([(t % 2) << 4 | t // 2, *(sum(m == k for _, m in own.values()) for k in range(1, LONGEST + 1)), *listed]))
    value = np.stack([code[rows[:, 0], rows[:, 1]], rows[:, 2]], axis=1).reshape(-1)
    bits = np.stack([size[rows[:, 0], rows[:, 1]], rows[:, 3]], axis=1).reshape(-1)
    place = np.arange(int(bits.sum())) - np.repeat(np.cumsum(bits) - bits, bits)
    stream = ((np.repeat(value, bits) >> (np.repeat(bits, bits) - 1 - place)) & 1).astype(np.uint8)
    scan = np.packbits(np.concatenate([stream, np.ones(-len(stream) % 8, np.uint8)])).tobytes().replace(b"\xff", b"\xff\x00")
    tables = b"".join(_segment(0xDB, bytes([k]) + bytes(np.array(blocks.divisors(quality, t))[_ORDER].tolist())) for k, t in enumerate((blocks.LUMINANCE, blocks.CHROMINANCE)[: len(planes)]))
    frame = struct.pack(">BHHB", 8, h, w, len(planes)) + b"".join(bytes([c + 1, 0x11, int(c > 0)]) for c in range(len(planes)))
    start = bytes([len(planes)]) + b"".join(bytes([c + 1, 0x11 * int(c > 0)]) for c in range(len(planes))) + b"\x00\x3f\x00"
    return b"\xff\xd8" + _segment(0xE0, b"JFIF\0\x01\x01\0\0\x01\0\x01\0\0") + tables + _segment(0xC0, frame) + head + _segment(0xDA, start) + scan + b"\xff\xd9"


# ---- reading ----


class _Bits:
    """The bits of a scan up to a marker."""

    def __init__(self, data: bytes):
        self.data, self.at, self.held, self.n = data, 0, 0, 0

    def peek16(self) -> int:
        while self.n < 16:
            byte = self.data[self.at] if self.at < len(self.data) else 0xFF
            self.at += 1
            self.held, self.n = ((self.held << 8) | byte) & 0xFFFFFFFF, self.n + 8
        return (self.held >> (self.n - 16)) & 0xFFFF

    def take(self, k: int) -> int:
        if not k:
            return 0
        v = self.peek16() >> (16 - k)
        self.n -= k
        return v

    def symbol(self, table: tuple[list[int], list[int], int]) -> int:
        look = self.peek16() >> table[2]
        k = table[1][look]
        if not k or self.at > len(self.data) + 4:
            raise ValueError("no code begins here")
        self.n -= k
        return table[0][look]

    def number(self, k: int) -> int:
        v = self.take(k)
        return v if not k or v >> (k - 1) else v - (1 << k) + 1


def _table(data: bytes) -> tuple[list[int], list[int], int]:
    """Symbol and length of the code that bits begin with, for as many bits as the longest code has, and the bits of sixteen that are not looked at."""
    wide = max((k for k in range(1, 17) if data[k - 1]), default=1)
    symbol, size, code, at = [0] * (1 << wide), [0] * (1 << wide), 0, 16
    for k in range(1, wide + 1):
        for s in data[at : at + data[k - 1]]:
            low, high = code << (wide - k), (code + 1) << (wide - k)
            symbol[low:high], size[low:high] = [s] * (high - low), [k] * (high - low)
            code += 1
        at += data[k - 1]
        code <<= 1
    return symbol, size, 16 - wide


def read_jpeg(data: bytes) -> np.ndarray:
    """(h, w, 4) of a baseline JPEG, gray or with three components, colours repeated where they are fewer; anything else is a ValueError."""
    if data[:2] != b"\xff\xd8":
        raise ValueError("no JPEG")
    at, divisor, codes, frame, every = 2, {}, {}, None, 0
    while True:
        if data[at] != 0xFF:
            raise ValueError(f"no marker at {at}")
        marker = data[at + 1]
        if marker == 0xFF:
            at += 1
            continue
        n = int.from_bytes(data[at + 2 : at + 4], "big")
        own = data[at + 4 : at + 2 + n]
        at += 2 + n
        if marker == 0xDB:
            while own:
                wide = own[0] >> 4
                values = np.frombuffer(own, ">u2" if wide else np.uint8, 64, 1)
                divisor[own[0] & 15], own = values.astype(np.int64), own[1 + 64 * (1 + wide) :]
        elif marker == 0xC4:
            while own:
                size = 17 + sum(own[1:17])
                codes[own[0]], own = _table(own[1:size]), own[size:]
        elif marker in (0xC0, 0xC1):
            frame = own
        elif marker == 0xDD:
            every = int.from_bytes(own[:2], "big")
        elif 0xC2 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
            raise ValueError("only baseline JPEG")
        elif marker == 0xDA:
            break
    if frame is None or frame[0] != 8:
        raise ValueError("only eight bits a sample")
    h, w, count = *struct.unpack(">HH", frame[1:5]), frame[5]
    if not h or not w or count not in (1, 3) or own[0] != count:
        raise ValueError("only one scan of one or three components")
    parts = [frame[6 + 3 * c : 9 + 3 * c] for c in range(count)]
    across, down = [p[1] >> 4 for p in parts], [p[1] & 15 for p in parts]
    if count == 1:
        across, down = [1], [1]
    ways = {own[1 + 2 * c]: own[2 + 2 * c] for c in range(count)}
    wide, high = max(across), max(down)
    mw, mh = -(-w // (8 * wide)), -(-h // (8 * high))
    z = [np.zeros((mh * d, mw * a, 64), np.int64) for a, d in zip(across, down, strict=True)]
    scan = data[at:]
    end = scan.rfind(b"\xff\xd9")
    pieces = _restarts(scan[: end if end >= 0 else len(scan)])
    bits, last, piece = _Bits(pieces[0]), [0] * count, 0
    for m in range(mw * mh):
        if every and m and m % every == 0:
            piece += 1
            bits, last = _Bits(pieces[piece]), [0] * count
        for c in range(count):
            way = ways[parts[c][0]]
            first, others = codes[way >> 4], codes[16 | way & 15]
            for k in range(across[c] * down[c]):
                last[c] += bits.number(bits.symbol(first))
                line = z[c][m // mw * down[c] + k // across[c], m % mw * across[c] + k % across[c]]
                line[0], place = last[c], 1
                while place < 64:
                    s = bits.symbol(others)
                    if s == END:
                        break
                    place += s >> 4
                    if s & 15:
                        line[place] = bits.number(s & 15)
                    place += 1
    planes = []
    for c in range(count):
        f = np.zeros(z[c].shape)
        f[..., _ORDER] = z[c] * divisor[parts[c][2]]
        cells = np.einsum("vy,ijvu,ux->iyjx", _BASIS, f.reshape(*f.shape[:2], 8, 8), _BASIS)
        own = np.clip(np.floor(np.round(cells, 6) + 0.5) + 128, 0, 255).astype(np.int64).reshape(cells.shape[0] * 8, -1)
        planes.append(own.repeat(high // down[c], axis=0).repeat(wide // across[c], axis=1)[:h, :w])
    if count == 1:
        color = np.stack([planes[0]] * 3, axis=2)
    else:
        y, u, v = planes[0], planes[1] - 128, planes[2] - 128
        color = np.clip(np.stack([y + (359 * v + 128 >> 8), y - (88 * u + 183 * v + 128 >> 8), y + (454 * u + 128 >> 8)], axis=2), 0, 255)
    return np.concatenate([color, np.full((h, w, 1), 255)], axis=2).astype(np.uint8)


def _restarts(scan: bytes) -> list[bytes]:
    """The scan between restart markers, without what is stuffed after a byte of ones."""
    out, start, at = [], 0, scan.find(b"\xff")
    while at >= 0:
        if at + 1 < len(scan) and 0xD0 <= scan[at + 1] <= 0xD7:
            out.append(scan[start:at])
            start = at + 2
        at = scan.find(b"\xff", at + 2)
    return [p.replace(b"\xff\x00", b"\xff") for p in (*out, scan[start:])]


# ---- whole tables ----


def write_jpegs(pixels: DataFrame, quality: int, gray: bool = False) -> DataFrame:
    """pixels of whole images -> img_id, content: JPEG files. Blocks are transformed as rows; only the blocks of one file meet in one value."""
    z = blocks.transformed(pixels, quality)
    z = z.where("channel = 0") if gray else z
    each = z.groupBy("img_id").agg(F.max("w").alias("w"), F.max("h").alias("h"), F.array_sort(F.collect_list(F.struct("channel", "by", "bx", "z"))).alias("b"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for w, h, own in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3), strict=True):
                flat = own.values
                channel = flat.field("channel").to_numpy()
                table = flat.field("z").flatten().to_numpy(zero_copy_only=False).reshape(-1, 64)
                out.append(jpeg_bytes([table[channel == c] for c in np.unique(channel)], w, h, quality))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.binary())], ["img_id", "content"])

    return each.select("img_id", "w", "h", "b").mapInArrow(run, "img_id bigint, content binary")
