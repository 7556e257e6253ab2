"""Bytes as symbols: counts, entropy, canonical prefix codes, bit streams and their reading.

Bytes are counted where the rows are scanned, at most 256 counts a row leave a
task. A code table is rows (key, byte, n, length, code); codes follow from the
lengths by one running sum. Texts that keep their table beside them are coded
and read where they are, without a shuffle.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, LongType, StructField, StructType

COUNTS = ArrayType(StructType([StructField("byte", IntegerType()), StructField("n", LongType())]))
TABLE = ArrayType(StructType([StructField("byte", IntegerType()), StructField("n", LongType()), StructField("length", IntegerType()), StructField("code", LongType())]))
#: Bits that a code has at most: a longer one needs a text of over 10^12 bytes, by the growth of Fibonacci's numbers.
MOST = 60
#: Bytes that are turned to bits, or from them, at once; bits that one look into the table decides at most.
AT_ONCE, LOOK = 1 << 16, 16


def _lists(parts: list[np.ndarray], values: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, parts)]), pa.int32()), values)


@F.arrow_udf(COUNTS)
def byte_counts(content: pa.Array) -> pa.Array:
    """The bytes that occur, ascending, with their counts; of a null, none."""
    seen, counts = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for data in content:
        n = np.bincount(np.frombuffer(data.as_buffer() if data.is_valid else b"", np.uint8), minlength=256)
        seen.append(np.flatnonzero(n))
        counts.append(n[seen[-1]])
    both = pa.StructArray.from_arrays([pa.array(np.concatenate(seen), pa.int32()), pa.array(np.concatenate(counts), pa.int64())], ["byte", "n"])
    return _lists(seen[1:], both)


def entropy_bits(counts: Column) -> Column:
    """Bits of a byte on average, from `byte_counts`; of an empty text, null."""
    total = F.aggregate(counts, F.lit(0).cast("long"), lambda a, c: a + c["n"])
    weighted = F.aggregate(counts, F.lit(0.0), lambda a, c: a + c["n"] * F.log2(c["n"]))
    return F.when(total > 0, F.log2(total) - weighted / total)


def code_lengths(n: np.ndarray) -> np.ndarray:
    """Lengths of an optimal prefix code for the counts; zero for a single symbol. Equal weights merge in the order in which they came."""
    heap = [(int(w), i) for i, w in enumerate(n)]
    heapq.heapify(heap)
    above, made = [0] * (2 * len(n)), len(n)
    while len(heap) > 1:
        (v, a), (w, b) = heapq.heappop(heap), heapq.heappop(heap)
        above[a] = above[b] = made
        heapq.heappush(heap, (v + w, made))
        made += 1
    length = [0] * made
    for i in range(made - 2, -1, -1):
        length[i] = length[above[i]] + 1
    return np.array(length[: len(n)], np.int64)


@F.arrow_udf(ArrayType(IntegerType()))
def optimal_lengths(counts: pa.Array) -> pa.Array:
    n = counts.flatten().field("n").to_numpy(zero_copy_only=False)
    end = np.cumsum(counts.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
    lengths = [code_lengths(n[a:b]) for a, b in zip([0, *end[:-1]], end, strict=True)]
    return _lists(lengths, pa.array(np.concatenate([np.zeros(0, np.int64), *lengths]), pa.int32()))


def huffman_bits(counts: Column, lengths: Column) -> Column:
    """Length of the coded text: the counts times the lengths of their codes."""
    return F.aggregate(F.arrays_zip(counts.alias("c"), lengths.alias("l")), F.lit(0).cast("long"), lambda a, x: a + x["c"]["n"] * x["l"])


def with_lengths(df: DataFrame, content: Column) -> DataFrame:
    """df with `counts` and `lengths`, arrays over the bytes that occur."""
    return df.withColumn("counts", byte_counts(content)).withColumn("lengths", optimal_lengths("counts"))


@F.arrow_udf(TABLE)
def code_tables(content: pa.Array) -> pa.Array:
    """The code table of each text, by byte: canonical codes, shorter ones first, equally long ones by byte; of a null, none."""
    parts: list[tuple[np.ndarray, ...]] = [(np.zeros(0, np.int64),) * 4]
    for data in content:
        n = np.bincount(np.frombuffer(data.as_buffer() if data.is_valid else b"", np.uint8), minlength=256)
        byte = np.flatnonzero(n)
        length, code = code_lengths(n[byte]) if len(byte) else byte, np.zeros(len(byte), np.int64)
        order = np.lexsort((byte, length))
        share = 1 << (MOST - length[order])
        code[order] = (np.cumsum(share) - share) >> (MOST - length[order])
        parts.append((byte, n[byte], length, code))
    columns = [np.concatenate(c) for c in zip(*parts, strict=True)]
    kinds = (pa.int32(), pa.int64(), pa.int32(), pa.int64())
    return _lists([p[0] for p in parts[1:]], pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], TABLE.elementType.names))


def code_table(texts: DataFrame, key: str) -> DataFrame:
    """texts (key, content binary), keys distinct -> key, byte, n, length, code: canonical codes, shorter ones first, equally long ones by byte."""
    return texts.select(key, F.explode(code_tables("content")).alias("e")).select(key, "e.*")


def _stream(data: np.ndarray, code: np.ndarray, length: np.ndarray) -> bytes:
    """The codes of the bytes, most significant bit first."""
    place = np.arange(int(length.max(initial=0)))
    there = place < length[:, None]
    bit = ((code[:, None] >> np.where(there, length[:, None] - 1 - place, 0)) & 1).astype(np.uint8)
    bits = [bit[part][there[part]] for part in (data[i : i + AT_ONCE] for i in range(0, len(data), AT_ONCE))]
    return np.packbits(np.concatenate(bits)).tobytes() if bits else b""


def _read_stream(stream: bytes, n: int, byte: np.ndarray, code: np.ndarray, length: np.ndarray) -> bytes:
    """The n bytes of a stream. A table as wide as the longest code, LOOK bits at most, says for each place which code may begin there, and so where the next one does; longer codes are compared one by one."""
    if not n:
        return b""
    if len(byte) == 1:
        return bytes([int(byte[0])]) * n
    look = min(LOOK, int(length.max(initial=1)))
    symbol, size = np.zeros(1 << look, np.uint8), np.zeros(1 << look, np.uint8)
    for b, c, m in zip(byte.tolist(), code.tolist(), length.tolist(), strict=True):
        if m <= look:
            symbol[c << (look - m) : (c + 1) << (look - m)], size[c << (look - m) : (c + 1) << (look - m)] = b, m
    long = {(m, c): b for b, c, m in zip(byte.tolist(), code.tolist(), length.tolist(), strict=True) if m > look}
    data = np.frombuffer(stream + b"\0" * 12, np.uint8).astype(np.int32)
    triple, whole = (data[:-2] << 16) | (data[1:-1] << 8) | data[2:], int.from_bytes(stream, "big") if long else 0
    shift, total = 24 - look - np.arange(8, dtype=np.int32), 8 * len(stream)
    out, made, at, nowhere = [], 0, 0, 1 << 62
    while made < n:
        start = at >> 3
        window = ((triple[start : start + AT_ONCE, None] >> shift) & ((1 << look) - 1)).reshape(-1)
        step = size[window].astype(np.int64)
        following = np.where(step > 0, np.arange(len(window)) + step, nowhere).tolist()
        at, places = at - 8 * start, []
        while at < len(window):
            places.append(at)
            at = following[at]
        if at == nowhere:
            at = places.pop()
        if places:
            out.append(symbol[window[places[: n - made]]].tobytes())
            if len(places) >= n - made:
                at = following[places[n - made - 1]]
            made += len(out[-1])
        at += 8 * start
        if at > total:
            raise ValueError("the stream ends within a code")
        if made < n and at - 8 * start < len(window) and following[at - 8 * start] == nowhere:
            m = look + 1
            while (m, (whole >> (total - at - m)) & ((1 << m) - 1) if at + m <= total else -1) not in long:
                m += 1
                if m > MOST:
                    raise ValueError("no code begins here")
            out.append(bytes([long[m, (whole >> (total - at - m)) & ((1 << m) - 1)]]))
            made, at = made + 1, at + m
    return b"".join(out)


def _tables(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    flat, end = column.flatten(), np.cumsum(column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
    parts = [flat.field(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("byte", "code", "length")]
    for a, b in zip([0, *end[:-1]], end, strict=True):
        yield tuple(p[a:b] for p in parts)


def _with_tables(texts: DataFrame, codes: DataFrame, key: str) -> DataFrame:
    table = codes.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("byte", "n", "length", "code"))).alias("table"))
    return texts.join(table, key, "left")


def encoded(texts: DataFrame, key: str) -> DataFrame:
    """texts (key, content, table), tables from `code_tables` -> key, n (bytes of the text), bits, stream, table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes, bits, streams = [], [], []
            for data, (byte, code, length) in zip(b.column(1), _tables(b.column(2)), strict=True):
                data = np.frombuffer(data.as_py() or b"", np.uint8)
                code_of, length_of = np.zeros(256, np.int64), np.zeros(256, np.int64)
                code_of[byte], length_of[byte] = code, length
                sizes.append(len(data))
                bits.append(int(length_of[data].sum()))
                streams.append(_stream(data, code_of, length_of))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sizes, pa.int64()), pa.array(bits, pa.int64()), pa.array(streams, pa.binary()), b.column(2)], [key, "n", "bits", "stream", "table"])

    kind, table = texts.schema[key].dataType.simpleString(), TABLE.simpleString()
    return texts.select(key, "content", F.col("table").cast(TABLE)).mapInArrow(run, f"{key} {kind}, n bigint, bits bigint, stream binary, table {table}")


def decoded(streams: DataFrame) -> DataFrame:
    """streams (n, stream, table, more columns) from `encoded` -> all but the table, and content, the text."""
    rest = [c for c in streams.columns if c != "table"]
    names = [*rest, "content"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [_read_stream(s.as_py(), n, *t) for n, s, t in zip(b.column("n").to_pylist(), b.column("stream"), _tables(b.column("table")), strict=True)]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in rest), pa.array(out, pa.binary())], names)

    return streams.mapInArrow(run, StructType([*(streams.schema[c] for c in rest), StructField("content", BinaryType())]))


def encode(texts: DataFrame, codes: DataFrame, key: str) -> DataFrame:
    """texts (key, content), codes from `code_table` -> key, n (bytes of the text), bits, stream."""
    return encoded(_with_tables(texts.select(key, "content"), codes, key), key).drop("table")


def decode(streams: DataFrame, codes: DataFrame, key: str) -> DataFrame:
    """streams from `encode` and their codes -> key, content."""
    return decoded(_with_tables(streams.select(key, "n", "stream"), codes, key)).select(key, "content")
