"""Hashes over whole values, a value at a time in Arrow tasks."""

from __future__ import annotations

import struct

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType

#: The five odd factors of xxHash32 (fixed values).
P1, P2, P3, P4, P5 = 2654435761, 2246822519, 3266489917, 668265263, 374761393
_M = 0xFFFFFFFF


def _turn(x: int, bits: int) -> int:
    return ((x << bits) | (x >> (32 - bits))) & _M


def xx32_of(data: bytes, seed: int = 0) -> int:
    """Four lanes over stripes of 16 bytes, then words of four bytes and single bytes of what is left, all within the value."""
    n, at = len(data), 0
    if n >= 16:
        lanes = [(seed + P1 + P2) & _M, (seed + P2) & _M, seed & _M, (seed - P1) & _M]
        at = n & ~15
        for stripe in struct.iter_unpack("<4I", data[:at]):
            for k, word in enumerate(stripe):
                x = (lanes[k] + word * P2) & _M
                lanes[k] = ((x << 13 | x >> 19) & _M) * P1 & _M
        h = sum(_turn(x, r) for x, r in zip(lanes, (1, 7, 12, 18), strict=True)) & _M
    else:
        h = (seed + P5) & _M
    h = (h + n) & _M
    for (word,) in struct.iter_unpack("<I", data[at : at + (n - at) // 4 * 4]):
        h = _turn((h + word * P3) & _M, 17) * P4 & _M
    for byte in data[n & ~3 :]:
        h = _turn((h + byte * P5) & _M, 11) * P1 & _M
    h = (h ^ h >> 15) * P2 & _M
    h = (h ^ h >> 13) * P3 & _M
    return h ^ h >> 16


@F.pandas_udf(LongType())
def xx32(content: pd.Series) -> pd.Series:
    """xxHash32 with seed zero; of a null, that of no bytes."""
    return pd.Series([xx32_of(bytes(x) if x is not None else b"") for x in content], dtype="int64")


def _polynomial(values: np.ndarray, factor: int, start: int, kind: type) -> int:
    """start x factor^n + the values times falling powers of the factor, modulo 2^bits of the kind: what a loop h = factor h + value ends with."""
    n = len(values)
    if not n:
        return start
    powers = np.cumprod(np.full(n, factor, kind), dtype=kind)
    falling = np.concatenate([powers[:-1][::-1], np.ones(1, kind)])
    total = (values.astype(kind) * falling).sum(dtype=kind) + powers[-1:] * kind(start)
    return int(total[0])


@F.pandas_udf(LongType())
def djb2(content: pd.Series) -> pd.Series:
    """h = 33 h + byte from 5381, modulo 2^32; of a null, that of no bytes."""
    return pd.Series([_polynomial(np.frombuffer(bytes(x) if x is not None else b"", np.uint8), 33, 5381, np.uint32) for x in content], dtype="int64")


@F.pandas_udf(LongType())
def fnv1a(content: pd.Series) -> pd.Series:
    """FNV-1a of 32 bits: xor a byte, times 16777619, modulo 2^32."""

    def one(data: bytes) -> int:
        h = 2166136261
        for byte in data:
            h = ((h ^ byte) * 16777619) & _M
        return h

    return pd.Series([one(bytes(x) if x is not None else b"") for x in content], dtype="int64")


@F.pandas_udf(StringType())
def frame_hash(content: pd.Series) -> pd.Series:
    """h = 31 h + byte + position, modulo 2^64, in decimal digits."""
    out = []
    for x in content:
        data = np.frombuffer(bytes(x) if x is not None else b"", np.uint8)
        out.append(str(_polynomial(data.astype(np.uint64) + np.arange(len(data), dtype=np.uint64), 31, 0, np.uint64)))
    return pd.Series(out, dtype="object")
