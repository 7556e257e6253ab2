"""Scalar and vector mathematics, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cross(a: tuple, b: tuple) -> tuple[Column, Column, Column]:
    return a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]


def scaled(a: Column, k: Column) -> Column:
    return F.transform(a, lambda x: x * k)


def normalized(a: Column, least: float = 1e-10) -> Column:
    """The vector at length one; one that is too short stays as it is."""
    n = norm(a)
    return F.transform(a, lambda x: x.cast("double") / F.when(n > least, n).otherwise(1.0))


def clamp(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.least(x, F.lit(high)), F.lit(low))


def lerp(a: Column, b: Column, t: Column) -> Column:
    return a + (b - a) * t


def smoothstep(low: float, high: float, x: Column) -> Column:
    t = clamp((x - low) / (high - low), 0.0, 1.0)
    return t * t * (3 - 2 * t)


def reversed_bits(x: Column) -> Column:
    """The 32 bits in reverse order."""
    return F.conv(F.reverse(F.lpad(F.bin(x), 32, "0")), 2, 10).cast("long")


def first_set(x: Column) -> Column:
    """Position of the lowest bit that is set; -1 for zero."""
    return F.when(x == 0, F.lit(-1)).otherwise(F.bit_count(x.bitwiseAND(-x) - F.lit(1))).cast("long")


def next_power(x: Column) -> Column:
    """Smallest power of two that is not below x; 1 for less."""
    return F.when(x <= 1, F.lit(1)).otherwise(F.pow(F.lit(2.0), F.length(F.bin(x - F.lit(1))))).cast("long")


def identity4() -> Column:
    return F.array(*(F.lit(1.0 if i == j else 0.0) for i in range(4) for j in range(4)))


def transposed4(m: Column) -> Column:
    """m: sixteen numbers, row by row."""
    return F.array(*(m[4 * j + i].cast("double") for i in range(4) for j in range(4)))


def product4(a: Column, b: Column) -> Column:
    """The product of two 4 x 4 matrices, row by row."""
    return F.array(*(sum((a[4 * i + k].cast("double") * b[4 * k + j].cast("double") for k in range(1, 4)), a[4 * i].cast("double") * b[j].cast("double")) for i in range(4) for j in range(4)))
