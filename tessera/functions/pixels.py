"""Colour transforms of single pixels, as Column expressions on channels from 0 to 255."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Weights of red, green and blue in brightness (fixed values).
LUMA = (0.299, 0.587, 0.114)


def clamp(v: Column, low: float = 0, high: float = 255) -> Column:
    return F.least(F.greatest(v, F.lit(low)), F.lit(high))


def to_yuv(r: Column, g: Column, b: Column) -> tuple[Column, Column, Column]:
    """Integer BT.601, with arithmetic shifts."""
    return (
        clamp(F.shiftright(77 * r + 150 * g + 29 * b + 128, 8)),
        clamp(F.shiftright(-43 * r - 85 * g + 128 * b + 128, 8) + 128),
        clamp(F.shiftright(128 * r - 107 * g - 21 * b + 128, 8) + 128),
    )


def from_yuv(y: Column, u: Column, v: Column) -> tuple[Column, Column, Column]:
    u, v = u - 128, v - 128
    return clamp(y + F.shiftright(359 * v + 128, 8)), clamp(y - F.shiftright(88 * u + 183 * v + 128, 8)), clamp(y + F.shiftright(454 * u + 128, 8))


def gray(r: Column, g: Column, b: Column) -> Column:
    return F.floor(LUMA[0] * r + LUMA[1] * g + LUMA[2] * b + 0.5)


def drop_bits(v: Column, shift: int) -> Column:
    """The channel without its lowest bits, seven at most."""
    return v.bitwiseAND((0xFF << min(shift, 7)) & 0xFF)


def posterize(v: Column, bits: int) -> Column:
    return F.shiftleft(F.shiftright(v, 8 - bits), 8 - bits)


def shift_for(quality: Column) -> Column:
    return F.when(quality <= 20, 3).when(quality <= 40, 2).otherwise(1)


def hsv(r: Column, g: Column, b: Column) -> tuple[Column, Column, Column]:
    """Hue in degrees, saturation and value from 0 to 1."""
    most, least = F.greatest(r, g, b), F.least(r, g, b)
    d = most - least
    hue = F.when(d == 0, 0.0).when(most == r, 60.0 * ((g - b) / d)).when(most == g, 60.0 * ((b - r) / d + 2)).otherwise(60.0 * ((r - g) / d + 4))
    return F.when(hue < 0, hue + 360.0).otherwise(hue), F.when(most == 0, 0.0).otherwise(d / most), most / 255.0


def from_hsv(h: Column, s: Column, v: Column) -> tuple[Column, Column, Column]:
    c = v * s
    x = c * (1 - F.abs(h / 60.0 - 2 * F.floor(h / 120.0) - 1))
    sector = F.floor(h / 60.0) % 6
    table = ((c, x, F.lit(0.0)), (x, c, F.lit(0.0)), (F.lit(0.0), c, x), (F.lit(0.0), x, c), (x, F.lit(0.0), c), (c, F.lit(0.0), x))

    def channel(i: int) -> Column:
        pick = reduce(lambda rest, k: F.when(sector == k, table[k][i]).otherwise(rest), range(4, -1, -1), table[5][i])
        return F.floor((pick + v - c) * 255 + 0.5)

    return channel(0), channel(1), channel(2)


def linear(v: Column) -> Column:
    """sRGB channel to linear light, in closed form."""
    v = v / 255.0
    return F.when(v <= 0.04045, v / 12.92).otherwise(F.pow((v + 0.055) / 1.055, F.lit(2.4)))


def srgb(v: Column) -> Column:
    return F.floor(255 * F.when(v <= 0.0031308, 12.92 * v).otherwise(1.055 * F.pow(v, F.lit(1 / 2.4)) - 0.055) + 0.5)


def lab(r: Column, g: Column, b: Column) -> tuple[Column, Column, Column]:
    """CIE Lab under D65."""
    lr, lg, lb = linear(r), linear(g), linear(b)
    x = (0.4124564 * lr + 0.3575761 * lg + 0.1804375 * lb) / 0.95047
    y = 0.2126729 * lr + 0.7151522 * lg + 0.0721750 * lb
    z = (0.0193339 * lr + 0.1191920 * lg + 0.9503041 * lb) / 1.08883

    def f(t: Column) -> Column:
        return F.when(t > 0.008856, F.cbrt(t)).otherwise(7.787 * t + 16 / 116)

    return 116 * f(y) - 16, 500 * (f(x) - f(y)), 200 * (f(y) - f(z))


def brightness(v: Column, by: int = 25) -> Column:
    return clamp(v + by)


def contrast(v: Column) -> Column:
    """A fifth more contrast around the middle; the quotient is cut towards zero."""
    d = (v - 128) * 12
    return clamp(F.when(d >= 0, F.floor(d / 10)).otherwise(F.ceil(d / 10)) + 128)


def saturate(v: Column, least: Column) -> Column:
    return clamp(F.floor(v + (v - least) * 0.3))


def weighted_distance(a: tuple, b: tuple) -> Column:
    """Sum of the squared differences in linear light, by brightness weights."""
    return reduce(lambda x, y: x + y, (w * F.pow(linear(p) - linear(q), F.lit(2)) for w, p, q in zip(LUMA, a, b, strict=True)))
