"""Repeatable random numbers and hash buckets, the same on every engine that has MD5."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TWO_32 = 4294967296
TWO_60 = 1 << 60


def hash32(*parts: Column | str | int) -> Column:
    """First 32 bits of the MD5 of the parts joined by ``|``, as BIGINT in [0, 2^32)."""
    columns = [p if isinstance(p, Column) else F.lit(str(p)) for p in parts]
    text = columns[0].cast("string") if len(columns) == 1 else F.concat_ws("|", *columns)
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint")


def hash60(*parts: Column | str | int) -> Column:
    """First 60 bits of the MD5 of the parts joined by ``|``, as BIGINT in [0, 2^60)."""
    columns = [p if isinstance(p, Column) else F.lit(str(p)) for p in parts]
    text = columns[0].cast("string") if len(columns) == 1 else F.concat_ws("|", *columns)
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("bigint")


def scaled(draw: Column, size: Column) -> Column:
    """Map a 60-bit draw to 0 .. size-1, for sizes up to 2^60, in exact integer arithmetic.

    It is the product's upper half. Both factors are cut into halves of 30 bits, so that nothing overflows.
    """
    half = (1 << 30) - 1
    h_1, h_0, s_1, s_0 = F.shiftright(draw, 30), draw.bitwiseAND(half), F.shiftright(size, 30), size.bitwiseAND(half)
    return h_1 * s_1 + F.shiftright(h_1 * s_0 + h_0 * s_1 + F.shiftright(h_0 * s_0, 30), 30)


def uniform(draw: Column) -> Column:
    return draw / F.lit(float(TWO_32))


def normal(draw_1: Column, draw_2: Column) -> Column:
    """Standard normal number from two 32-bit draws (Box-Muller)."""
    u_1 = (draw_1 + 1) / F.lit(float(TWO_32 + 1))
    return F.sqrt(F.lit(-2.0) * F.log(u_1)) * F.cos(F.lit(6.283185307179586) * uniform(draw_2))
