"""Bit packing, bit reversal and seeded hashing on integer columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def pack32(high: Column, low: Column) -> Column:
    """Two ids below 2^32 in one number."""
    return F.shiftleft(high.cast("bigint"), 32).bitwiseOR(low.cast("bigint").bitwiseAND(0xFFFFFFFF))


def high32(packed: Column) -> Column:
    return F.shiftrightunsigned(packed, 32)


def low32(packed: Column) -> Column:
    return packed.bitwiseAND(F.lit(0xFFFFFFFF).cast("bigint"))


def reverse_bits(x: Column, width: int) -> Column:
    """The lowest `width` bits in opposite order."""
    return F.conv(F.reverse(F.lpad(F.bin(x), width, "0")), 2, 10).cast("bigint")


def uniform(seed: int, *cols: Column | str) -> Column:
    """A number in [0, 1) that depends on the columns and the seed alone."""
    return F.pmod(F.xxhash64(*cols, F.lit(seed)), F.lit(1 << 52)) / float(1 << 52)


def scramble(x: Column, scale: int, seed: int) -> Column:
    """A bijection of [0, 2^scale): odd multiplication, bit reversal, addition, each modulo 2^scale."""
    size = 1 << scale
    odd = (seed * 2 + 1) % size | 1
    product = (x.cast("decimal(38,0)") * odd % size).cast("bigint")
    return F.pmod(reverse_bits(product, scale) + (seed * 7919 + 13) % size, F.lit(size))
