"""Content and picture hashes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BITS, MAX_DISTANCE = 64, 8
#: Bits of the bands: with at most 8 differing bits, one of nine bands is equal.
BAND_WIDTHS = [8, 7, 7, 7, 7, 7, 7, 7, 7]


def sha256_hex(content: Column) -> Column:
    return F.sha2(content, 256)


def hash_bits(hash_col: Column) -> Column:
    """The 64 bits of a hash of 16 hexadecimal digits as a long; anything else is null."""
    half = lambda at: F.conv(F.substring(hash_col, at, 8), 16, 10).cast("long")
    return F.when(hash_col.rlike("^[0-9a-fA-F]{16}\\z"), F.shiftleft(half(1), 32).bitwiseOR(half(9)))


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def similarity(distance: Column) -> Column:
    """1 - distance / 64 with four decimals, halves up."""
    return F.round(1 - distance / BITS, 4)


def bands(bits: Column) -> Column:
    """Array of (band, value) keys; two hashes within MAX_DISTANCE share at least one."""
    out, shift = [], 0
    for i, width in enumerate(BAND_WIDTHS):
        out.append(F.struct(F.lit(i).alias("band"), F.shiftrightunsigned(bits, shift).bitwiseAND(F.lit(2**width - 1)).cast("int").alias("value")))
        shift += width
    return F.array(*out)


def dhash(pixels: Column) -> Column:
    """Difference hash of a 9 x 8 grey grid in rows: a bit says that a pixel is brighter than its right neighbour."""
    bit = lambda i: F.when(F.get(pixels, F.lit(i)) > F.get(pixels, F.lit(i + 1)), "1").otherwise("0")
    half = lambda rows: F.lpad(F.lower(F.conv(F.concat(*[bit(r * 9 + c) for r in rows for c in range(8)]), 2, 16)), 8, "0")
    return F.when(F.size(pixels) == 72, F.concat(half(range(4)), half(range(4, 8))))
