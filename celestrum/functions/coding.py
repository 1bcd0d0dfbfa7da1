"""Numbers as bytes and tokens: variable-length integers, zig-zag, wide integers and fingerprints, as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from celestrum.functions.text import _c


def varint_hex(number) -> Column:
    """A non-negative integer in groups of seven bits, the lowest first, each but the last with the eighth bit: as hexadecimal digits."""
    n = _c(number).cast("bigint")
    places = F.filter(F.sequence(F.lit(0), F.lit(8)), lambda k: (k == 0) | (F.call_function("shiftright", n, k * 7) > 0))
    last = F.size(places) - 1
    digit = lambda k: F.call_function("shiftright", n, k * 7).bitwiseAND(F.lit(127)) + F.when(k < last, 128).otherwise(0)
    return F.array_join(F.transform(places, lambda k: F.lpad(F.lower(F.hex(digit(k))), 2, "0")), "")


def from_varint_hex(text) -> Column:
    t = _c(text)
    places = F.sequence(F.lit(0), (F.length(t) / 2).cast("int") - 1)
    byte = lambda k: F.conv(F.substring(t, k * 2 + 1, F.lit(2)), 16, 10).cast("bigint").bitwiseAND(F.lit(127))
    return F.aggregate(places, F.lit(0).cast("bigint"), lambda a, k: a + byte(k) * F.pow(F.lit(128.0), k).cast("bigint"))


def zigzag(number) -> Column:
    """Signed integers as non-negative ones, small ones small."""
    n = _c(number).cast("bigint")
    return F.when(n >= 0, n * 2).otherwise(-n * 2 - 1)


def from_zigzag(number) -> Column:
    n = _c(number).cast("bigint")
    return F.when(n % 2 == 0, F.floor(n / 2)).otherwise(-F.floor(n / 2) - 1).cast("bigint")


def wide_product(a, b) -> Column:
    """Of two 64-bit integers, up to 38 digits."""
    return _c(a).cast("decimal(19,0)") * _c(b).cast("decimal(19,0)")


def fingerprint(text) -> Column:
    """64 bits of the text's MD5, as a hexadecimal number."""
    return F.substring(F.md5(_c(text)), 1, 16)
