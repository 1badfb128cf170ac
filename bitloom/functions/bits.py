"""Bit-level column expressions: BF16 fields, codes as strings, natural order keys. All of them stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def bf16_bits(value: Column) -> Column:
    """The upper 16 bits of a float32. ``log2`` may be off by one next to powers of two, so its floor is mended by comparing."""
    x = F.abs(value.cast("double"))
    rough = F.floor(F.log2(x)).cast("double")
    e = rough + F.when(x >= F.pow(F.lit(2.0), rough + 1), 1).otherwise(0) - F.when(x < F.pow(F.lit(2.0), rough), 1).otherwise(0)
    normal = (e + 127) * 128 + F.floor((x / F.pow(F.lit(2.0), e) - 1) * 128)
    size = F.when(x == 0, F.lit(0)).when(F.isnan(x), F.lit(0x7FC0)).when(x == float("inf"), F.lit(255 * 128)).when(x < 2.0**-126, F.floor(x * 2.0**133)).otherwise(normal)
    return (size + F.when(value < 0, 32768).otherwise(0)).cast("int")


def exponent(w: Column) -> Column:
    return F.shiftrightunsigned(w, 7).bitwiseAND(255)


def sign_mantissa(w: Column) -> Column:
    return F.shiftrightunsigned(w, 8).bitwiseAND(128).bitwiseOR(w.bitwiseAND(127))


def recombine(e: Column, sm: Column) -> Column:
    return F.shiftleft(sm.bitwiseAND(128), 8).bitwiseOR(F.shiftleft(e, 7)).bitwiseOR(sm.bitwiseAND(127))


def code_string(bits: str, val: str) -> Column:
    """A code as its binary digits."""
    return F.expr(f"lpad(bin({val}), {bits}, '0')")


def natural_key(name: Column) -> Column:
    """A string that sorts names by their digit runs as numbers: every run is padded to 39 digits."""
    runs = F.regexp_extract_all(name, F.lit(r"(\d+|\D+)"), 1)
    return F.array_join(F.transform(runs, lambda x: F.when(x.rlike(r"^\d+$"), F.lpad(F.regexp_replace(x, "^0+(?=.)", ""), 39, "0")).otherwise(x)), "")
