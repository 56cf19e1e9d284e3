"""Whole-number helpers as Columns: rounding to multiples, powers of two, bit counts, hashes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def div_down(a: Column, b: Column) -> Column:
    return F.floor(a / b).cast("long")


def div_up(a: Column, b: Column) -> Column:
    return F.ceil(a / b).cast("long")


def round_down(a: Column, b: Column) -> Column:
    return div_down(a, b) * b


def round_up(a: Column, b: Column) -> Column:
    return div_up(a, b) * b


def power(n: Column, e: int) -> Column:
    out = F.lit(1).cast("long")
    for _ in range(e):
        out = out * n
    return out


def power_of_two(n: Column) -> Column:
    return F.pow(F.lit(2), n).cast("long")


def log_two(n: Column) -> Column:
    """Floor of the binary logarithm, from the length of the binary form (no rounding of floats)."""
    return (F.length(F.bin(n)) - 1).cast("int")


def is_power_of_two(n: Column) -> Column:
    return (n > 0) & (n.bitwiseAND(n - 1) == 0)


def next_power_of_two(n: Column) -> Column:
    """The next strictly higher power of two."""
    return F.pow(F.lit(2), log_two(n) + 1).cast("long")


def first_set_bit(n: Column) -> Column:
    """1-based place of the lowest set bit, 0 for 0."""
    return F.when(n == 0, F.lit(0)).otherwise(log_two(n.bitwiseAND(-n)) + 1).cast("int")


def bit_count(n: Column) -> Column:
    return F.bit_count(n)


def spread_hash(*c: Column) -> Column:
    return F.xxhash64(*c)


def swap_if(condition: Column, a: Column, b: Column) -> tuple[Column, Column]:
    """(b, a) where the condition holds, else (a, b); a null condition does not hold."""
    return F.when(condition, b).otherwise(a), F.when(condition, a).otherwise(b)


def assign_if(condition: Column, old: Column, new: Column) -> Column:
    """new where the condition holds, else old."""
    return F.when(condition, new).otherwise(old)
