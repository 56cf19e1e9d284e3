"""Closed forms for sizing Bloom filters, as Columns, and the choice of size for a search's visited set."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Expected insertions for each candidate, the highest false-positive rate, and the size limit (2^11 words of 32 bits).
PER_CANDIDATE, TARGET, MOST_BITS = 12.897, 0.03, 11
LN2 = math.log(2)


def bits_per_item(m: Column, n: Column) -> Column:
    return m / n


def hashes_for(r: Column) -> Column:
    """The best number of hashes for r bits an item."""
    return F.round(r * F.lit(LN2))


def false_positives(k: Column, r: Column) -> Column:
    return F.pow(F.lit(1.0) - F.exp(-k / r), k)


def bits_for(k: Column, p: Column) -> Column:
    """Bits an item that give rate p with k hashes."""
    return -k / F.log(F.lit(1.0) - F.exp(F.log(p) / k))


def size_for(n: Column, p: Column) -> Column:
    """Bits in all for n items at rate p with the best number of hashes."""
    return F.ceil(n * F.log(p) / F.lit(-LN2 * LN2))


def capacity_for(m: Column, p: Column) -> Column:
    """Items that m bits hold at rate p with the best number of hashes."""
    return F.ceil(m * F.lit(-LN2 * LN2) / F.log(p))


def capacity_with(k: Column, m: Column, p: Column) -> Column:
    return F.ceil(m / bits_for(k, p))


def size_with(k: Column, n: Column, p: Column) -> Column:
    return F.ceil(n * bits_for(k, p))


def visited_filter(candidates: Column) -> Column:
    """struct<words, log2_words, hashes, p>: the smallest power-of-two size that meets TARGET, else the largest."""
    n = candidates * F.lit(PER_CANDIDATE)

    def option(bit: int) -> Column:
        r = F.lit(float(32 << bit)) / n
        k = hashes_for(r)
        return F.struct(F.lit(1 << bit).alias("words"), F.lit(bit).alias("log2_words"), k.cast("int").alias("hashes"), false_positives(k, r).alias("p"))

    out = option(MOST_BITS)
    for bit in range(MOST_BITS - 1, 0, -1):
        o = option(bit)
        out = F.when(o["p"] < TARGET, o).otherwise(out)
    return out
