"""Array workloads: sums, prefix sums, point and block access, upserts, skewed access patterns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def vector_add(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y)


def prefix_sum(df: DataFrame, key: str, value: Column, width: int, out: str = "running") -> DataFrame:
    """Adds the running sum of value in order of a whole-number key, inclusive; equal keys count together.

    Two passes: sums within ranges of `width` keys, and a running sum over the ranges' totals alone.
    """
    cut = df.withColumn("__range", F.floor(F.col(key) / F.lit(width))).withColumn("__x", value)
    totals = cut.groupBy("__range").agg(F.sum("__x").alias("t"))
    before = totals.select("__range", F.coalesce(F.sum("t").over(Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    own = F.sum("__x").over(Window.partitionBy("__range").orderBy(key).rangeBetween(Window.unboundedPreceding, 0))
    return cut.join(before, "__range").withColumn(out, own + F.col("__before")).drop("__range", "__x", "__before")


def point_lookup(df: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """Rows of df for each wanted key, one for each time it is wanted; absent keys give none."""
    return keys.select(key).join(df, key)


def block_read(df: DataFrame, key: str, first: int, blocks: int, block: int) -> DataFrame:
    """Rows whose key is in `blocks` consecutive blocks of `block` keys from block `first` on (pushed to the scan)."""
    return df.where((F.col(key) >= first * block) & (F.col(key) < (first + blocks) * block))


def block_pick(df: DataFrame, key: str, wanted: DataFrame, block: int) -> DataFrame:
    """Rows of the blocks (column block) of `block` keys that are wanted, in any order; a block wanted twice counts once."""
    return df.withColumn("block", F.floor(F.col(key) / block).cast("long")).join(wanted.select("block").distinct(), "block", "left_semi")


def cache_hits(accesses: DataFrame, order: str, page: str, slots: int) -> DataFrame:
    """Adds ``hit``: whether a direct-mapped cache of so many slots holds the page when it is accessed, in order.

    A slot holds the page last accessed among those that share it, so each slot is a sequence of its own.
    """
    w = Window.partitionBy("__slot").orderBy(order)
    held = accesses.withColumn("__slot", F.pmod(F.col(page), F.lit(slots)))
    return held.withColumn("hit", F.coalesce(F.lag(page).over(w) == F.col(page), F.lit(False))).drop("__slot")


def metric_averages(log: DataFrame, keys: list[str], metrics: list[str]) -> DataFrame:
    """Average of each metric over the rows of a log that agree in the keys; null measurements don't count."""
    return log.groupBy(*keys).agg(*[F.avg(m).alias(m) for m in metrics])


def upsert(base: DataFrame, changes: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """base with the latest change of each key: larger `order` wins, a change wins over base on ties."""
    both = base.withColumn("__new", F.lit(0)).unionByName(changes.withColumn("__new", F.lit(1)))
    w = Window.partitionBy(*key).orderBy(*[F.desc(c) for c in order], F.desc("__new"))
    return both.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n", "__new")


def zipf_keys(spark: SparkSession, draws: int, keys: int, exponent: float) -> DataFrame:
    """(i, key): draws from a Zipf law over 1..keys by inverting its distribution at fixed, evenly mixed places."""
    mass = [(k + 1) ** -exponent for k in range(keys)]
    total, cumulated, cuts = sum(mass), 0.0, []
    for m in mass:
        cumulated += m
        cuts.append(cumulated / total)
    place = ((F.col("id") * 7919 + 13) % draws) / F.lit(float(draws))
    below = F.size(F.filter(F.array(*[F.lit(c) for c in cuts]), lambda c: c <= place))
    return spark.range(draws).select(F.col("id").alias("i"), F.least(below + 1, F.lit(keys)).cast("long").alias("key"))
