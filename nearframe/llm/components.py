"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearframe.llm.common import Scratch


def _oriented(e: DataFrame) -> DataFrame:
    return e.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, root) of every node that has an edge; edges: (u long, v long). root: the smallest node reachable.

    Each step only sends a node's smallest neighbour to its other neighbours, so the rows of a step never
    exceed twice the edges, and joins on a node of high degree can be split. Self-edges and null ends are
    ignored, repeated edges count once, an empty table gives an empty table.
    """
    e = scratch.write(_oriented(edges.where("u is not null and v is not null")), "edges")
    state = None
    while True:
        now = e.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        if tuple(now) == state or not now["n"]:
            break
        state = tuple(now)
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # written, so that the join can be split at a node of very many edges
        least = scratch.write(both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m")), "least")
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        star = _oriented(large)
        low = star.groupBy("u").agg(F.min("v").alias("m"))
        small = star.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        nxt = scratch.write(_oriented(small.union(low.select("u", F.col("m").alias("v")))), "edges")
        scratch.drop(e, least)
        e = nxt
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
        e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    )
