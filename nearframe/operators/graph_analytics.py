"""Breadth-first search, connected components, PageRank and shortest paths over edge tables (src, dst[, weight]).

Loops stage their state in the shared folder after each round, so lineage stays short and a lost executor
costs one round.  Rows of a round are linear in edges; joins are on vertex ids, and AQE splits hot ones.  What has been
reached is met in merge joins: as a broadcast it would pass the driver in every round.
"""

from __future__ import annotations

from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nearframe.sources.staging import stage

#: Rounds after which a loop folds its parts into one table (BFS), or asks whether a negative cycle keeps it going.
FOLD, CYCLE_CHECK = 64, 1 << 10


def _limit(level: int, max_rounds: int | None) -> None:
    if max_rounds is not None and level > max_rounds:
        raise RuntimeError(f"not finished after {max_rounds} rounds")


def bfs(edges: DataFrame, source: int, max_rounds: int | None = None) -> DataFrame:
    """(node, level) of what `source` reaches, itself at level 0 (if it is in an edge at all).

    Runs until nothing new is reached; RuntimeError if that takes more levels than max_rounds.
    """
    e = edges.select("src", "dst")
    both = e.select(F.col("src").alias("node")).union(e.select(F.col("dst").alias("node")))
    seen = stage(both.where(F.col("node") == source).limit(1).select("node", F.lit(0).alias("level")))
    frontier = seen
    for level in count(1):
        reached = frontier.join(e, F.col("node") == F.col("src")).select(F.col("dst").alias("node")).distinct()
        frontier = stage(reached.hint("merge").join(seen, "node", "left_anti").select("node", F.lit(level).alias("level")))
        if frontier.isEmpty():
            break
        _limit(level, max_rounds)
        seen = seen.union(frontier)
        seen = stage(seen) if level % FOLD == 0 else seen
    return seen


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node of the component; direction is ignored.

    Large-star and small-star steps: each only sends a node's smallest neighbour to its other neighbours.
    """
    edges = stage(edges.select("src", "dst"))  # they are read three times
    nodes = edges.select(F.col("src").alias("node")).union(edges.select(F.col("dst").alias("node"))).distinct()

    def orient(x: DataFrame) -> DataFrame:
        return x.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()

    e = stage(orient(edges.select(F.col("src").alias("u"), F.col("dst").alias("v"))))
    before = None
    while True:
        now = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == before or not now[0]:
            break
        before = now
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        star = orient(both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")))
        low = star.groupBy("u").agg(F.min("v").alias("m"))
        small = star.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = stage(orient(small.union(low.select("u", F.col("m").alias("v")))))
    return nodes.join(e, F.col("node") == F.col("u"), "left").select("node", F.coalesce("v", "node").alias("component"))


def pagerank(edges: DataFrame, rounds: int = 10, damping: float = 0.85) -> DataFrame:
    """(node, rank) after so many rounds from 1/n; a node without out-edges shares its rank with all."""
    e = edges.select("src", "dst")
    out = e.groupBy("src").agg(F.count("*").alias("deg"))
    nodes = stage(e.select(F.col("src").alias("node")).union(e.select(F.col("dst").alias("node"))).distinct().join(out, F.col("node") == F.col("src"), "left").select("node", "deg"))
    n = nodes.count()
    links = stage(e.join(out, "src"))
    ranks = nodes.select("node", "deg", F.lit(1.0 / max(n, 1)).alias("rank"))
    for _ in range(rounds):
        gifts = links.join(ranks.select("node", "rank"), F.col("src") == F.col("node")).groupBy("dst").agg(F.sum(F.col("rank") / F.col("deg")).alias("got"))
        idle = ranks.where("deg is null").agg(F.coalesce(F.sum("rank"), F.lit(0.0))).scalar()
        new = nodes.join(gifts, F.col("node") == F.col("dst"), "left").select("node", "deg", (F.lit((1 - damping) / n) + F.lit(damping) * (F.coalesce("got", F.lit(0.0)) + idle / F.lit(n))).alias("rank"))
        ranks = stage(new)
    return ranks.select("node", "rank")


def sssp(edges: DataFrame, source: int, weight: Column | None = None, max_rounds: int | None = None) -> DataFrame:
    """(node, dist): least sums of weights from `source`, in rounds; nodes out of reach are absent.

    Runs until nothing improves; RuntimeError if that takes more rounds than max_rounds, ValueError on a negative cycle.
    """
    w = F.col("weight") if weight is None else weight
    e = edges.select("src", "dst", w.alias("weight"))
    kind = e.schema["weight"].dataType
    best = stage(e.select(F.lit(source).cast("long").alias("node"), F.lit(0).cast(kind).alias("dist")).limit(1))
    changed = best
    for level in count(1):
        offers = changed.join(e, F.col("node") == F.col("src")).groupBy("dst").agg(F.min(F.col("dist") + F.col("weight")).alias("offer"))
        better = stage(offers.hint("merge").join(best, F.col("dst") == F.col("node"), "left").where("dist is null or offer < dist").select(F.col("dst").alias("node"), F.col("offer").alias("dist")))
        if better.isEmpty():
            break
        _limit(level, max_rounds)
        # without a negative cycle, a path has no more edges than there are vertices reached
        if level % CYCLE_CHECK == 0 and level > best.count() + better.count():
            raise ValueError("a negative cycle")
        best = stage(best.union(better).groupBy("node").agg(F.min("dist").alias("dist")))
        changed = better
    return best
