"""Fixed-degree proximity graphs: exact k-NN edges, detour pruning, reverse edges, merge.

Edges are rows (src, dst, rank[, dist]); rank is 0-based. A missing neighbour is an absent row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from nearframe.operators.blocks import copied, packed
from nearframe.operators.exact import STRIP, knn, searched
from nearframe.operators.quantize import assign, probe
from nearframe.sources.staging import stage


def knn_graph(rows: DataFrame, degree: int, metric: str = "l2") -> DataFrame:
    """(src, dst, rank, dist): the `degree` nearest others of each vector; ties go to the lower id."""
    found = knn(rows.select(F.col("id").alias("q"), "v"), rows, degree, metric, exclude_self=True)
    return found.select(F.col("q").alias("src"), F.col("id").alias("dst"), (F.col("rank") - 1).alias("rank"), "dist")


def subgraph(rows: DataFrame, centres: DataFrame, degree: int, metric: str = "l2", probes: int = 1) -> DataFrame:
    """Edges (src, dst, dist, rank) within cells only: each vector's nearest others among those of its own cell.

    probes: a vector also looks for neighbours in the next nearest cells, the more the nearer the graph comes to the exact
    one. The askers of a cell are cut into strips, each is shown the members of the cell block by block in one task, and
    passes on `degree` rows a vector; all pairs of a cell are never rows.
    """
    asks = probe(rows.select(F.col("id").alias("q"), "v"), centres, probes, metric).select("cell", F.col("q").alias("id"), "v")
    has = assign(rows.select("id", "v"), centres, metric).select("cell", "id", "v")
    sizes = stage(asks.where("v is not null and id is not null").groupBy("cell").agg(F.count("*").alias("n")))
    total = sizes.agg(F.sum("n")).first()[0] or 0
    strip = max(256, min(STRIP, total // (4 * rows.sparkSession.sparkContext.defaultParallelism)))
    cut = sizes.select("cell", F.ceil(F.col("n") / F.lit(strip)).alias("n"))
    cut = stage(cut.withColumn("first", F.sum("n").over(Window.orderBy("cell")) - F.col("n")))  # a row a centre
    groups = cut.agg(F.sum("n")).first()[0] or 1
    asks = asks.where("v is not null and id is not null").join(F.broadcast(cut), "cell").select((F.col("first") + F.pmod(F.xxhash64("id"), F.col("n"))).alias("g"), "id", "v")
    has = has.where("v is not null and id is not null").join(F.broadcast(cut), "cell").select(F.col("first").alias("g"), "id", "v")
    seen = packed(has, 1).join(F.broadcast(cut.select(F.col("first").alias("g"), "n")), "g")
    scored = searched(packed(asks, 0), copied(seen, F.col("g"), F.col("n")).drop("n"), degree, metric, True, groups)
    w = Window.partitionBy("src").orderBy("dist", "dst")
    scored = scored.select(F.col("q").alias("src"), F.col("id").alias("dst"), "dist")
    return scored.withColumn("rank", F.row_number().over(w) - 1).where(F.col("rank") < degree)


def merge_graphs(a: DataFrame, b: DataFrame, degree: int) -> DataFrame:
    """The union of two graphs' edges, ranked again and cut to `degree`."""
    w = Window.partitionBy("src").orderBy("dist", "dst")
    both = a.select("src", "dst", "dist").union(b.select("src", "dst", "dist")).groupBy("src", "dst").agg(F.min("dist").alias("dist"))
    return both.withColumn("rank", F.row_number().over(w) - 1).where(F.col("rank") < degree)


def detour_counts(knn_edges: DataFrame) -> DataFrame:
    """(src, dst, rank, cnt): in how many ways X->Y can go by Z over two edges of better rank each.

    The two-hop join is on Z; its rows are at most edges times degree, and are counted before they meet X->Y. Merge
    joins: edges just below the limit of a broadcast would pass the driver as lists of many times that size.
    """
    e = knn_edges.select("src", "dst", "rank")
    first = e.select(F.col("src").alias("x"), F.col("dst").alias("z"), F.col("rank").alias("r1"))
    second = e.select(F.col("src").alias("z"), F.col("dst").alias("y"), F.col("rank").alias("r2"))
    hops = first.hint("merge").join(second, "z").select("x", "y", F.greatest("r1", "r2").alias("worse"))
    ways = hops.hint("merge").join(e.select(F.col("src").alias("x"), F.col("dst").alias("y"), "rank"), ["x", "y"]).where("worse < rank")
    n = ways.groupBy("x", "y").agg(F.count("*").alias("n")).select(F.col("x").alias("src"), F.col("y").alias("dst"), "n")
    return e.hint("merge").join(n, ["src", "dst"], "left").select("src", "dst", "rank", F.coalesce("n", F.lit(0)).cast("long").alias("cnt"))


def prune(counted: DataFrame, degree: int) -> DataFrame:
    """(src, dst, slot, cnt): the `degree` edges of fewest detours, better rank on ties."""
    w = Window.partitionBy("src").orderBy("cnt", "rank")
    return counted.withColumn("slot", F.row_number().over(w) - 1).where(F.col("slot") < degree).select("src", "dst", "slot", "cnt")


def select_neighbours(knn_edges: DataFrame, degree: int, how: str = "heuristic") -> DataFrame:
    """(src, dst, slot): the nearest `degree` ("simple"), or those of fewest detours ("heuristic")."""
    if how == "simple":
        return knn_edges.where(F.col("rank") < degree).select("src", "dst", F.col("rank").alias("slot"))
    if how == "heuristic":
        return prune(detour_counts(knn_edges), degree).select("src", "dst", "slot")
    raise ValueError("how must be simple or heuristic")


def reverse_edges(pruned: DataFrame, degree: int) -> DataFrame:
    """(node, pred, slot, cnt): edges x->y without y->x, turned round; half the degree of fewest detours a node.

    A node that very many point at is cut by a limit that starts before the exchange (row_number <= n).
    """
    back = pruned.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    one_way = pruned.hint("merge").join(back, ["src", "dst"], "left_anti")
    w = Window.partitionBy("node").orderBy("cnt", "pred")
    turned = one_way.select(F.col("dst").alias("node"), F.col("src").alias("pred"), "cnt")
    return turned.withColumn("slot", F.row_number().over(w) - 1).where(F.col("slot") < degree // 2)


def merged(pruned: DataFrame, reverse: DataFrame, degree: int) -> DataFrame:
    """(src, slot, dst): reverse edges first, forward edges in what is left of `degree` slots."""
    n = reverse.groupBy("node").agg(F.count("*").alias("n"))
    back = reverse.select(F.col("node").alias("src"), F.col("slot").cast("long").alias("slot"), F.col("pred").alias("dst"))
    ahead = pruned.hint("merge").join(n, F.col("src") == F.col("node"), "left").select("src", (F.col("slot") + F.coalesce("n", F.lit(0))).cast("long").alias("slot"), "dst")
    return back.union(ahead.where(F.col("slot") < degree))


def build(rows: DataFrame, candidates: int, degree: int, metric: str = "l2", staged: bool = True, centres: DataFrame | None = None, probes: int = 4) -> DataFrame:
    """The pruned and merged graph (src, slot, dst) of vectors (id, v); k-NN edges are computed once.

    Without centres the k-NN edges are exact, at the cost of all pairs by blocks; with centres each vector looks in the
    `probes` nearest cells only, which is how to build graphs of very many vectors.
    """
    keep = stage if staged else (lambda df: df)
    edges = keep(knn_graph(rows, candidates, metric) if centres is None else subgraph(rows, centres, candidates, metric, probes))
    pruned = keep(prune(detour_counts(edges), degree))
    return merged(pruned, reverse_edges(pruned, degree), degree)


def degree_stats(graph: DataFrame) -> DataFrame:
    """One row: nodes, edges, least and greatest out-degree, greatest in-degree."""
    out = graph.groupBy("src").agg(F.count("*").alias("d"))
    into = graph.groupBy("dst").agg(F.count("*").alias("d"))
    a = out.agg(F.count("*").alias("nodes"), F.sum("d").alias("edges"), F.min("d").alias("min_out"), F.max("d").alias("max_out"))
    return a.select("*", into.agg(F.max("d")).scalar().alias("max_in"))
