"""Beam search on a fixed-degree graph.

State of a query: every vertex it has seen, with distance and the hop at which it was expanded, if it was.  A hop expands the
``width`` nearest unexpanded of the ``beam`` nearest seen, and adds their unseen neighbours. ``hops`` runs that as
DataFrame joins (any graph size, rows bounded by queries x seen); ``in_memory`` runs it in numpy for graphs of
checked size that fit every task, and gives the same result. Neither sends vectors, edges or state by way of the driver:
tasks get the graph from the shuffle, and the joins are merge joins, as a broadcast in every hop adds up there.
"""

from __future__ import annotations

from itertools import count

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from nearframe.functions.distance import distance, vec
from nearframe.operators.blocks import copied, packed, shown, sliced, strips
from nearframe.operators.exact import STRIP, distances, top_k
from nearframe.sources.staging import stage

#: Of the arrays that a task holds. Vectors that are the same in single precision take half of what ``graph_bytes`` says.
MEMORY_BYTES = 512 << 20


def entries(queries: DataFrame, strategy: str, fixed: int = 0, n: int | None = None, prior: DataFrame | None = None) -> DataFrame:
    """(q, v, entry): "fixed" id, "random" (a hash of q, the same every time), or "prior" (q, entry) rows."""
    if strategy == "fixed":
        return queries.select("q", "v", F.lit(fixed).cast("long").alias("entry"))
    if strategy == "random":
        return queries.select("q", "v", F.pmod(F.xxhash64("q"), F.lit(n)).alias("entry"))
    if strategy == "prior":
        return queries.join(prior, "q").select("q", "v", "entry")
    raise ValueError("strategy must be fixed, random or prior")


def _expand(state: DataFrame, queries: DataFrame, base: DataFrame, graph: DataFrame, beam: int, width: int, metric: str, hop: int) -> tuple[DataFrame, DataFrame]:
    near = Window.partitionBy("q").orderBy("dist", "id")
    listed = state.withColumn("r", F.row_number().over(near))
    open_ = listed.where((F.col("r") <= beam) & F.col("hop").isNull()).withColumn("o", F.row_number().over(near)).where(F.col("o") <= width).select("q", "id")
    reached = open_.hint("merge").join(graph.select(F.col("src").alias("id"), "dst"), "id").select("q", F.col("dst").alias("id")).distinct()
    fresh = reached.hint("merge").join(state.select("q", "id"), ["q", "id"], "left_anti")
    scored = fresh.hint("merge").join(queries.select("q", F.col("v").alias("qv")), "q").hint("merge").join(base.select("id", "v"), "id")
    new = scored.select("q", "id", distance(metric, F.col("qv"), F.col("v")).alias("dist"), F.lit(None).cast("int").alias("hop"))
    marked = state.hint("merge").join(open_.withColumn("now", F.lit(hop)), ["q", "id"], "left")
    old = marked.select("q", "id", "dist", F.coalesce("hop", "now").alias("hop"))
    return old.union(new), open_


def hops(queries: DataFrame, base: DataFrame, graph: DataFrame, k: int, beam: int, width: int, max_hops: int | None, metric: str = "l2", until_done: bool = False) -> DataFrame:
    """(q, id, dist, rank, hops, dist_comps, entry) after max_hops hops, or earlier if until_done and nothing is left to expand.

    max_hops None: until nothing is left to expand. hops: those in which the query expanded a vertex; dist_comps: vertices
    it has seen. queries: (q, v, entry); base: (id, v); graph: (src, dst). State is staged after each hop.
    """
    start = queries.hint("merge").join(base.withColumnRenamed("v", "bv"), F.col("entry") == F.col("id"))
    state = start.select("q", "id", distance(metric, F.col("v"), F.col("bv")).alias("dist"), F.lit(None).cast("int").alias("hop"))
    state = stage(state)
    for hop in count(1) if max_hops is None else range(1, max_hops + 1):
        grown, open_ = _expand(state, queries, base, graph, beam, width, metric, hop)
        if (until_done or max_hops is None) and open_.isEmpty():
            break
        state = stage(grown)
    counts = state.groupBy("q").agg(F.coalesce(F.max("hop"), F.lit(0)).alias("hops"), F.count("*").alias("dist_comps"))
    found = top_k(state.select("q", "id", "dist"), k).hint("merge").join(counts, "q").hint("merge").join(queries.select("q", "entry"), "q")
    return found.select("q", "id", "dist", F.col("rank").cast("int").alias("rank"), "hops", "dist_comps", F.col("entry").cast("long").alias("entry"))


def graph_bytes(base: DataFrame, graph: DataFrame) -> int:
    """Bytes of the arrays that a task of ``in_memory`` holds: vectors, ids, places, and two numbers an edge."""
    vectors = base.agg(F.sum(F.size("v") * 8 + 16)).first()[0] or 0
    return vectors + 16 * graph.count()


class _Graph:
    """Vectors and edges by place, places in order of ids; edges to or from what is no vertex are left out."""

    def __init__(self, vertices: list):
        ids = np.concatenate([b.ids for b in vertices])
        order = np.argsort(ids, kind="stable")
        place = np.empty(len(ids), np.int64)
        place[order] = np.arange(len(ids))
        self.ids = ids[order]
        self.v = np.empty((len(ids), vertices[0].v.shape[1]), np.result_type(*(b.v.dtype for b in vertices)))
        end = len(ids)
        while vertices:  # the last first, so that no block is held twice
            b = vertices.pop()
            self.v[place[end - len(b.ids) : end]] = b.v
            end -= len(b.ids)
        self.edges: list[tuple[np.ndarray, np.ndarray]] = []

    def add(self, src: np.ndarray, dst: np.ndarray) -> None:
        at = [np.minimum(np.searchsorted(self.ids, x), len(self.ids) - 1) for x in (src, dst)]
        known = (self.ids[at[0]] == src) & (self.ids[at[1]] == dst)
        self.edges.append(tuple(x[known].astype(np.int32) for x in at))

    def close(self) -> None:
        src, dst = (np.concatenate(x) for x in zip(*self.edges, strict=True)) if self.edges else (np.empty(0, np.int32),) * 2
        self.edges = []
        self.near = dst[np.argsort(src, kind="stable")]
        self.first = np.concatenate([[0], np.cumsum(np.bincount(src, minlength=len(self.ids)))])  # neighbours of i: near[first[i]:first[i + 1]]


def in_memory(queries: DataFrame, base: DataFrame, graph: DataFrame, k: int, beam: int, width: int, metric: str = "l2", max_hops: int = 1 << 30) -> DataFrame:
    """The same search in each task, with (q, id, dist, rank, hops, dist_comps, entry); ValueError beyond MEMORY_BYTES.

    Queries are cut into strips, and a strip's task is shown the vectors, the edges and its queries, in that order.
    """
    if graph_bytes(base, graph) > MEMORY_BYTES:
        raise ValueError("the graph is too large to send to every task; use hops()")
    held = max(k, beam)

    def one(g: _Graph, q: np.ndarray, entry: int) -> tuple[list[tuple[float, int]], int, int]:
        at = int(np.searchsorted(g.ids, entry))
        if at == len(g.ids) or g.ids[at] != entry:
            return [], 0, 0
        to = lambda places: distances(metric, q[None, :], g.v[places].astype(np.float64))[0]
        seen = np.zeros(len(g.ids), bool)
        seen[at] = True
        # the `held` nearest seen, in order of (distance, id); what falls out can't come back
        best, done = np.array([at]), np.zeros(1, bool)
        dist = to(best)
        n_hops = 0
        while n_hops < max_hops:
            open_ = np.flatnonzero(~done[:beam])[:width]
            if not len(open_):
                break
            n_hops += 1
            done[open_] = True
            fresh = np.unique(np.concatenate([g.near[g.first[i] : g.first[i + 1]] for i in best[open_]]))
            fresh = fresh[~seen[fresh]]
            if len(fresh):
                seen[fresh] = True
                best, dist = np.concatenate([best, fresh]), np.concatenate([dist, to(fresh)])
                done = np.concatenate([done, np.zeros(len(fresh), bool)])
                keep = np.lexsort((best, dist))[:held]  # places are in order of ids
                best, dist, done = best[keep], dist[keep], done[keep]
        return list(zip(dist[:k].tolist(), g.ids[best[:k]].tolist(), strict=True)), n_hops, int(seen.sum())

    def run(stream):
        strip, vertices, g, closed = None, [], None, False
        for b in stream:
            if b.g != strip:
                strip, vertices, g, closed = b.g, [], None, False
            if b.side == 0:
                vertices.append(b)
                continue
            if g is None and vertices:
                g = _Graph(vertices)
            if g is None:
                continue  # no vertex
            if b.side == 1:
                g.add(b.ids, b.more[:, 0])
                continue
            if not closed:
                g.close()
                closed = True
            out = []
            for q, v, entry in zip(b.ids.tolist(), b.v.astype(np.float64), b.more[:, 0].tolist(), strict=True):
                found, n_hops, comps = one(g, v, entry)
                out += [(q, i, d, r + 1, n_hops, comps, entry) for r, (d, i) in enumerate(found)]
            if out:
                kinds = (np.int64, np.int64, np.float64, np.int32, np.int32, np.int64, np.int64)
                yield from sliced([np.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], ["q", "id", "dist", "rank", "hops", "dist_comps", "entry"])

    asks = queries.select("q", vec("v").alias("v"), F.col("entry").cast("long").alias("entry")).where("q is not null and v is not null and entry is not null")
    groups = strips(base.sparkSession, asks.count(), STRIP, 16)
    to_all = (F.lit(0), F.lit(groups))
    vertices = copied(packed(base.where("v is not null and id is not null").select(F.lit(0).alias("g"), "id", vec("v").alias("v")), 0), *to_all)
    none = F.array().cast("array<double>")
    arrows = copied(packed(graph.where("src is not null and dst is not null").select(F.lit(0).alias("g"), F.col("src").alias("id"), none.alias("v"), F.array(F.col("dst").cast("long")).alias("more")), 1), *to_all)
    asks = packed(asks.select(F.pmod(F.xxhash64("q"), F.lit(groups)).alias("g"), F.col("q").alias("id"), "v", F.array("entry").alias("more")), 2)
    return shown([vertices, arrows, asks], run, "q long, id long, dist double, rank int, hops int, dist_comps long, entry long", groups)


def beam_search(queries: DataFrame, base: DataFrame, graph: DataFrame, k: int, beam: int, width: int, metric: str = "l2") -> DataFrame:
    """In memory where the graph's size allows it, by joins otherwise: the same rows and columns."""
    if graph_bytes(base, graph) <= MEMORY_BYTES:
        return in_memory(queries, base, graph, k, beam, width, metric)
    return hops(queries, base, graph, k, beam, width, None, metric)


def merge_lists(candidates: DataFrame, incoming: DataFrame, beam: int) -> DataFrame:
    """The `beam` smallest of two scored lists (q, id, dist, visited) without repeats; flags move with entries."""
    new = incoming.join(candidates.select("q", "id"), ["q", "id"], "left_anti").dropDuplicates(["q", "id"])
    return top_k(candidates.select("q", "id", "dist", "visited").union(new.select("q", "id", "dist", "visited")), beam)
