"""Exact nearest neighbours: a stated query set against all rows, in blocks.

Base vectors stay where they are.  A query set of at most ``BROADCAST_BYTES`` and ``SENT`` rows is sent to every task, and
each task keeps its k best for each query, so that k rows for each query and task are shuffled to the final top-k.
A larger query set is cut into strips, and each strip's task is shown the base block by block and keeps the k best.
All pairs are never rows: a product in single precision, with a bound on its error, sifts a block, and what may be
among the k best is measured in double precision, so the sieve changes no result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from nearframe.functions.distance import METRICS, vec
from nearframe.operators.blocks import BLOCK, copied, packed, shown, sliced, strips

BROADCAST_BYTES = 32 << 20
#: Queries that are sent at most: with more, strips share the work out evenly, however few files the base has.
SENT = 8192
#: Queries of a strip at most, queries that are sifted at a time, and pairs that are measured or merged at a time.
STRIP, TILE, PAIRS, MERGE = 65_536, 512, 16_384, 1 << 20
#: Norms up to which the sieve works; beyond it, all pairs are measured.
SIFTED = 1e15
SCHEMA = "q long, id long, dist double"


def distances(metric: str, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """(len(a), len(b)) distances in double precision; differences are squared, not expanded."""
    if metric == "l2":
        out = np.empty((len(a), len(b)))
        for i, x in enumerate(a):
            d = b - x
            out[i] = np.sqrt(np.einsum("ij,ij->i", d, d))
        return out
    product = a @ b.T
    if metric == "ip":
        return -product
    size = np.linalg.norm(a, axis=1)[:, None] * np.linalg.norm(b, axis=1)[None, :]
    return np.where(size == 0, 2.0, 1.0 - product / np.where(size == 0, 1.0, size))


def pairwise(metric: str, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distances of the rows of a to those of b, one to one, as in ``distances``."""
    if metric == "l2":
        d = b - a
        return np.sqrt(np.einsum("ij,ij->i", d, d))
    product = np.einsum("ij,ij->i", a, b)
    if metric == "ip":
        return -product
    size = np.linalg.norm(a, axis=1) * np.linalg.norm(b, axis=1)
    return np.where(size == 0, 2.0, 1.0 - product / np.where(size == 0, 1.0, size))


def _places(mask: np.ndarray) -> np.ndarray:
    """Flat places of what is true in a mask that is mostly false: eight at a time first."""
    flat = mask.reshape(-1)
    whole = len(flat) // 8 * 8
    some = np.flatnonzero(flat[:whole].view(np.uint64) != 0)
    near = (some[:, None] * 8 + np.arange(8)).reshape(-1)
    return np.concatenate([near[flat[near]], whole + np.flatnonzero(flat[whole:])])


class Nearest:
    """The k nearest for each of some queries among what ``add`` has shown, lower id on ties; held: k rows a query.

    The sieve: for "l2" (d^2 - |a|^2) / 2 = |b|^2 / 2 - ab, for "ip" -ab, for "cos" -ab / |a||b| (1 where b is zero), all of
    them a product of rows that have one more column. In single precision it is off by `slack` at most, so a pair
    above the k-th distance held by more than that is not among the k best. What is left is measured.
    """

    def __init__(self, metric: str, q: np.ndarray, qv: np.ndarray, k: int, exclude_self: bool):
        order = np.argsort(q, kind="stable")
        self.metric, self.k, self.exclude_self = metric, k, exclude_self
        self.q, self.v = q[order], np.asarray(qv, np.float64)[order]
        self.size = np.linalg.norm(self.v, axis=1)
        self.dist, self.id, self.seen = np.empty((len(q), 0)), np.empty((len(q), 0), np.int64), 0
        self.far = np.full(len(q), np.inf)
        self.found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.score, self.mask = np.empty(TILE * BLOCK, np.float32), np.empty(TILE * BLOCK, bool)
        self.small = not len(q) or bool(self.size.max() < SIFTED)  # not of a NaN either
        if self.small:
            side, one = self.v, np.ones(len(q))
            if metric == "cos":
                side, one = self.v / np.where(self.size == 0, 1.0, self.size)[:, None], self.size > 0
            elif metric == "ip":
                one = np.zeros(len(q))
            self.left = np.concatenate([-side, np.asarray(one, np.float64)[:, None]], axis=1).astype(np.float32)

    def add(self, ids: np.ndarray, v: np.ndarray, rows: np.ndarray | None = None) -> None:
        """Shows vectors to all queries, or to those in the given rows."""
        for lo in range(0, len(ids) if len(self.q) else 0, BLOCK):
            self._add(ids[lo : lo + BLOCK], np.asarray(v[lo : lo + BLOCK], np.float64), np.arange(len(self.q)) if rows is None else rows)

    def _add(self, ids: np.ndarray, v: np.ndarray, rows: np.ndarray) -> None:
        self.seen += len(ids)
        more = min(self.k, self.seen) - self.dist.shape[1]
        if more > 0:
            self.dist = np.concatenate([self.dist, np.full((len(self.q), more), np.inf)], axis=1)
            self.id = np.concatenate([self.id, np.zeros((len(self.q), more), np.int64)], axis=1)
        size = np.linalg.norm(v, axis=1)
        top = float(size.max())
        sift = self.small and top < SIFTED
        if sift:
            side, one = v, size**2 / 2
            if self.metric == "cos":
                side, one, top = v / np.where(size == 0, 1.0, size)[:, None], size == 0, 1.0
            right = np.ascontiguousarray(np.concatenate([side, np.asarray(one, np.float64)[:, None]], axis=1).astype(np.float32).T)
        lo, hi = (np.searchsorted(self.q, ids, side=s) for s in ("left", "right"))
        own = np.flatnonzero(hi > lo) if self.exclude_self else np.empty(0, np.int64)
        own_row = np.concatenate([np.arange(lo[j], hi[j]) for j in own]) if len(own) else own
        own_col = np.repeat(own, hi[own] - lo[own])
        wait = min(MERGE, len(self.q) * self.k // 2)
        for at in (rows[i : i + TILE] for i in range(0, len(rows), TILE)):
            score, mask = (x[: len(at) * len(ids)].reshape(len(at), -1) for x in (self.score, self.mask))
            if sift:
                np.matmul(self.left[at], right, out=score)
                mine = np.flatnonzero((own_row >= at[0]) & (own_row <= at[-1]))
                if len(mine):
                    place = np.searchsorted(at, own_row[mine])
                    here = at[place] == own_row[mine]
                    score[place[here], own_col[mine][here]] = np.inf
                np.less_equal(score, self._limit(at, score, top)[:, None], out=mask)
            else:
                mask.fill(True)
            flat = _places(mask)
            r, c = np.divmod(flat, len(ids))
            if self.metric == "l2" and len(flat) > mask.size // 8:
                d = distances(self.metric, self.v[at], v).reshape(-1)[flat]
            else:
                d = np.concatenate([np.empty(0), *(pairwise(self.metric, self.v[at[r[i : i + PAIRS]]], v[c[i : i + PAIRS]]) for i in range(0, len(r), PAIRS))])
            keep = np.isfinite(d) & (d <= self.far[at[r]])
            if self.exclude_self:
                keep &= self.q[at[r]] != ids[c]
            self.found.append((at[r[keep]], ids[c[keep]], d[keep]))
            if sum(len(x[0]) for x in self.found) > wait:
                self._merge()

    def _limit(self, at: np.ndarray, score: np.ndarray, top: float) -> np.ndarray:
        """Scores above these are not among the k best: from the k-th held, or else from the k-th of the block."""
        size, far, dim = self.size[at], self.far[at], self.left.shape[1]
        if self.metric == "cos":
            size = np.minimum(size, 1.0)
        slack = (dim + 8) * 2.0**-23 * (size + top) ** 2 + 1e-37
        limit = (far**2 - size**2) / 2 if self.metric == "l2" else far if self.metric == "ip" else far - 1
        fresh = np.flatnonzero(np.isinf(far))
        if len(fresh) and score.shape[1] >= self.k:
            limit[fresh] = np.partition(score[fresh], self.k - 1, axis=1)[:, self.k - 1] + slack[fresh]
        return (limit + slack + np.abs(limit) * 2.0**-22).astype(np.float32)

    def _merge(self) -> None:
        row, ids, dist = (np.concatenate(x) for x in zip(*self.found, strict=True)) if self.found else (np.empty(0, np.int64),) * 3
        self.found = []
        if not len(row):
            return
        there = np.unique(row)
        old, width = self.dist[there], self.dist.shape[1]
        held = np.isfinite(old)
        row, ids, dist = np.concatenate([np.repeat(there, held.sum(axis=1)), row]), np.concatenate([self.id[there][held], ids]), np.concatenate([old[held], dist])
        order = np.lexsort((ids, dist, row))
        row, ids, dist = row[order], ids[order], dist[order]
        nth = _nth(row)
        keep = nth < self.k
        row, nth = row[keep], nth[keep]
        self.dist[row, nth], self.id[row, nth] = dist[keep], ids[keep]
        if width == self.k:
            self.far[there] = self.dist[there, -1]

    def result(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(q, id, dist, rank) as flat arrays; rank is 1-based. Queries of one id share k rows."""
        self._merge()
        ok = np.isfinite(self.dist)
        q, ids, dist = np.repeat(self.q, ok.sum(axis=1)), self.id[ok], self.dist[ok]
        if len(np.unique(self.q)) < len(self.q):
            order = np.lexsort((ids, dist, q))
            q, ids, dist = q[order], ids[order], dist[order]
        nth = _nth(q)
        keep = nth < self.k
        return q[keep], ids[keep], dist[keep], (nth[keep] + 1).astype(np.int32)


def _nth(keys: np.ndarray) -> np.ndarray:
    """The how many-th of its key each of the sorted keys is, from 0."""
    if not len(keys):
        return np.empty(0, np.int64)
    first = np.concatenate([[0], np.flatnonzero(np.diff(keys)) + 1])
    return np.arange(len(keys)) - np.repeat(first, np.diff(np.append(first, len(keys))))


def best(metric: str, q: np.ndarray, qv: np.ndarray, ids: np.ndarray, v: np.ndarray, k: int, exclude_self: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k nearest of the given rows for each query, lower id on ties, as three flat arrays."""
    near = Nearest(metric, q, qv, k, exclude_self)
    near.add(ids, v)
    return near.result()[:3]


def _matrix(lists) -> np.ndarray:
    return np.array(list(lists), np.float64) if len(lists) else np.empty((0, 0))


def top_k(scored: DataFrame, k: int, by: str = "q", dist: str = "dist", tie: str = "id") -> DataFrame:
    """Keeps the k smallest (dist, tie) of each key with their 1-based rank; limits before the exchange too."""
    w = Window.partitionBy(by).orderBy(dist, tie)
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def knn(queries: DataFrame, base: DataFrame, k: int, metric: str = "l2", exclude_self: bool = False, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """(q, id, dist, rank) from queries (q, v) and base (id, v); v: arrays of one length. Null vectors take no part.

    Fewer than k rows in the base give fewer rows; an empty side gives an empty result.
    """
    if metric not in METRICS:
        raise ValueError(f"metric must be one of {METRICS}")
    spark = base.sparkSession
    queries = queries.select(F.col("q").cast("long").alias("q"), vec("v").alias("v")).where("v is not null and q is not null")
    base = base.select(F.col("id").cast("long").alias("id"), vec("v").alias("v")).where("v is not null and id is not null")
    size, n = queries.agg(F.sum(F.size("v") * 8 + 8), F.count("*")).first()
    if (size or 0) > broadcast_bytes or n > SENT:
        return _stripped(queries, base, n, k, metric, exclude_self)
    rows = queries.collect()  # at most broadcast_bytes
    shared = spark.sparkContext.broadcast((np.array([r["q"] for r in rows], np.int64), _matrix([r["v"] for r in rows])))

    def scan(batches):
        near = Nearest(metric, *shared.value, k, exclude_self)
        for b in batches:
            if b.num_rows:
                ids = np.asarray(b.column(0))
                near.add(ids, np.asarray(b.column(1).flatten()).reshape(len(ids), -1))
        yield from sliced(list(near.result()[:3]), ["q", "id", "dist"])

    return top_k(base.mapInArrow(scan, SCHEMA), k)


def searched(asks: DataFrame, has: DataFrame, k: int, metric: str, exclude_self: bool, groups: int) -> DataFrame:
    """(q, id, dist, rank) within each group of blocks: what asks, on side 0, among what it is shown, on side 1."""

    def run(stream):
        near, group, q = None, None, []
        for b in stream:
            if b.g != group:
                if near is not None:
                    yield from sliced(list(near.result()), ["q", "id", "dist", "rank"])
                near, group, q = None, b.g, []
            if not b.side:
                q.append(b)
            elif q:
                near = near or Nearest(metric, np.concatenate([x.ids for x in q]), np.concatenate([x.v for x in q]), k, exclude_self)
                near.add(b.ids, b.v)
        if near is not None:
            yield from sliced(list(near.result()), ["q", "id", "dist", "rank"])

    return shown([asks, has], run, f"{SCHEMA}, rank int", groups)


def _stripped(queries: DataFrame, base: DataFrame, n: int, k: int, metric: str, exclude_self: bool) -> DataFrame:
    """Strips of queries (n in all) against the base: a strip's task sees all of it, so its k best are final."""
    groups = strips(base.sparkSession, n, STRIP)
    asks = packed(queries.select(F.pmod(F.xxhash64("q"), F.lit(groups)).alias("g"), F.col("q").alias("id"), "v"), 0)
    has = copied(packed(base.select(F.lit(0).alias("g"), "id", "v"), 1), F.lit(0), F.lit(groups))
    return searched(asks, has, k, metric, exclude_self, groups)


#: Of the base, in double precision, that a task holds to sort all distances; and distances held at a time.
HELD_BYTES, SORTED_BYTES = 512 << 20, 64 << 20


def sort_all(queries: DataFrame, base: DataFrame, metric: str = "l2", exclude_self: bool = False, held_bytes: int = HELD_BYTES) -> DataFrame:
    """(q, id, dist, rank) of all pairs: the whole base in order of (distance, id) for each query.

    A task holds the base and is shown its strip of queries, so each query's distances are sorted where they are
    made, and no pair is shuffled. A base of more than held_bytes is cut into parts, and Spark ranks the pairs of a query.
    """
    queries = queries.select(F.col("q").cast("long").alias("id"), vec("v").alias("v")).where("v is not null and id is not null")
    base = base.select(F.col("id").cast("long").alias("id"), vec("v").alias("v")).where("v is not null and id is not null")
    size = base.agg(F.sum(F.size("v") * 8 + 8)).first()[0] or 0
    parts = max(1, -(-size // held_bytes))
    n = strips(base.sparkSession, queries.count(), STRIP, 16)

    def run(stream):
        group, held = None, []
        for b in stream:
            if b.g != group:
                group, held = b.g, []
            if not b.side:
                held.append(b)
                continue
            total = sum(len(x.ids) for x in held)
            ids = np.concatenate([x.ids for x in held]) if held else np.empty(0, np.int64)
            step = max(1, SORTED_BYTES // (8 * max(1, total)))
            for lo in range(0, len(b.ids) if total else 0, step):
                q, qv = b.ids[lo : lo + step], b.v[lo : lo + step].astype(np.float64)
                d = np.empty((len(q), total))
                at = 0
                for x in held:
                    d[:, at : at + len(x.ids)] = distances(metric, qv, x.v.astype(np.float64))
                    at += len(x.ids)
                for query, dist in zip(q.tolist(), d, strict=True):
                    order = np.argsort(dist)
                    if (dist[order[1:]] == dist[order[:-1]]).any():
                        order = np.lexsort((ids, dist))
                    use = np.isfinite(dist[order]) & ((ids[order] != query) | (not exclude_self))
                    order = order[use]
                    yield from sliced([np.full(len(order), query), ids[order], dist[order], np.arange(1, len(order) + 1, dtype=np.int32)], ["q", "id", "dist", "rank"])

    groups = n * parts
    of_q, of_id = F.pmod(F.xxhash64("id"), F.lit(n)), F.pmod(F.xxhash64("id"), F.lit(parts)) * n
    has = copied(packed(base.select(of_id.alias("g"), "id", "v"), 0), F.col("g"), F.lit(n))
    asks = packed(queries.select(of_q.alias("g"), "id", "v"), 1).withColumn("g", F.explode(F.sequence(F.col("g"), F.lit(groups - 1).cast("long"), F.lit(n).cast("long"))))
    found = shown([has, asks], run, f"{SCHEMA}, rank int", groups)
    return found if parts == 1 else top_k(found.drop("rank"), 1 << 40)


def _sent(queries: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Ids and vectors of a query set; ValueError beyond BROADCAST_BYTES."""
    size = queries.agg(F.sum(F.size("v") * 8 + 8)).first()[0] or 0
    if size > BROADCAST_BYTES:
        raise ValueError("the query set is too large to send to every task: search it in parts")
    rows = queries.collect()
    return np.array([r["q"] for r in rows], np.int64), _matrix([r["v"] for r in rows])


def _scanned(queries: DataFrame, base: DataFrame, schema: str, fn) -> DataFrame:
    """fn(query ids, query vectors, base ids, base vectors) of each batch of the base, as rows of the schema."""
    queries = queries.select(F.col("q").cast("long").alias("q"), vec("v").alias("v")).where("v is not null and q is not null")
    base = base.select(F.col("id").cast("long").alias("id"), vec("v").alias("v")).where("v is not null and id is not null")
    shared = base.sparkSession.sparkContext.broadcast(_sent(queries))
    names = [part.split()[0] for part in schema.split(",")]

    def run(batches):
        q, qv = shared.value
        for b in batches:
            if b.num_rows and len(q):
                ids = np.asarray(b.column(0))
                found = fn(q, qv, ids, np.asarray(b.column(1).flatten()).reshape(len(ids), -1))
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in found], names=names)

    return base.mapInArrow(run, schema)


def within(queries: DataFrame, base: DataFrame, radius: float, metric: str = "l2", exclude_self: bool = False) -> DataFrame:
    """(q, id, dist) of all pairs at a distance of at most radius; the others are dropped where they are computed."""

    def near(q, qv, ids, v):
        d = distances(metric, qv, v)
        i, j = np.nonzero((d <= radius) & ((q[:, None] != ids[None, :]) | (not exclude_self)))
        return q[i], ids[j], d[i, j]

    return _scanned(queries, base, SCHEMA, near)


def distance_stats(queries: DataFrame, base: DataFrame, metric: str = "l2", exclude_self: bool = False) -> DataFrame:
    """(q, n, nearest, farthest) over all distances of each query; a task passes on one row a query and batch."""

    def sums(q, qv, ids, v):
        d = distances(metric, qv, v)
        use = (q[:, None] != ids[None, :]) | (not exclude_self)
        some = use.any(axis=1)
        return q[some], use.sum(axis=1)[some], np.where(use, d, np.inf).min(axis=1)[some], np.where(use, d, -np.inf).max(axis=1)[some]

    rows = _scanned(queries, base, "q long, n long, nearest double, farthest double", sums)
    return rows.groupBy("q").agg(F.sum("n").alias("n"), F.min("nearest").alias("nearest"), F.max("farthest").alias("farthest"))


def recall(found: DataFrame, truth: DataFrame, k: int) -> DataFrame:
    """(q, hits, recall): the share of the true k neighbours (q, id) that were found."""
    hits = truth.select("q", "id").join(found.select("q", "id").distinct(), ["q", "id"]).groupBy("q").agg(F.count("*").alias("hits"))
    return truth.select("q").distinct().join(hits, "q", "left").select("q", F.coalesce("hits", F.lit(0)).cast("long").alias("hits"), (F.coalesce("hits", F.lit(0)) / F.lit(k)).alias("recall"))


class FlatIndex:
    """An exact index: ``add`` vectors (id, v), then ``search`` queries (q, v)."""

    def __init__(self, metric: str = "l2"):
        self.metric = metric
        self.data: DataFrame | None = None

    def add(self, rows: DataFrame) -> FlatIndex:
        rows = rows.select("id", "v")
        self.data = rows if self.data is None else self.data.unionByName(rows)
        return self

    def search(self, queries: DataFrame, k: int, exclude_self: bool = False) -> DataFrame:
        if self.data is None:
            raise ValueError("nothing was added")
        return knn(queries, self.data, k, self.metric, exclude_self)
