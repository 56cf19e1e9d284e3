"""Coarse and product quantisation: inverted lists, two-layer residual index, product codes.

Codebooks are bounded by their parameters (``MOST_CENTRES``), not by the data: they are collected behind that check, go
to every task once, and vectors are assigned a batch at a time in numpy, so no row moves.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from nearframe.functions.distance import distance, minus, vec
from nearframe.operators.exact import BLOCK, BROADCAST_BYTES, distances, top_k
from nearframe.sources.staging import stage

MOST_CENTRES = 65_536


def first_rows(base: DataFrame, n: int) -> DataFrame:
    """The n vectors of the lowest ids as centres (id, v): deterministic seeding."""
    if n > MOST_CENTRES:
        raise ValueError(f"at most {MOST_CENTRES} centres")
    return base.select("id", "v").orderBy("id").limit(n)


def as_array(centres: DataFrame) -> Column:
    """Centres (id, v) as one array<struct<id,v>> value, ordered by id; a column of its own before any lambda."""
    return centres.agg(F.sort_array(F.collect_list(F.struct("id", "v"))).alias("c")).scalar()


def _collected(centres: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Ids and vectors of a codebook in order of id; ValueError beyond MOST_CENTRES."""
    rows = centres.select("id", "v").orderBy("id").limit(MOST_CENTRES + 1).collect()
    if len(rows) > MOST_CENTRES:
        raise ValueError(f"at most {MOST_CENTRES} centres")
    return np.array([r["id"] for r in rows], np.int64), np.array([r["v"] for r in rows], np.float64)


def _append(df: DataFrame, fields: list[T.StructField], fn: Callable[[np.ndarray], list[pa.Array]], column: str = "v") -> DataFrame:
    """df with fn of the matrix of its vectors (batch, dim) as further columns; null vectors give nulls."""
    at, names = df.columns.index(column), [*df.columns, *(f.name for f in fields)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            col = b.column(at)
            there = np.flatnonzero(np.asarray(col.is_valid()))
            if not len(there):
                new = [pa.nulls(b.num_rows, t) for t in kinds]
            else:
                new = fn(np.asarray(col.flatten()).reshape(len(there), -1))
                if len(there) < b.num_rows:
                    place = np.full(b.num_rows, -1)
                    place[there] = np.arange(len(there))
                    take = pa.array(place, mask=place < 0)
                    new = [x.take(take) for x in new]
            yield pa.RecordBatch.from_arrays([*b.columns, *new], names=names)

    from pyspark.sql.pandas.types import to_arrow_type

    kinds = [to_arrow_type(f.dataType) for f in fields]
    return df.mapInArrow(run, T.StructType([*df.schema.fields, *fields]))


def _lists(rows: np.ndarray) -> pa.Array:
    offsets = np.arange(0, rows.size + 1, max(1, rows.shape[1]), dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(rows.reshape(-1)))


def assign(rows: DataFrame, centres: DataFrame, metric: str = "l2", out: str = "cell") -> DataFrame:
    """Adds the nearest centre's id (lower id on ties) and its distance (``<out>_dist``)."""
    shared = rows.sparkSession.sparkContext.broadcast(_collected(centres))

    def near(v: np.ndarray) -> list[pa.Array]:
        ids, c = shared.value
        d = distances(metric, v, c)
        at = d.argmin(axis=1)
        return [pa.array(ids[at]), pa.array(d[np.arange(len(v)), at])]

    rows = rows.drop(out, f"{out}_dist")
    return _append(rows, [T.StructField(out, T.LongType()), T.StructField(f"{out}_dist", T.DoubleType())], near)


def lloyd(rows: DataFrame, centres: DataFrame, metric: str = "l2") -> DataFrame:
    """One step of k-means: the means of the assigned vectors; a centre without vectors stays."""
    cells = assign(rows, centres, metric)
    dims = cells.select("cell", F.posexplode("v").alias("j", "x")).groupBy("cell", "j").agg(F.avg("x").alias("x"))
    means = dims.groupBy("cell").agg(F.transform(F.sort_array(F.collect_list(F.struct("j", "x"))), lambda s: s["x"]).alias("mean"))
    return centres.join(means, F.col("id") == F.col("cell"), "left").select("id", F.coalesce("mean", "v").alias("v"))


def _nearest(queries: DataFrame, ids: np.ndarray, centres: np.ndarray, n: int, metric: str = "l2") -> DataFrame:
    """(q, v, cell): the n nearest of the centres for each query, a row each."""
    shared = queries.sparkSession.sparkContext.broadcast((ids, centres))

    def near(v: np.ndarray) -> list[pa.Array]:
        ids_, c = shared.value
        take = np.argsort(distances(metric, v, c), axis=1, kind="stable")[:, :n]
        return [_lists(ids_[take])]

    found = _append(queries.select("q", "v"), [T.StructField("cells", T.ArrayType(T.LongType()))], near)
    return found.select("q", "v", F.explode("cells").alias("cell"))


def probe(queries: DataFrame, centres: DataFrame, nprobe: int, metric: str = "l2") -> DataFrame:
    """(q, v, cell): the nprobe nearest cells of each query."""
    return _nearest(queries, *_collected(centres), nprobe, metric)


def probes_for(sample: DataFrame, truth: DataFrame, lists: DataFrame, centres: DataFrame, target: float = 0.9, metric: str = "l2") -> int:
    """The least nprobe at which a sample of queries (q, v) finds the share `target` of its true neighbours, truth (q, id).

    A neighbour is found once its cell is probed, so one pass tells for every nprobe.
    """
    n = centres.count()
    order = probe(sample, centres, n, metric).withColumn("one", F.lit(1))
    c = centres.select("id", F.col("v").alias("cv"))
    ranked = order.join(c, F.col("cell") == F.col("id")).withColumn("nth", F.row_number().over(Window.partitionBy("q").orderBy(distance(metric, F.col("v"), F.col("cv")), "cell")))
    need = truth.select("q", "id").join(lists.select("id", "cell"), "id").join(ranked.select("q", "cell", "nth"), ["q", "cell"])
    by_probe = {r["nth"]: r["n"] for r in need.groupBy("nth").agg(F.count("*").alias("n")).collect()}  # a row a centre at most
    total, found = sum(by_probe.values()), 0
    for k in range(1, n + 1):
        found += by_probe.get(k, 0)
        if found >= target * total:
            return k
    return n


def ivf_search(queries: DataFrame, lists: DataFrame, centres: DataFrame, k: int, nprobe: int, metric: str = "l2", exclude_self: bool = False) -> DataFrame:
    """(q, id, dist, rank) among the lists (id, v, cell) of the nprobe nearest cells; equal cells meet in a join."""
    probes = probe(queries, centres, nprobe, metric).withColumnRenamed("v", "qv")
    met = probes.join(lists.select("id", "v", "cell"), "cell")
    if exclude_self:
        met = met.where("q <> id")
    return top_k(met.select("q", "id", distance(metric, F.col("qv"), F.col("v")).alias("dist")), k)


class IvfIndex:
    """Inverted lists over ``nlist`` cells: train on centres, add vectors, search the nearest cells."""

    def __init__(self, nlist: int, metric: str = "l2"):
        self.nlist, self.metric = nlist, metric
        self.centres: DataFrame | None = None
        self.lists: DataFrame | None = None

    def train(self, rows: DataFrame, steps: int = 0) -> IvfIndex:
        self.centres = first_rows(rows, self.nlist)
        for _ in range(steps):
            self.centres = lloyd(rows, self.centres, self.metric)
        return self

    def add(self, rows: DataFrame) -> IvfIndex:
        cells = assign(rows, self.centres, self.metric).select("id", "v", "cell")
        self.lists = cells if self.lists is None else self.lists.unionByName(cells)
        return self

    def search(self, queries: DataFrame, k: int, nprobe: int) -> DataFrame:
        return ivf_search(queries, self.lists, self.centres, k, nprobe, self.metric)


# -- two-layer residual quantisation -------------------------------------------------------------------
def residuals(rows: DataFrame, coarse: DataFrame) -> DataFrame:
    """(id, c1, r): the nearest coarse centre of each vector and what is left of it."""
    shared = rows.sparkSession.sparkContext.broadcast(_collected(coarse))

    def split(v: np.ndarray) -> list[pa.Array]:
        ids, c = shared.value
        at = distances("l2", v, c).argmin(axis=1)
        return [pa.array(ids[at]), _lists(v - c[at])]

    return _append(rows.select("id", "v"), [T.StructField("c1", T.LongType()), T.StructField("r", T.ArrayType(T.DoubleType()))], split).select("id", "c1", "r")


def rvq_train(rows: DataFrame, n1: int, n2: int) -> tuple[DataFrame, DataFrame]:
    """Coarse centres (id, v), and fine centres (id, v) of residuals: both seeded by the lowest ids."""
    coarse = first_rows(rows, n1)
    left = residuals(first_rows(rows, n2), coarse)
    fine = left.orderBy("id").limit(n2).select((F.row_number().over(Window.orderBy("id")) - 1).cast("long").alias("id"), F.col("r").alias("v"))
    return coarse, stage(fine)


def rvq_assign(rows: DataFrame, coarse: DataFrame, fine: DataFrame) -> DataFrame:
    """(id, c1, c2, dist): nearest coarse centre, then the nearest fine centre of the residual."""
    near = assign(residuals(rows, coarse).withColumnRenamed("r", "v"), fine, out="c2")
    return near.select("id", "c1", "c2", F.col("c2_dist").alias("dist"))


def rvq_search(queries: DataFrame, rows: DataFrame, coarse: DataFrame, fine: DataFrame, k: int, metric: str = "l2", exclude_self: bool = False, probes: int = 1) -> DataFrame:
    """Exact search among the vectors of the `probes` entry clusters (c1, c2) nearest to the query.

    An entry cluster's place is the sum of its two centres; with one probe it is the query's own cluster.
    """
    if probes == 1:
        entry = stage(rvq_assign(queries.select(F.col("q").alias("id"), "v"), coarse, fine)).select(F.col("id").alias("q"), "c1", "c2").join(queries, "q").withColumnRenamed("v", "qv")
    else:
        (i1, v1), (i2, v2) = _collected(coarse), _collected(fine)
        if len(i1) * len(i2) > MOST_CENTRES:
            raise ValueError(f"at most {MOST_CENTRES} entry clusters")
        places = (v1[:, None, :] + v2[None, :, :]).reshape(len(i1) * len(i2), -1)
        names = queries.sparkSession.createDataFrame([(n, int(a), int(b)) for n, (a, b) in enumerate((a, b) for a in i1 for b in i2)], "cell long, c1 long, c2 long")
        near = _nearest(queries, np.arange(len(places)), places, probes).withColumnRenamed("v", "qv")
        entry = near.join(F.broadcast(names), "cell").drop("cell")  # MOST_CENTRES rows at most
    cells = stage(rvq_assign(rows, coarse, fine)).select("id", "c1", "c2").join(rows, "id")
    met = entry.join(cells, ["c1", "c2"])
    if exclude_self:
        met = met.where("q <> id")
    return top_k(met.select("q", "id", distance(metric, F.col("qv"), F.col("v")).alias("dist")), k)


# -- product quantisation ------------------------------------------------------------------------------
def chunk_offsets(dim: int, chunks: int) -> list[int]:
    """Starts of the chunks and the end; the first dim % chunks of them are one wider."""
    wide, rest = divmod(dim, chunks)
    out = [0]
    for c in range(chunks):
        out.append(out[-1] + wide + (c < rest))
    return out


def chunked(rows: DataFrame, offsets: list[int]) -> DataFrame:
    """(id, chunk, part): the slices of each vector."""
    parts = F.array(*[F.slice("v", a + 1, b - a) for a, b in zip(offsets[:-1], offsets[1:], strict=True)])
    return rows.select("id", F.posexplode(parts).alias("chunk", "part"))


def pq_codebook(rows: DataFrame, codes: int, offsets: list[int]) -> DataFrame:
    """(chunk, code, centre): the chunks of the vectors of the lowest ids."""
    seeds = first_rows(rows, codes).withColumn("code", F.row_number().over(Window.orderBy("id")) - 1)
    return chunked(seeds.select(F.col("code").alias("id"), "v"), offsets).select("chunk", F.col("id").cast("int").alias("code"), F.col("part").alias("centre"))


def _book(codebook: DataFrame) -> list[np.ndarray]:
    """The centres of each chunk in order of code; ValueError beyond MOST_CENTRES in all."""
    rows = codebook.orderBy("chunk", "code").limit(MOST_CENTRES + 1).collect()
    if len(rows) > MOST_CENTRES:
        raise ValueError(f"at most {MOST_CENTRES} centres")
    out: dict[int, list] = {}
    for r in rows:
        out.setdefault(r["chunk"], []).append(r["centre"])
    return [np.array(out[c], np.float64) for c in sorted(out)]


def _squares(v: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return ((v[:, None, :] - centres[None, :, :]) ** 2).sum(axis=2)


def pq_encode(rows: DataFrame, codebook: DataFrame, offsets: list[int]) -> DataFrame:
    """(id, codes array<int>): the nearest code of each chunk, lower code on ties; no row moves."""
    shared = rows.sparkSession.sparkContext.broadcast(_book(codebook))

    def code(v: np.ndarray) -> list[pa.Array]:
        parts = zip(offsets[:-1], offsets[1:], shared.value, strict=True)
        return [_lists(np.stack([_squares(v[:, a:b], c).argmin(axis=1) for a, b, c in parts], axis=1).astype(np.int32))]

    return _append(rows.select("id", "v"), [T.StructField("codes", T.ArrayType(T.IntegerType()))], code).select("id", "codes")


def adc_table(queries: DataFrame, codebook: DataFrame, offsets: list[int], centroid: Column | None = None) -> DataFrame:
    """(q, t array<array<double>>): squared distances of each chunk of q (less the centroid) to each code."""
    shared = queries.sparkSession.sparkContext.broadcast(_book(codebook))

    def table(v: np.ndarray) -> list[pa.Array]:
        parts = [_squares(v[:, a:b], c) for a, b, c in zip(offsets[:-1], offsets[1:], shared.value, strict=True)]
        return [pa.array([[p[k].tolist() for p in parts] for k in range(len(v))], pa.list_(pa.list_(pa.float64())))]

    moved = queries.select("q", (F.col("v") if centroid is None else minus(F.col("v"), centroid)).alias("v"))
    return _append(moved, [T.StructField("t", T.ArrayType(T.ArrayType(T.DoubleType())))], table).select("q", "t")


def _sums(q: np.ndarray, tables: list[list[np.ndarray]], ids: np.ndarray, code: np.ndarray, m: int, exclude_self: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The m smallest sums for each query among the given codes, lower id on ties, as three flat arrays."""
    order = np.argsort(ids, kind="stable")
    ids, code = ids[order], code[order]
    out = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))]
    for query, table in zip(q.tolist(), tables, strict=True):
        dist = np.zeros(len(ids))
        for j, row in enumerate(table):
            dist += row[code[:, j]]
        if exclude_self:
            dist[ids == query] = np.inf
        take = np.argsort(dist, kind="stable")[:m]
        take = take[np.isfinite(dist[take])]
        out.append((np.full(len(take), query), ids[take], dist[take]))
    return tuple(np.concatenate(c) for c in zip(*out, strict=True))


def adc_scan(tables: DataFrame, codes: DataFrame, m: int, exclude_self: bool = False, block_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """The m smallest sums of table entries for each query, (q, id, dist, rank).

    Tables of at most block_bytes in all go to the codes, which stay in place; more tables meet the codes in a
    grid of blocks. Either way a task passes on m rows a query at most.
    """
    size = tables.agg(F.count("*"), F.max(F.aggregate("t", F.lit(0), lambda a, x: a + F.size(x)))).first()
    n, width = size[0], (size[1] or 0) * 8
    if n * width <= block_bytes:
        rows = tables.select("q", "t").collect()  # at most block_bytes
        shared = codes.sparkSession.sparkContext.broadcast((np.array([r["q"] for r in rows], np.int64), [[np.array(c) for c in r["t"]] for r in rows]))

        def scan(batches):
            q, t = shared.value
            for b in batches:
                if b.num_rows and len(q):
                    ids = np.asarray(b.column(0))
                    found = _sums(q, t, ids, np.asarray(b.column(1).flatten()).reshape(len(ids), -1), m, exclude_self)
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in found], names=["q", "id", "dist"])

        return top_k(codes.select("id", "codes").mapInArrow(scan, "q long, id long, dist double"), m)
    nq, nc = max(1, -(-n * width // (8 << 20))), max(1, -(-codes.count() // (16 * BLOCK)))
    left = tables.select(F.pmod(F.xxhash64("q"), F.lit(nq)).alias("i"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(nc - 1).cast("long"))).alias("j"), F.col("q").alias("id"), "t", F.lit(None).cast("array<int>").alias("codes"))
    right = codes.select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(nq - 1).cast("long"))).alias("i"), F.pmod(F.xxhash64("id"), F.lit(nc)).alias("j"), "id", F.lit(None).cast("array<array<double>>").alias("t"), "codes")

    def block(pdf: pd.DataFrame) -> pd.DataFrame:
        mine, other = pdf[pdf["t"].notna()], pdf[pdf["codes"].notna()]
        if not len(mine) or not len(other):
            return pd.DataFrame({"q": pd.Series(dtype="int64"), "id": pd.Series(dtype="int64"), "dist": pd.Series(dtype="float64")})
        found = _sums(mine["id"].to_numpy(), [[np.asarray(c) for c in t] for t in mine["t"]], other["id"].to_numpy(), np.stack(other["codes"].to_list()), m, exclude_self)
        return pd.DataFrame(dict(zip(("q", "id", "dist"), found, strict=True)))

    return top_k(left.union(right).groupBy("i", "j").applyInPandas(block, "q long, id long, dist double"), m)


def rerank(found: DataFrame, queries: DataFrame, base: DataFrame, k: int, metric: str = "l2") -> DataFrame:
    """Exact distances of found pairs (q, id), and the k best."""
    met = found.select("q", "id").join(queries.select("q", F.col("v").alias("qv")), "q").join(base.select("id", "v"), "id")
    return top_k(met.select("q", "id", distance(metric, F.col("qv"), F.col("v")).alias("dist")), k)


def vectors(table: DataFrame, id_col: str = "vec_id", v_col: str = "embedding") -> DataFrame:
    """(id, v) of a vector table, in double precision."""
    return table.select(F.col(id_col).cast("long").alias("id"), vec(v_col).alias("v"))
