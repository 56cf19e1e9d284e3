"""Rows of vectors packed into blocks, and their way through tasks that are shown one block after another.

A block is one row of up to ``BLOCK`` vectors: (g, side, ids, vecs, single, more). ``g`` is the group that is to see it,
``side`` its turn within the group, ``more`` further whole numbers, as many for each id. Vectors that are the same in
single precision travel so. Nothing passes the driver, and a task holds what its function keeps, not its group.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCK = 4096
#: Rows that a packing task holds in blocks that are not full, and rows of a result that leave a task together.
LOOSE, SLICE = 16 * BLOCK, 1 << 17
#: Tasks at most, if there are more groups.
TASKS = 4096
SCHEMA = "g long, side int, ids binary, vecs binary, single boolean, more binary"


class Block:
    """One block: group, turn, ids, vectors (in the precision in which they travel) and further numbers (a row an id)."""

    def __init__(self, g: int, side: int, ids: np.ndarray, v: np.ndarray, more: np.ndarray):
        self.g, self.side, self.ids, self.v, self.more = g, side, ids, v, more


def packed(rows: DataFrame, side: int) -> DataFrame:
    """Blocks of rows (g, id, v) or (g, id, v, more array<long>), made where the rows are. All v have one length, 0 too."""
    wide = "more" in rows.columns
    rows = rows.select(F.col("g").cast("long"), F.col("id").cast("long"), "v", *(["more"] if wide else []))

    def block(g: int, parts: list[tuple[np.ndarray, ...]]) -> Iterator[pa.RecordBatch]:
        ids, v, more = (np.concatenate(x) for x in zip(*parts, strict=True))
        with np.errstate(over="ignore"):
            less = v.astype(np.float32)
        single = bool((less == v).all())
        v = less if single else v
        for lo in range(0, len(ids), BLOCK):
            at = slice(lo, lo + BLOCK)
            cols = [pa.array([g], pa.int64()), pa.array([side], pa.int32()), pa.array([ids[at].tobytes()], pa.binary()), pa.array([v[at].tobytes()], pa.binary()), pa.array([single]), pa.array([more[at].tobytes()], pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, names=["g", "side", "ids", "vecs", "single", "more"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[np.ndarray, ...]]] = {}
        n: dict[int, int] = {}
        for b in batches:
            if not b.num_rows:
                continue
            g, ids = np.asarray(b.column(0)), np.asarray(b.column(1))
            v = np.asarray(b.column(2).flatten(), np.float64).reshape(len(ids), -1)
            more = np.asarray(b.column(3).flatten(), np.int64).reshape(len(ids), -1) if wide else np.empty((len(ids), 0), np.int64)
            order = np.argsort(g, kind="stable")
            for at in np.split(order, np.flatnonzero(np.diff(g[order])) + 1):
                key = int(g[at[0]])
                held.setdefault(key, []).append((ids[at], v[at], more[at]))
                n[key] = n.get(key, 0) + len(at)
                if n[key] >= BLOCK:
                    yield from block(key, held.pop(key))
                    del n[key]
            if sum(n.values()) > LOOSE:
                for key in list(held):
                    yield from block(key, held.pop(key))
                n.clear()
        for key in list(held):
            yield from block(key, held.pop(key))

    return rows.mapInArrow(run, SCHEMA)


def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[Block]:
    for b in batches:
        for g, side, ids, vecs, single, more in zip(*b.columns, strict=True):
            ids = np.frombuffer(ids.as_buffer(), np.int64)
            n = len(ids)
            yield Block(g.as_py(), side.as_py(), ids, np.frombuffer(vecs.as_buffer(), np.float32 if single.as_py() else np.float64).reshape(n, -1), np.frombuffer(more.as_buffer(), np.int64).reshape(n, -1))


def copied(packed_rows: DataFrame, first: Column, n: Column) -> DataFrame:
    """Blocks, once for each of the groups from first on, n of them."""
    return packed_rows.withColumn("g", F.explode(F.sequence(first.cast("long"), (first + n - 1).cast("long"))))


def shown(sides: list[DataFrame], fn: Callable[[Iterator[Block]], Iterator[pa.RecordBatch]], schema: str, groups: int) -> DataFrame:
    """fn of the blocks of each task, group after group and side after side; a group (g below groups) is in one task."""
    both = sides[0]
    for s in sides[1:]:
        both = both.unionByName(s)
    n = min(groups, TASKS)  # a task a group, as a hash would put several into one
    return both.repartitionById(n, F.pmod("g", F.lit(n)).cast("int")).sortWithinPartitions("g", "side").mapInArrow(lambda batches: fn(blocks(batches)), schema)


def strips(spark, n: int, most: int, least: int = 256) -> int:
    """Into how many groups n rows are cut: two a core, none far below `least` rows, none above `most`."""
    return max(1, -(-n // most), min(2 * spark.sparkContext.defaultParallelism, -(-n // least)))


def sliced(columns: list[np.ndarray], names: list[str]) -> Iterator[pa.RecordBatch]:
    for lo in range(0, len(columns[0]), SLICE):
        yield pa.RecordBatch.from_arrays([pa.array(c[lo : lo + SLICE]) for c in columns], names=names)
