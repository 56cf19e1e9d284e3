"""Distances and vector arithmetic as Columns over array<double>; smaller is nearer for every metric."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

METRICS = ("l2", "ip", "cos")


def vec(c: Column | str) -> Column:
    """Stored floats as doubles: all arithmetic is in double precision."""
    return (F.col(c) if isinstance(c, str) else c).cast("array<double>")


def total(c: Column) -> Column:
    return F.aggregate(c, F.lit(0.0), lambda a, x: a + x)


def norm_squared(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x)


def norm(v: Column) -> Column:
    return F.sqrt(norm_squared(v))


def dot(p: Column, q: Column) -> Column:
    return total(F.zip_with(p, q, lambda x, y: x * y))


def minus(p: Column, q: Column) -> Column:
    return F.zip_with(p, q, lambda x, y: x - y)


def plus(p: Column, q: Column) -> Column:
    return F.zip_with(p, q, lambda x, y: x + y)


def l2_squared(p: Column, q: Column) -> Column:
    return total(F.zip_with(p, q, lambda x, y: (x - y) * (x - y)))


def l2(p: Column, q: Column) -> Column:
    return F.sqrt(l2_squared(p, q))


def inner_product(p: Column, q: Column) -> Column:
    """Negated, so that the larger product is the smaller distance."""
    return -dot(p, q)


def cosine(p: Column, q: Column) -> Column:
    """1 - cosine similarity; 2 if either vector is all zeros."""
    size = norm(p) * norm(q)
    return F.when(size == 0, F.lit(2.0)).otherwise(F.lit(1.0) - dot(p, q) / size)


def distance(metric: str, p: Column, q: Column) -> Column:
    if metric not in METRICS:
        raise ValueError(f"metric must be one of {METRICS}")
    return {"l2": l2, "ip": inner_product, "cos": cosine}[metric](p, q)


def bound(value: Column, fn) -> Column:
    """fn(value) with value computed once: what a lambda refers to is otherwise computed anew for each element."""
    return F.transform(F.array(value), fn)[0]


def _scored(v: Column, centres: Column, metric: str) -> Column:
    return F.transform(centres, lambda c: F.struct(distance(metric, v, c["v"]).alias("dist"), c["id"].alias("id")))


def ranked(v: Column, centres: Column, metric: str = "l2") -> Column:
    """array<struct<dist,id>> of centres array<struct<id,v>>, nearest first, lower id on ties."""
    return bound(v, lambda x: F.array_sort(_scored(x, centres, metric)))


def argmin(v: Column, centres: Column, metric: str = "l2") -> Column:
    """struct<dist,id> of the nearest centre, without moving a row."""
    return bound(v, lambda x: F.array_min(_scored(x, centres, metric)))
