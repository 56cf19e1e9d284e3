"""Shared plumbing of the training-data operators: scratch tables, Arrow settings, null handling."""

from __future__ import annotations

import atexit
import os
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def prepare(spark: SparkSession, rows_per_batch: int = 512) -> None:
    """Small Arrow batches (documents can be long), and this package on the workers' path.

    Plans are lazy and read these settings when they run, so they can't be put back here: the batch size is
    lowered if it is larger, and never raised, so the order of calls does not matter.
    """
    now = int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch"))
    if now <= 0 or now > rows_per_batch:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows_per_batch))
    # shuffle files go when the query that made them ends, not when the driver collects its garbage
    spark.conf.set("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")
    env = spark.sparkContext.environment
    parts = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if ROOT not in parts:
        env["PYTHONPATH"] = os.pathsep.join([ROOT, *parts])


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (spark.checkpoint.dir); a temporary one only in local mode."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        base = spark.conf.get("nearframe.scratch.dir", "") or ""
        if not base:
            if not re.match(r"local(\[|$)", spark.sparkContext.master):
                raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
            base = tempfile.mkdtemp(prefix="nearframe-")
            spark.conf.set("nearframe.scratch.dir", base)
    return base.rstrip("/")


class Scratch:
    """Tables written to the shared folder to cut lineage; they survive the loss of any executor.

    Tables that a later step has consumed are dropped with ``drop``; those that a returned (lazy)
    DataFrame still reads stay until the session's process ends.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.base = f"{shared_dir(spark)}/nearframe-{name}-{uuid.uuid4().hex[:12]}"
        self.n = 0
        atexit.register(self._clean)

    def write(self, df: DataFrame, label: str = "t", compression: str | None = None, **options: str) -> DataFrame:
        self.n += 1
        path = f"{self.base}/{self.n:03d}-{label}"
        df.write.options(**options).parquet(path, compression=compression)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._nearframe_path = path
        return out

    def drop(self, *tables: DataFrame | None) -> None:
        for t in tables:
            if t is not None and getattr(t, "_nearframe_path", None):
                self._delete(t._nearframe_path)

    def _delete(self, path: str) -> None:
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)

    def _clean(self) -> None:
        if self.spark.sparkContext._jsc is not None:
            try:
                self._delete(self.base)
            except Exception:  # the JVM may already be gone when the interpreter ends
                pass


def text_or_empty(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def bound(value: Column, fn: Callable[[Column], Column]) -> Column:
    """fn(value) with value computed once: what a lambda refers to is otherwise computed anew for each element."""
    return F.transform(F.array(value), fn)[0]


def position(df: DataFrame, name: str) -> int:
    """Where the column is that Spark resolves the name to."""
    if name in df.columns:
        return df.columns.index(name)
    field = df.select(F.col(f"`{name}`")).schema[0].name  # raises if there is none, or more than one
    found = [i for i, c in enumerate(df.columns) if c == field or c.lower() == name.lower()]
    return found[0]


def free_name(df: DataFrame, wish: str) -> str:
    """wish, or wish with underscores behind it, whichever no column is called."""
    taken = {c.lower() for c in df.columns}
    while wish.lower() in taken:
        wish += "_"
    return wish


def without(df: DataFrame, *names: str) -> DataFrame:
    """Drops columns that an operator is about to add (names compare as Spark resolves them)."""
    new = {n.lower() for n in names}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in new])


def add_columns(
    df: DataFrame, fields: list[T.StructField], fn: Callable[[pa.RecordBatch], list[pa.Array]]
) -> DataFrame:
    """Runs fn over Arrow batches and appends its arrays; columns of the same name are replaced."""
    kept = without(df, *[f.name for f in fields])
    schema = T.StructType([*kept.schema.fields, *fields])
    names = [f.name for f in fields]
    source = df.columns
    keep_idx = [i for i, c in enumerate(source) if c.lower() not in {n.lower() for n in names}]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows == 0:
                continue
            new = fn(b)
            yield pa.RecordBatch.from_arrays(
                [b.column(i) for i in keep_idx] + new, names=[source[i] for i in keep_idx] + names
            )

    return df.mapInArrow(run, schema)
