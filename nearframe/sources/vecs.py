"""Vector files: .fvecs, .bvecs and .ivecs, read in parallel by record ranges and written as they are laid out.

A record is a little-endian 32-bit length and so many values: 32-bit floats, bytes, or 32-bit integers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

KINDS = {"fvecs": np.dtype("<f4"), "bvecs": np.dtype("u1"), "ivecs": np.dtype("<i4")}


def parse(data: bytes, kind: str) -> np.ndarray:
    """(records, dim) of whole records; ValueError if lengths differ or the data end inside a record."""
    if not data:
        return np.empty((0, 0), KINDS[kind])
    dim = int(np.frombuffer(data[:4], "<i4")[0])
    width = 4 + dim * KINDS[kind].itemsize
    if dim <= 0 or len(data) % width:
        raise ValueError("not a whole number of records")
    rows = np.frombuffer(data, np.uint8).reshape(-1, width)
    if (np.ascontiguousarray(rows[:, :4]).view("<i4") != dim).any():
        raise ValueError("records of different lengths")
    return np.ascontiguousarray(rows[:, 4:]).view(KINDS[kind])


def dump(rows: np.ndarray, kind: str) -> bytes:
    n, dim = rows.shape
    head = np.full((n, 1), dim, "<i4").view(np.uint8).reshape(n, 4)
    body = np.ascontiguousarray(rows.astype(KINDS[kind])).view(np.uint8).reshape(n, -1)
    return np.concatenate([head, body], axis=1).tobytes()


def read(spark: SparkSession, path: str, kind: str, limit: int | None = None) -> DataFrame:
    """(vec_id long, embedding array<float>, or array<int> for ivecs) of a file; vec_id counts its records from 0.

    Records have one length, so tasks read splits of the file by the Hadoop file system, whatever its size and
    wherever it is. The first record's length is read on the driver, and one number a split is counted. limit: the
    first so many records. An empty file gives no rows.
    """
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    element = "int" if kind == "ivecs" else "float"
    schema = f"vec_id long, embedding array<{element}>"
    if not fs.getFileStatus(target).getLen():
        return spark.createDataFrame([], schema)
    stream = fs.open(target)
    try:
        dim = int.from_bytes(bytes((stream.read() & 0xFF) for _ in range(4)), "little")
    finally:
        stream.close()
    width = 4 + dim * KINDS[kind].itemsize
    records = spark.sparkContext.binaryRecords(path, width)
    # splits are whole records, so a split's first record follows from where it starts
    parts = records._jrdd.rdd().partitions()
    starts = [parts[k].serializableHadoopSplit().value().getStart() // width for k in range(len(parts))]

    def number(k: int, it: Iterator[bytes]) -> Iterator[tuple[int, bytearray]]:
        return ((starts[k] + i, bytearray(r)) for i, r in enumerate(it))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = parse(b"".join(b.column(1).to_pylist()), kind)
            yield pa.RecordBatch.from_arrays([b.column(0), _lists(rows, element)], names=["vec_id", "embedding"])

    out = records.mapPartitionsWithIndex(number).toDF("vec_id long, record binary").mapInArrow(run, schema)
    return out if limit is None else out.where(F.col("vec_id") < limit)


def _lists(rows: np.ndarray, element: str) -> pa.Array:
    values = pa.array(rows.reshape(-1).astype(np.int32 if element == "int" else np.float32))
    return pa.ListArray.from_arrays(pa.array(np.arange(0, rows.size + 1, rows.shape[1], dtype=np.int32)), values)


def write(df: DataFrame, path: str, kind: str) -> None:
    """Writes (vec_id, embedding), ids without gaps, as blocks of records in order of vec_id; ``read_written`` reads them.

    Blocks are binary values of a Parquet table, so tasks write them and no row passes the driver.
    """

    def run(batches):
        for b in batches:
            rows = np.array(b.column(1).to_pylist())
            if len(rows):
                yield pa.RecordBatch.from_arrays([pa.array(np.asarray(b.column(0))[:1]), pa.array([dump(rows, kind)], pa.binary())], names=["first", "content"])

    ordered = df.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").repartitionByRange("vec_id").sortWithinPartitions("vec_id")
    ordered.mapInArrow(run, "first long, content binary").write.mode("overwrite").parquet(path)


def read_written(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """Reads what ``write`` stored; ids count from each block's first id."""
    element = "int" if kind == "ivecs" else "float"

    def run(batches):
        for b in batches:
            for at, blob in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                rows = parse(blob, kind)
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(at, at + len(rows))), _lists(rows, element)], names=["vec_id", "embedding"])

    return spark.read.parquet(path).mapInArrow(run, f"vec_id long, embedding array<{element}>")
