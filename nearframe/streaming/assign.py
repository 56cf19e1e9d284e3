"""Streams of vectors: each arriving vector goes to its nearest cell. An extension; nothing here is batch-only."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from nearframe.functions.distance import argmin, vec


def centre_literal(centres: DataFrame):
    """Centres (id, v) as one literal array: a codebook is bounded by its parameter."""
    rows = centres.orderBy("id").collect()
    return F.array(*[F.struct(F.lit(r["id"]).cast("long").alias("id"), F.array(*[F.lit(float(x)) for x in r["v"]]).alias("v")) for r in rows])


def assign_stream(stream: DataFrame, centres: DataFrame, metric: str = "l2") -> DataFrame:
    """(vec_id, cell, dist) for each row of a stream (vec_id, embedding); stateless, so it runs in append mode."""
    near = stream.select("vec_id", argmin(vec("embedding"), centre_literal(centres), metric).alias("n"))
    return near.select("vec_id", F.col("n.id").alias("cell"), F.col("n.dist").alias("dist"))


def read_stream(spark: SparkSession, path: str, schema: str = "vec_id long, embedding array<float>, label int") -> DataFrame:
    return spark.readStream.schema(schema).parquet(path)


def run_available(df: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Writes what has arrived to Parquet and ends; a restart goes on where the checkpoint stopped."""
    q = df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return q


def windowed_counts(events: DataFrame, ts: str = "ts", key: str = "event_type", width: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Counts and sums by window and key; rows later than the watermark are dropped."""
    return events.withWatermark(ts, late).groupBy(F.window(ts, width), key).agg(F.count("*").alias("n"), F.sum("value").alias("total"))
