"""Vectors, graphs and edge lists as Parquet tables; byte blocks; write-and-read-back checks."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nearframe.sources.staging import stage


def load_vectors(spark: SparkSession, path: str, n: int | None = None) -> DataFrame:
    """Base vectors; n: only ids below n, a filter that reaches the Parquet scan."""
    df = spark.read.parquet(path)
    return df if n is None else df.where(F.col("vec_id") < n)


def dump_graph(graph: DataFrame, path: str, files: int | None = None) -> None:
    """Writes (src, slot, dst) clustered by src, so that reading a vertex's edges touches one file.

    The graph is staged: ranges are found in a sample, for which what makes the graph would run once more.
    """
    graph = stage(graph)
    ordered = graph.repartitionByRange(files, "src") if files else graph.repartitionByRange("src")
    ordered.sortWithinPartitions("src", "slot").write.mode("overwrite").parquet(path)


def load_graph(spark: SparkSession, path: str, degree: int | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    return df if degree is None else df.where(F.col("slot") < degree)


def dump_subgraph(graph: DataFrame, ids: DataFrame, path: str) -> None:
    """Writes a graph over local ids with its vertices' own ids; ids: (local, id)."""
    to = ids.select(F.col("local").alias("dst"), F.col("id").alias("__d"))
    own = graph.join(ids.withColumnRenamed("local", "src"), "src").join(to, "dst")
    dump_graph(own.select(F.col("id").alias("src"), "slot", F.col("__d").alias("dst")), path)


def graph_name(prefix: str, candidates: int, degree: int, n: int) -> str:
    """<prefix>_<candidates>_<degree>_<millions>M."""
    return f"{prefix}_{candidates}_{degree}_{n // 1_000_000}M"


def pack_graph(graph: DataFrame) -> DataFrame:
    """(src, nbrs): neighbours in order of slot."""
    return graph.groupBy("src").agg(F.transform(F.sort_array(F.collect_list(F.struct("slot", "dst"))), lambda x: x["dst"]).alias("nbrs"))


def load_edges(spark: SparkSession, path: str) -> DataFrame:
    """(src, dst, weight); a table without weights gets 1.0."""
    df = spark.read.parquet(path)
    return df if "weight" in df.columns else df.withColumn("weight", F.lit(1.0))


def split_edges(edges: DataFrame, path: str) -> None:
    """Writes targets and weights apart, <path>/dst and <path>/val, both by edge number within a source; the edges are staged first."""
    edges = stage(edges.select("src", "slot", "dst", "weight"))
    for name, column in (("dst", "dst"), ("val", "weight")):
        edges.select("src", "slot", column).repartitionByRange("src").sortWithinPartitions("src", "slot").write.mode("overwrite").parquet(f"{path}/{name}")


def read_blocks(spark: SparkSession, path: str, offset: int, blocks: int, block: int) -> DataFrame:
    """(path, block, data): `blocks` blocks of `block` bytes of each file from byte `offset` on; short at its end.

    For files below 2 GB, which Spark reads as one value each; ``write_blocks`` keeps larger data as a table of blocks.
    """
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    numbered = files.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    data = F.substring(F.col("content"), F.lit(offset + 1) + F.col("block") * block, F.lit(block))
    return numbered.select("path", "block", data.alias("data")).where(F.length("data") > 0)


def write_blocks(df: DataFrame, path: str, key: str, data: str, block: int) -> None:
    """Writes the bytes of each row's data as rows (key, block, data) of `block` bytes, the last one as short as it is."""
    size = F.greatest(F.ceil(F.length("data") / F.lit(block)).cast("int"), F.lit(1))
    cut = df.select(F.col(key).alias("key"), F.col(data).cast("binary").alias("data")).withColumn("block", F.explode(F.sequence(F.lit(0), size - 1)))
    part = F.substring(F.col("data"), F.col("block") * block + 1, F.lit(block))
    cut.select("key", "block", part.alias("data")).write.mode("overwrite").parquet(path)


def dump_blocks(spark: SparkSession, path: str, first: int = 0, blocks: int | None = None, ascii_: bool = False) -> DataFrame:
    """(key, block, data) of blocks from `first` on, `blocks` of them; as hexadecimal text if ascii_. The range reaches the scan."""
    df = spark.read.parquet(path).where(F.col("block") >= first)
    if blocks is not None:
        df = df.where(F.col("block") < first + blocks)
    return df.withColumn("data", F.hex("data")) if ascii_ else df


def neighbours(graph: DataFrame, ids: DataFrame) -> DataFrame:
    """(src, degree, nbrs) of the vertices wanted (column id): what they point at, by slot; none gives 0 and an empty list."""
    lists = pack_graph(graph.join(ids.select(F.col("id").alias("src")).distinct(), "src", "left_semi"))
    found = ids.select(F.col("id").alias("src")).distinct().join(lists, "src", "left")
    return found.select("src", F.when(F.col("nbrs").isNull(), F.lit(0)).otherwise(F.size("nbrs")).alias("degree"), F.coalesce("nbrs", F.array().cast("array<bigint>")).alias("nbrs"))


def written_back(df: DataFrame, path: str) -> tuple[DataFrame, int]:
    """Writes df, reads it again, and counts rows that differ either way (0: intact)."""
    df.write.mode("overwrite").parquet(path)
    again = df.sparkSession.read.schema(df.schema).parquet(path)
    return again, df.exceptAll(again).count() + again.exceptAll(df).count()


def keep(df: DataFrame, in_memory: bool = True) -> DataFrame:
    """Persists, in memory as far as it goes and else on disk."""
    return df.persist(StorageLevel.MEMORY_AND_DISK if in_memory else StorageLevel.DISK_ONLY)
