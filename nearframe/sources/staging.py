"""Tables staged in the folder that driver and executors share, to cut lineage between steps of a plan."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (spark.checkpoint.dir); a temporary one only in local mode."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("nearframe.scratch.dir", "")
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="nearframe-")
        spark.conf.set("nearframe.scratch.dir", base)
    return base.rstrip("/")


def delete(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def stage(df: DataFrame) -> DataFrame:
    """df, computed once: written as Parquet and read again. The files go when the process ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/nearframe-stage-{uuid.uuid4().hex[:12]}"
    df.write.parquet(path)

    def clean() -> None:
        if spark.sparkContext._jsc is not None:
            try:
                delete(spark, path)
            except Exception:  # the JVM may be gone when the interpreter ends
                pass

    atexit.register(clean)
    return spark.read.schema(df.schema).parquet(path)
