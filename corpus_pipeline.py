"""Corpus preparation in five stages; each works on all rows that its predecessor kept.

1. language ID: documents in no known language go.
2. line dedup: later copies of repeated runs of lines go; documents that lose every line go.
3. near duplicates: one document of each group (the smallest doc_id) stays.
4. suffix-array dedup: bytes of repeated 200-byte strings go; documents that lose every byte go.
5. packing: what is left becomes sequences of at most 1024 tokens.

A document without text is not a duplicate of anything: stage 1 rejects it, as no language can be told.
All but the last stage return the five columns of documents (other columns are not carried); n_chars follows the text.
Rows that repeat an id are judged each by its own text, and so are rows without one; of rows equal in id and text one
stays after stage 3. An empty table passes through every stage.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nearframe.llm import langid, linededup, minhash, packing, suffix
from nearframe.llm.common import Scratch

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
LINES, LINE_CHARS = 3, 40
SHINGLE_WORDS = 5
REPEAT_BYTES = 200
CAPACITY, END_ID = 1024, 2


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _with_text(df: DataFrame, text) -> DataFrame:
    out = df.withColumn("text", text)
    return out.where("text <> ''").select("doc_id", "text", "lang", "source", F.length("text").cast("long").alias("n_chars"))


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    docs = docs.select(*COLUMNS).withColumn("_h", F.xxhash64(F.lit(1), "text"))
    model = langid.fit(docs)
    found = langid.identify(docs, model, declared=F.col("lang"), host=F.col("source"))
    rejected = found.where("not kept").select(F.col("doc_id").alias("_id"), F.col("_h").alias("_g")).distinct()
    rejected = Scratch(spark, "rejected").write(rejected)  # its size is then known: texts only move if it is large
    mine = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_h") == F.col("_g"))
    return docs.join(rejected, mine, "left_anti").select(*COLUMNS)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = linededup.dedup_lines(docs.select(*COLUMNS), min_lines=LINES, min_chars=LINE_CHARS)
    return _with_text(out.where("n_removed < n_lines or n_lines = 0"), F.col("kept"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    docs = docs.select(*COLUMNS)
    scratch = Scratch(spark, "copies")
    again = scratch.write(docs.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1 or doc_id is null").select(F.col("doc_id").alias("_id"), F.lit(True).alias("_again")))
    rows = docs.withColumn("_node", F.col("doc_id"))
    if not again.isEmpty():  # rows without an id of their own get a number by id and text, above usual ids
        number = F.xxhash64("doc_id", "text").bitwiseAND(F.lit((1 << 62) - 1)) + F.lit(1 << 62)
        told = docs.dropDuplicates(["doc_id", "text"]).join(again, F.col("doc_id").eqNullSafe(F.col("_id")), "left")
        rows = scratch.write(told.select(*COLUMNS, F.when(F.col("_again"), number).otherwise(F.col("doc_id")).alias("_node")))
    gone = minhash.near_duplicates(rows, id_col="_node", words=SHINGLE_WORDS).where("not kept").select(F.col("doc_id").alias("_node"))
    gone = scratch.write(gone)
    return rows.join(gone, "_node", "left_anti").select(*COLUMNS)


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    # a cut can fall inside a character: what is left of it goes too
    out = suffix.remove_repeats(docs.select(*COLUMNS), min_len=REPEAT_BYTES, as_text=True)
    return _with_text(out.where("n_removed < n_bytes"), F.col("kept"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, tokenizer_path(), CAPACITY, END_ID)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("suffix_dedup", suffix_dedup),
    ("packing", pack),
]

#: Three stages can't be said in SQL; tests/llm compares each stage with a brute-force version instead.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir, each written as Parquet in the shared folder and read again."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    written: DataFrame | None = None
    for name, stage in STAGES:
        out = scratch.write(stage(spark, docs, sf_dir), name)
        scratch.drop(written)
        docs = written = out
    return docs
