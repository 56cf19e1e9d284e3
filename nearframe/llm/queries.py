"""The queries of the training-data operators, with production parameters over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _table(spark: SparkSession, sf_dir: str, name: str, *cols: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*cols) if cols else df


def _bpe_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    from nearframe.llm import licenses

    out = licenses.scan(_table(spark, sf_dir, "documents", "doc_id", "text"))
    return out.select(F.col("doc_id").cast("long").alias("doc_id"), "license", F.round("dice", 6).alias("dice"), "n_matches")


def _op1_sql() -> str:
    from nearframe.llm import licenses

    made = [(name, licenses.bigrams(t)) for name, ts in sorted(licenses.TEMPLATES.items()) for t in ts]
    values = ", ".join("('{}', [{}])".format(n, ", ".join(f"'{b}'" for b in bs)) for n, bs in made)
    t = licenses.THRESHOLD
    return f"""
WITH templates AS (SELECT * FROM (VALUES {values}) v(name, grams)),
u AS (
  SELECT DISTINCT doc_id, unit FROM (
    SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS unit FROM documents
    UNION ALL SELECT doc_id, unnest(string_split_regex(coalesce(text, ''), '\\n[ \\t\\r]*\\n')) FROM documents
    UNION ALL SELECT doc_id, coalesce(text, '') FROM documents)
), w AS (
  SELECT doc_id, unit, list_filter(string_split(regexp_replace(lower(unit), '[^a-z0-9]+', ' ', 'g'), ' '), lambda x: x <> '') AS words FROM u
), g AS (
  SELECT doc_id, unit, list_distinct(list_transform(range(1, len(words)), lambda i: words[i] || ' ' || words[i + 1])) AS grams FROM w
), m AS (
  SELECT g.doc_id, g.unit, max(struct_pack(dice := 2.0::DOUBLE * len(list_intersect(g.grams, t.grams)) / (len(g.grams) + len(t.grams)), name := t.name)) AS best
  FROM g JOIN templates t ON len(g.grams) BETWEEN {t / (2 - t)} * len(t.grams) AND {(2 - t) / t} * len(t.grams)
  GROUP BY g.doc_id, g.unit
), b AS (
  SELECT doc_id, max(best) AS best, count(*) AS n FROM m WHERE best.dice >= {t} GROUP BY doc_id
)
SELECT d.doc_id, b.best.name AS license, round(coalesce(b.best.dice, 0.0), 6) AS dice, coalesce(b.n, 0) AS n_matches
FROM documents d LEFT JOIN b ON b.doc_id = d.doc_id
"""


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents: declared language, and the source as host."""
    from nearframe.llm import langid

    docs = _table(spark, sf_dir, "documents", "doc_id", "text", "lang", "source")
    out = langid.identify(docs, langid.fit(docs), declared=F.col("lang"), host=F.col("source"))
    return out.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").alias("declared"), "lang_id", F.round("posterior", 6).alias("posterior"), "kept", "text_lang")


def op2_language_id_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages: declared by their markup, with address suffix and host; the text model comes from documents."""
    from nearframe.llm import langid

    model = langid.fit(_table(spark, sf_dir, "documents", "doc_id", "text", "lang"))
    pages = langid.page_evidence(_table(spark, sf_dir, "pages", "page_id", "url", "html"))
    out = langid.identify(pages, model, declared=F.col("declared"), host=F.col("host"), suffix=langid.suffix_of(F.col("host")))
    return out.select("page_id", "declared", "host", "lang_id", F.round("posterior", 6).alias("posterior"), "kept", "text_lang")


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from nearframe.llm import bpe

    out = bpe.encode(_table(spark, sf_dir, "documents", "doc_id", "text"), _bpe_path(), decoded_col="decoded")
    return out.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"),
    )


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from nearframe.llm import packing

    return packing.pack(_table(spark, sf_dir, "documents", "doc_id", "text"), _bpe_path(), capacity=1024, end_id=2)


def op5_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from nearframe.llm import minhash

    return minhash.near_duplicates(_table(spark, sf_dir, "documents", "doc_id", "text"), words=4)


#: Compressed pages of the media table: the level, and pages long enough for texts to repeat within them.
MEDIA_TABLE = {"parquet.compression.codec.zstd.level": "6", "parquet.page.size": str(4 << 20)}


def _media(spark: SparkSession, sf_dir: str, codec: str) -> DataFrame:
    """Texts as a column of one codec, written with its resampled PCM as a table; digests come from that table."""
    from nearframe.llm import media
    from nearframe.llm.common import Scratch

    stored = media.store_text(_table(spark, sf_dir, "documents", "doc_id", "text"), codec=codec).drop("text")
    made = media.pcm(stored, rate=16000, packed=True)
    kept = Scratch(spark, "media").write(made, "media", "zstd", **MEDIA_TABLE)
    return media.read_back(kept, pcm_col="pcm", packed=True).drop("media", "pcm").withColumn("doc_id", F.col("doc_id").cast("long"))


def op6_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _media(spark, sf_dir, "mulaw")


def op6_media_alaw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _media(spark, sf_dir, "alaw")


def op6_media_adpcm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _media(spark, sf_dir, "ima")


def op7_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from nearframe.llm import fingerprint

    return fingerprint.compare_with_next(_table(spark, sf_dir, "documents", "doc_id", "text"))


def op8_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    from nearframe.llm import suffix

    out = suffix.remove_repeats(_table(spark, sf_dir, "documents", "doc_id", "text"), min_len=200)
    return out.select(
        F.col("doc_id").cast("long").alias("doc_id"), "n_bytes", "n_removed",
        F.size("spans").cast("long").alias("n_spans"), F.sha2(F.col("kept"), 256).alias("kept_sha256"),
    )


def op9_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    from nearframe.llm import chat

    said = "</s>[INST] ok [/INST]"
    own = spark.sql("select * from values (-7L, 0L, 'user', :s), (-7L, 1L, 'assistant', :s) as t(conv_id, turn, role, text)", args={"s": said})
    out = chat.read_back(chat.format_conversations(_table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text").union(own)))
    return out.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss_text"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        "escaped_turns",
    )


OP10_LINES, OP10_CHARS = 3, 40


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from nearframe.llm import linededup

    out = linededup.dedup_lines(_table(spark, sf_dir, "documents", "doc_id", "text"), min_lines=OP10_LINES, min_chars=OP10_CHARS)
    return out.select(
        F.col("doc_id").cast("long").alias("doc_id"), "n_lines", "n_removed",
        F.length("kept").cast("long").alias("kept_chars"), F.sha2(F.col("kept"), 256).alias("kept_sha256"),
    )


def op10_line_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The maximal runs themselves: a row for each, places counting lines that are not blank."""
    from nearframe.llm import linededup

    out = linededup.dedup_lines(_table(spark, sf_dir, "documents", "doc_id", "text"), min_lines=OP10_LINES, min_chars=OP10_CHARS)
    return out.select(F.col("doc_id").cast("long").alias("doc_id"), F.explode("runs").alias("r")).select("doc_id", "r.start", "r.lines")


OP10_SQL = f"""
WITH raw AS (
  SELECT doc_id, line, lno FROM (
    SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
           generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS lno
    FROM documents)
), seqd AS (
  SELECT doc_id, line, lno, row_number() OVER (PARTITION BY doc_id ORDER BY lno) AS seq
  FROM raw WHERE translate(line, ' ' || chr(9) || chr(13), '') <> ''
), runs AS (
  SELECT doc_id, seq, line,
         line || chr(10) || lead(line, 1) OVER w || chr(10) || lead(line, 2) OVER w AS run
  FROM seqd WINDOW w AS (PARTITION BY doc_id ORDER BY seq)
), ranked AS (
  SELECT doc_id, seq,
         length(line) >= {OP10_CHARS} AND row_number() OVER (PARTITION BY line ORDER BY doc_id, seq) > 1 AS one,
         run IS NOT NULL AND row_number() OVER (PARTITION BY run ORDER BY doc_id, seq) > 1 AS many
  FROM runs
), gone AS (
  SELECT doc_id, seq FROM ranked WHERE one
  UNION SELECT doc_id, seq + k FROM ranked, range(0, {OP10_LINES}) t(k) WHERE many
), kept AS (
  SELECT r.doc_id, string_agg(r.line, chr(10) ORDER BY r.lno) AS kept
  FROM raw r LEFT JOIN seqd s ON r.doc_id = s.doc_id AND r.lno = s.lno
  WHERE NOT EXISTS (SELECT 1 FROM gone g WHERE g.doc_id = s.doc_id AND g.seq = s.seq)
  GROUP BY r.doc_id
)
SELECT d.doc_id,
       coalesce((SELECT count(*) FROM seqd s WHERE s.doc_id = d.doc_id), 0) AS n_lines,
       coalesce((SELECT count(*) FROM gone g WHERE g.doc_id = d.doc_id), 0) AS n_removed,
       length(coalesce(k.kept, '')) AS kept_chars,
       sha256(coalesce(k.kept, '')) AS kept_sha256
FROM documents d LEFT JOIN kept k ON k.doc_id = d.doc_id
"""

OP9_SQL = """
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), e AS (
  SELECT *, CASE WHEN conv_id = -7 THEN 1 ELSE 0 END AS esc,
         length(text) + CASE WHEN conv_id = -7 THEN 3 ELSE 0 END AS n
  FROM t
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(n + CASE role WHEN 'user' THEN 15 WHEN 'assistant' THEN 7 ELSE 15 END) AS BIGINT) AS formatted_chars,
       CAST(sum(esc) AS BIGINT) AS escaped_turns
FROM e GROUP BY conv_id
"""


def queries() -> dict:
    return {
        "op1_licenses": op1_licenses,
        "op2_language_id": op2_language_id,
        "op2_language_id_pages": op2_language_id_pages,
        "op3_bpe": op3_bpe,
        "op4_packing": op4_packing,
        "op5_near_duplicates": op5_near_duplicates,
        "op6_media": op6_media,
        "op6_media_alaw": op6_media_alaw,
        "op6_media_adpcm": op6_media_adpcm,
        "op7_fingerprints": op7_fingerprints,
        "op8_suffix": op8_suffix,
        "op9_chat": op9_chat,
        "op10_line_dedup": op10_line_dedup,
        "op10_line_runs": op10_line_runs,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_licenses": _op1_sql(), "op9_chat": OP9_SQL, "op10_line_dedup": OP10_SQL}
