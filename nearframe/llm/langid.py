"""Language identification by Bayesian fusion of evidence.

The posterior of a language is the product of the text's likelihood (hashed byte trigrams, tempered as
neighbouring trigrams are not independent), of the likelihoods of the declared language and of the address
suffix, and of the host's prior.  Prior and likelihoods come from grouped aggregation of the text-only
posteriors over all rows: a host's prior is smoothed by its domain's, the domain's by the overall one.  A
class "und" with uniform trigrams stands for text in no known language; such rows are rejected.
"""

from __future__ import annotations

import operator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from nearframe.llm.common import Scratch, add_columns, free_name, position, prepare

BUCKETS = 1 << 15
TEMPER = 0.3
UND, OTHER = "und", "other"
#: Pseudo-counts of the smoothing of hosts by domains and of domains by the whole.
KAPPA = 20.0
#: Bound of the labelled sample for each language, and of the number of languages with a model of their own.
TRAIN_PER_LABEL, MAX_LABELS = 400, 64


@dataclass(frozen=True)
class Model:
    labels: tuple[str, ...]
    logp: np.ndarray  # (labels, BUCKETS) float32


def grams(raws: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Trigram buckets of all texts end to end, and how many each text has; only letters count, the rest is blank.

    Each text stands between blanks, so its trigrams are the same whatever its neighbours.
    """
    data = np.frombuffer(b"  ".join([b"", *raws, b""]), np.uint8)
    low = data | (((data >= 65) & (data <= 90)).astype(np.uint8) << 5)
    letter = ((low >= 97) & (low <= 122)) | (low >= 128)
    low = np.where(letter, low, 32).astype(np.uint32)
    if len(low) < 3:
        return np.empty(0, np.int64), np.zeros(len(raws), np.int64)
    code = (low[:-2] << 16) | (low[1:-1] << 8) | low[2:]
    bucket = ((code * np.uint32(2654435761)) >> np.uint32(17)).astype(np.int64)
    some = letter[:-2].astype(np.int8) + letter[1:-1] + letter[2:] >= 2
    ends = np.cumsum([len(r) + 2 for r in raws])
    owner_cut = np.searchsorted(np.flatnonzero(some), np.minimum(ends, len(bucket)))
    return bucket[some], np.diff(np.concatenate([[0], owner_cut]))


def fit(df: DataFrame, label_col: str = "lang", text_col: str = "text", id_col: str = "doc_id", per_label: int = TRAIN_PER_LABEL) -> Model:
    """Trigram models from a sample of at most per_label labelled rows a language (the smallest hashes of ids).

    Rows without label or text don't count. Of more than MAX_LABELS languages, those with the most rows (on ties the lower
    name) have a model of their own, all others one together, "other". No labelled row: no label.
    """
    prepare(df.sparkSession, 256)
    text = F.col(f"`{text_col}`").cast("string")
    rows = df.select(F.col(f"`{label_col}`").cast("string").alias("label"), text.alias("text"), F.xxhash64(F.lit(2), F.col(f"`{id_col}`"), text).alias("h")).where("label is not null and text is not null")

    def lowest(x: DataFrame) -> DataFrame:
        return x.withColumn("nth", F.row_number().over(Window.partitionBy("label").orderBy("h"))).where(F.col("nth") <= per_label)

    # the bound of each language's hashes first, without texts: a task then never gathers texts of all others
    cuts = lowest(rows.select("label", "h")).groupBy("label").agg(F.max("h").alias("cut")).limit(MAX_LABELS + 1).collect()
    if len(cuts) > MAX_LABELS:
        large = rows.where(F.col("label") != OTHER).groupBy("label").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "label").limit(MAX_LABELS).collect()
        rows = rows.withColumn("label", F.when(F.col("label").isin(*[x["label"] for x in large]), F.col("label")).otherwise(OTHER))
        cuts = lowest(rows.select("label", "h")).groupBy("label").agg(F.max("h").alias("cut")).collect()
    low = reduce(operator.or_, [(F.col("label") == c["label"]) & (F.col("h") <= c["cut"]) for c in cuts], F.lit(False))
    sample = lowest(rows.where(low)).select("label", "text")

    def count(batches):
        total: dict[str, np.ndarray] = {}
        for b in batches:
            for label, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                g, _ = grams([text.encode("utf-8", "replace")])
                total[label] = total.get(label, 0) + np.bincount(g, minlength=BUCKETS)
        for label, c in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([label]), pa.array([c.astype("<i8").tobytes()], pa.binary())], names=["label", "counts"])

    counts = {r["label"]: np.frombuffer(bytes(r["counts"]), "<i8") for r in sample.mapInArrow(count, "label string, counts binary").collect()}
    labels = tuple(sorted(counts))
    logp = np.array([np.log((counts[k] + 0.1) / (counts[k].sum() + 0.1 * BUCKETS)) for k in labels], np.float32).reshape(len(labels), BUCKETS)
    return Model(labels, logp)


def score(df: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """Adds ``loglik`` array<double>, a language each and "und" last (tempered), and ``n_grams``."""
    prepare(df.sparkSession, 256)
    at = position(df, text_col)
    shared = df.sparkSession.sparkContext.broadcast(model.logp)  # (MAX_LABELS + 1) * BUCKETS * 4 bytes at most
    n = len(model.labels) + 1

    def run(batch: pa.RecordBatch) -> list[pa.Array]:
        logp = shared.value
        raws = [(t or "").encode("utf-8", "replace") for t in batch.column(at).to_pylist()]
        out, sizes, lo = [], [], 0
        while lo < len(raws):
            hi, size = lo, 0
            while hi < len(raws) and (hi == lo or size < 500_000):
                size += len(raws[hi])
                hi += 1
            g, count = grams(raws[lo:hi])
            cut = np.concatenate([[0], np.cumsum(count)])
            total = np.empty((len(logp) + 1, len(count)))
            total[-1] = count * -np.log(BUCKETS)
            for k, row in enumerate(logp):  # one language at a time, and a million trigrams of it
                sums = np.zeros(len(count))
                for at_ in range(0, len(g), 1 << 20):
                    part = np.concatenate([[0.0], np.cumsum(row[g[at_ : at_ + (1 << 20)]], dtype=np.float64)])
                    ends = np.clip(cut - at_, 0, len(part) - 1)
                    sums += part[ends[1:]] - part[ends[:-1]]
                total[k] = sums
            out.append(total * TEMPER)
            sizes.append(count)
            lo = hi
        flat = np.concatenate(out, axis=1).T.reshape(-1)
        offsets = np.arange(0, len(flat) + 1, n, dtype=np.int32)
        item = pa.list_(pa.field("element", pa.float64(), False))
        return [pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat), type=item), pa.array(np.concatenate(sizes))]

    fields = [T.StructField("loglik", T.ArrayType(T.DoubleType(), False), False), T.StructField("n_grams", T.LongType(), False)]
    return add_columns(df, fields, run)


def _softmax(logs: Column) -> Column:
    top = F.array_max(logs)
    raw = F.transform(logs, lambda x: F.exp(x - top))
    total = F.aggregate(raw, F.lit(0.0), lambda a, x: a + x)
    return F.transform(raw, lambda x: x / total)


def _sums(n: int, of: str = "post") -> Column:
    return F.array(*[F.sum(F.col(of)[k]) for k in range(n)])


def _smoothed(counts: Column, base: Column) -> Column:
    total = F.aggregate(counts, F.lit(0.0), lambda a, x: a + x)
    return F.zip_with(counts, base, lambda c, p: (c + KAPPA * p) / (total + KAPPA))


def domain_of(host: Column) -> Column:
    """The last two labels of a host."""
    return F.substring_index(host, ".", -2)


def suffix_of(host: Column) -> Column:
    return F.when(host.contains("."), F.lower(F.substring_index(host, ".", -1)))


def identify(df: DataFrame, model: Model, text_col: str = "text", declared: Column | None = None, host: Column | None = None, suffix: Column | None = None, min_posterior: float = 0.5) -> DataFrame:
    """Adds lang_id, posterior, kept, text_lang (by text alone) to the columns of df but text_col.

    declared, host, suffix: the further evidence; where one is null or not given it says nothing.  A language
    declared by a tag counts by the tag's first part; one that isn't modelled counts as "other".  Rejected
    (kept false): "und" is likeliest, the posterior is below min_posterior, or the text (null: empty) has no trigram of
    letters.  Repeated rows are identified each; an empty table, and a model without languages, give lang_id
    "und".  Added columns replace those of the same name.
    """
    spark = df.sparkSession
    prepare(spark, 256)
    scratch = Scratch(spark, "langid")
    none = F.lit(None).cast("string")
    tag = F.regexp_extract(F.lower(F.coalesce(declared if declared is not None else none, F.lit(""))), "^[a-z]+", 0)
    known = F.when(tag == "", None).when(tag.isin(*model.labels) if model.labels else F.lit(False), tag).otherwise(OTHER)
    added = ["lang_id", "posterior", "kept", "text_lang"]
    rest = [F.col(f"`{c}`") for i, c in enumerate(df.columns) if i != position(df, text_col) and c.lower() not in added]
    filler = free_name(df, "_")  # a struct needs a field
    base = df.select(F.struct(F.lit(0).alias(filler), *rest).alias("row"), F.col(f"`{text_col}`").cast("string").alias("text"), known.alias("declared"), F.lower(host if host is not None else none).alias("host"), F.lower(suffix if suffix is not None else none).alias("suffix"))
    scored = score(base, model).drop("text")
    names = F.array(*[F.lit(x) for x in (*model.labels, UND)])
    n = len(model.labels) + 1
    s = scratch.write(scored.withColumns({"post": _softmax(F.col("loglik")), "domain": domain_of(F.col("host"))}), "scores")
    heard = s.where("n_grams > 0")
    # the overall distribution: one row of n numbers
    overall = heard.agg(*[F.sum(F.col("post")[k]).alias(f"s{k}") for k in range(n)]).first()
    sums = [float(x or 0.0) for x in overall]
    world = F.array(*[F.lit((x + 1) / (sum(sums) + n)) for x in sums])
    by_domain = heard.where("domain is not null").groupBy("domain").agg(_sums(n).alias("c")).select("domain", _smoothed(F.col("c"), world).alias("domain_prior"))
    by_host = heard.where("host is not null").groupBy("host", "domain").agg(_sums(n).alias("c")).join(by_domain, "domain").select("host", _smoothed(F.col("c"), F.col("domain_prior")).alias("prior"))
    out = s.join(scratch.write(by_host, "hosts"), "host", "left")

    def likelihood(column: str) -> DataFrame:
        """log P(value | language), one smoothed count for each language."""
        t = heard.where(F.col(column).isNotNull()).groupBy(column).agg(_sums(n).alias("c"))
        logs = F.transform(F.zip_with("c", F.array(*[F.lit(x) for x in sums]), lambda c, m: F.struct(c.alias("c"), m.alias("m"))), lambda z: F.log((z["c"] + 0.5) / (z["m"] + 5.0)))
        return scratch.write(t.select(column, logs.alias(f"{column}_log")), column)

    for column in ("declared", "suffix"):
        out = out.join(likelihood(column), column, "left")
    logs = F.zip_with("loglik", F.coalesce("prior", world), lambda x, p: x + F.log(p))
    for column in ("declared_log", "suffix_log"):
        logs = F.zip_with(logs, F.coalesce(column, F.array_repeat(F.lit(0.0), n)), lambda x, y: x + y)
    out = out.withColumn("fused", _softmax(logs))
    best = F.array_position("fused", F.array_max("fused")).cast("int")
    lang = F.when(F.col("n_grams") == 0, F.lit(UND)).otherwise(F.element_at(names, best))
    by_text = F.when(F.col("n_grams") == 0, F.lit(UND)).otherwise(F.element_at(names, F.array_position("post", F.array_max("post")).cast("int")))
    posterior = F.array_max("fused")
    own = [F.col("row")[c.name].alias(c.name) for c in base.schema["row"].dataType.fields[1:]]
    return out.select(*own, lang.alias("lang_id"), posterior.alias("posterior"), ((lang != UND) & (posterior >= min_posterior)).alias("kept"), by_text.alias("text_lang"))


def page_evidence(pages: DataFrame) -> DataFrame:
    """page_id, text, declared and host of pages (page_id, url, html); other columns are not carried.

    A null html is an empty text and declares nothing; a null or odd url has no host. Repeated pages are read each; an
    empty table gives an empty table.
    """
    html = F.coalesce(F.col("html"), F.lit(""))
    text = F.regexp_replace(html, "(?is)<(script|style)\\b.*?</\\1\\s*>|<!--.*?-->|<[^>]*>|&[a-z#0-9]+;", " ")
    declared = F.regexp_extract(html, "(?i)<html[^>]*\\slang\\s*=\\s*[\"']?([a-z]+)", 1)
    host = F.regexp_extract(F.coalesce(F.col("url"), F.lit("")), "(?i)^[a-z]+://(?:[^/@]*@)?([^/:?#]+)", 1)
    return pages.select("page_id", text.alias("text"), F.nullif(declared, F.lit("")).alias("declared"), F.nullif(host, F.lit("")).alias("host"))
