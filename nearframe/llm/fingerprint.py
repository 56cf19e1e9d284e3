"""Document fingerprints from statistically improbable byte windows, in chained Bloom filters.

Each 64-byte window has an entropy (in thousandths of its maximum of 6 bits, kept in whole numbers, so it is
the same on every machine).  ``rarity_ranks`` turns entropies into precedence by a rule: the further from the
typical entropy of prose, the rarer; windows of almost no or almost full entropy say nothing and never
count.  In each run of 64 windows the rarest (leftmost on ties) gains a point, and windows of
``POINTS`` points or more are features.  A feature sets five bits of a 2048-bit filter; a filter takes
``PER_FILTER`` features, then the chain goes on.
"""

from __future__ import annotations

import base64
import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from nearframe.llm.common import add_columns, position, prepare
from nearframe.llm.vectext import prefix_hash, slice_hash, window_argmin

WINDOW = 64
RUN = 64
POINTS = 16
BITS, PER_FILTER, HASHES = 2048, 160, 5
SCALE = 1 << 20
TYPICAL, LEAST, MOST = 690, 100, 990


def _parts() -> np.ndarray:
    """What a byte that stands c times in a window adds to its entropy, c = 0..64, of 1000 * SCALE."""
    return np.array([0] + [round(-(c / WINDOW) * math.log2(c / WINDOW) / 6 * 1000 * SCALE) for c in range(1, WINDOW + 1)], np.int64)


PART = _parts()


def rarity_ranks(typical: int = TYPICAL, least: int = LEAST, most: int = MOST) -> np.ndarray:
    """Precedence of each entropy 0..1000, lower is rarer; 65535 never counts."""
    h = np.arange(1001)
    rank = 1000 - np.abs(h - typical)
    return np.where((h < least) | (h > most), 65535, rank).astype(np.uint16)


RANKS = rarity_ranks()


def entropies(data: np.ndarray) -> np.ndarray:
    """Entropy of the window at each place, in thousandths; each step exchanges one byte's part for another's."""
    n = len(data)
    ahead, behind = np.zeros(n, np.uint8), np.zeros(n, np.uint8)
    for d in range(1, WINDOW):
        same = (data[d:] == data[:-d]).view(np.uint8)
        ahead[:-d] += same
        behind[d:] += same
    gone = ahead[: n - WINDOW].astype(np.int64) + 1
    come = behind[WINDOW:].astype(np.int64)
    first = PART[np.bincount(data[:WINDOW], minlength=1)].sum()
    steps = PART[gone - 1] - PART[gone] + PART[come + 1] - PART[come]
    return (np.concatenate([[first], first + np.cumsum(steps)]) // SCALE).clip(0, 1000)


def filters(raws: list[bytes], ranks: np.ndarray = RANKS) -> list[np.ndarray]:
    """The chain of filters of each text, (filters, BITS / 8) uint8; an empty text has an empty chain.

    A text with no feature of enough points has its rarest window as one, a text shorter than a window the whole.
    """
    out = [np.zeros((0, BITS // 8), np.uint8)] * len(raws)
    lo = 0
    while lo < len(raws):
        hi, size = lo, 0
        while hi < len(raws) and (hi == lo or size + len(raws[hi]) < 250_000):
            size += len(raws[hi])
            hi += 1
        _filters_of(raws, lo, hi, ranks, out)
        lo = hi
    return out


def _filters_of(raws: list[bytes], lo: int, hi: int, ranks: np.ndarray, out: list[np.ndarray]) -> None:
    data = np.frombuffer(b"".join(raws[lo:hi]) + b"\0" * (WINDOW + RUN), np.uint8)
    lens = np.array([len(r) for r in raws[lo:hi]])
    begin = np.concatenate([[0], np.cumsum(lens)[:-1]])
    prefix = prefix_hash(data)
    rank = ranks[entropies(data)]
    n = len(rank)
    owner = np.repeat(np.arange(len(lens)), lens)
    owner = np.concatenate([owner, np.full(max(0, n - len(owner)), -1)])[:n]
    at = np.arange(n)
    windows = np.maximum(lens - WINDOW + 1, 0)
    inside = (owner >= 0) & (at < (begin + windows)[owner])
    rank = np.where(inside, rank, 65535)
    best = window_argmin(rank, RUN)
    whole_run = inside[: len(best)] & (at[: len(best)] + RUN <= (begin + windows)[owner[: len(best)]])
    points = np.bincount(best[whole_run], minlength=n)
    chosen = np.flatnonzero((points >= POINTS) & (rank < 65535))
    have = np.bincount(owner[chosen], minlength=len(lens)) if len(chosen) else np.zeros(len(lens), np.int64)
    start, end = [chosen], [chosen + WINDOW]
    for k in np.flatnonzero((have == 0) & (lens > 0)).tolist():
        s = int(begin[k])
        if windows[k]:
            s += int(rank[s : s + int(windows[k])].argmin())
            e = s + WINDOW
        else:
            e = s + int(lens[k])
        start.append(np.array([s]))
        end.append(np.array([e]))
    start, end = np.concatenate(start), np.concatenate(end)
    order = np.argsort(start, kind="stable")
    start, end = start[order], end[order]
    of = owner[start]
    code = slice_hash(prefix, start, end)
    count = np.bincount(of, minlength=len(lens))
    chain = -(-count // PER_FILTER)
    base = np.concatenate([[0], np.cumsum(chain)])
    nth = np.arange(len(of)) - np.concatenate([[0], np.cumsum(count)])[of]
    row = base[of] + nth // PER_FILTER
    bits = np.zeros((int(base[-1]), BITS), bool)
    for k in range(HASHES):
        bits[row, ((code >> np.uint64(11 * k)) & np.uint64(BITS - 1)).astype(np.int64)] = True
    packed = np.packbits(bits, axis=1)
    for i in range(len(lens)):
        out[lo + i] = packed[base[i] : base[i + 1]]


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """0 to 1: mean over the filters of the shorter chain (both ways if equal) of the best normalised overlap.

    The overlap of two filters counts above what filters so full share by chance. Two empty chains: 1.
    """
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    if a.shape == b.shape and np.array_equal(a, b):
        return 1.0
    na, nb = np.bitwise_count(a).sum(axis=1, dtype=np.int64), np.bitwise_count(b).sum(axis=1, dtype=np.int64)
    both = np.stack([np.bitwise_count(x & b).sum(axis=1, dtype=np.int64) for x in a])
    chance = na[:, None] * nb[None, :] / BITS
    most = np.minimum(na[:, None], nb[None, :])
    score = np.clip((both - chance) / np.maximum(most - chance, 1e-9), 0, 1)
    if len(a) == len(b):
        return float((score.max(axis=1).mean() + score.max(axis=0).mean()) / 2)
    return float(score.max(axis=1).mean() if len(a) < len(b) else score.max(axis=0).mean())


def dump(chain: np.ndarray) -> str:
    return f"{len(chain)}:" + base64.b64encode(chain.tobytes()).decode()


def load(s: str) -> np.ndarray:
    n, _, body = s.partition(":")
    return np.frombuffer(base64.b64decode(body), np.uint8).reshape(int(n), BITS // 8)


def fingerprint(df: DataFrame, text_col: str = "text", out_col: str = "fingerprint") -> DataFrame:
    """Adds the fingerprint of each whole text (null: empty); a column of that name is replaced."""
    prepare(df.sparkSession, 256)
    at = position(df, text_col)

    def run(batch: pa.RecordBatch) -> list[pa.Array]:
        raws = [(t or "").encode("utf-8", "replace") for t in batch.column(at).to_pylist()]
        return [pa.array([dump(c) for c in filters(raws)], pa.string())]

    return add_columns(df, [T.StructField(out_col, T.StringType(), False)], run)


def _key(id_: Column, text: Column) -> Column:
    """Order of documents, null ids first: by id; of equal ids by a hash of the text; equal rows as they come."""
    return F.struct(id_.isNotNull().alias("some"), F.coalesce(id_, F.lit(0)).alias("id"), F.xxhash64(text).alias("hash"), F.xxhash64(F.monotonically_increasing_id()).alias("nth"))


def _bounds(docs: DataFrame, n: int) -> list[tuple[bool, int, int, int]]:
    """Keys that cut the documents into about n buckets: quantiles of ids, and of hashes where many rows have one id."""
    width = 1 << 64

    def cuts(parts: int) -> list[int]:
        return [k * width // parts - (width >> 1) for k in range(1, parts)]

    def spread(some: bool, id_: int, share: float) -> list[tuple[bool, int, int, int]]:
        """Within one id: by the text's hash, and by row within each text's hash (equal rows can be many)."""
        parts = min(n, math.ceil(share * n))
        rows = docs.where(F.col("doc_id").eqNullSafe(F.lit(id_ if some else None).cast("long")))
        heavy = rows.groupBy(F.xxhash64("text").alias("h")).agg(F.count("*").alias("c")).where(F.col("c") * n > size)
        out = [(some, id_, h, -(width >> 1)) for h in cuts(parts)]
        for r in heavy.collect():  # fewer than n: each has more than a share of 1 / n of all rows
            out += [(some, id_, r["h"], x) for x in cuts(min(n, math.ceil(r["c"] * n / size)))]
        return out

    counts = docs.agg(F.count("*"), F.count("doc_id")).first()
    size, ids = counts[0], counts[1]
    out: list[tuple[bool, int, int, int]] = []
    if n < 2 or not size:
        return out
    if (size - ids) * n > size:
        out += spread(False, 0, (size - ids) / size)
    if ids:
        # quantiles are doubles: beyond 2^53 a bound moves by a few ids, and stays in the range of longs
        edges = docs.where("doc_id is not null").approxQuantile("doc_id", [k / n for k in range(1, n)], 1 / (4 * n))
        whole = [min(max(int(x), -(width >> 1)), (width >> 1) - 1) for x in edges]
        out += [(True, x, -(width >> 1), -(width >> 1)) for x in set(whole)]
        for x in {x for x in whole if whole.count(x) > 1}:
            here = docs.where(F.col("doc_id") == x).count()
            if here * n > size:
                out += spread(True, x, here / size)
    return sorted(set(out))


def _bucket(key: Column, bounds: list[tuple[bool, int, int, int]]) -> Column:
    """How many of the sorted bounds are at or below the key, by a search in two steps."""
    if not bounds:
        return F.lit(0)
    width = max(1, math.isqrt(len(bounds)))
    chunks = [bounds[i : i + width] for i in range(0, len(bounds), width)]

    def keys(rows: list[tuple[bool, int, int, int]]) -> Column:
        names = ("some", "id", "hash", "nth")
        return F.array(*[F.struct(*[(F.lit(v) if k == "some" else F.lit(v).cast("long")).alias(k) for k, v in zip(names, r, strict=True)]) for r in rows])

    coarse = F.size(F.filter(keys([c[0] for c in chunks]), lambda b: b <= key))
    fine = F.get(F.array(*[keys(c) for c in chunks]), coarse - 1)
    return F.when(coarse == 0, F.lit(0)).otherwise((coarse - 1) * width + F.size(F.filter(fine, lambda b: b <= key))).cast("int")


OUT = [("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()),
       ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())]


def compare_with_next(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of each text, of its edited text and of the next document's, and their likeness.

    Edited: the last floor(n/4) code points give way to the first as many (or all) of the next document by
    ascending id; after the last comes the first.  Order: null ids first, rows of one id by a hash of their texts.
    A null text is empty.  Returns doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited,
    near_next; an empty table gives an empty table; other columns are not carried.

    Texts move once, to buckets of consecutive documents whose bounds are quantiles (their number follows the number
    of shuffle partitions; an id or a text that very many rows have is cut too); each bucket also gets the first document
    of the next one that isn't empty.
    """
    spark = df.sparkSession
    prepare(spark, 256)
    docs = df.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))
    n = min(4096, 4 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    keyed = docs.withColumn("key", _key(F.col("doc_id"), F.col("text")))
    placed = keyed.withColumn("bucket", _bucket(F.col("key"), _bounds(docs, n)))
    # one row a bucket: the bucket before it takes its first document
    least = placed.groupBy("bucket").agg(F.min("key").alias("least"))
    order = Window.orderBy("bucket")
    numbered = least.select("least", F.col("bucket").alias("own"), F.coalesce(F.lag("bucket").over(order), F.max("bucket").over(Window.partitionBy())).alias("before"))
    heads = placed.join(F.broadcast(numbered), (F.col("bucket") == F.col("own")) & F.col("key").eqNullSafe(F.col("least")))
    rows = placed.select("bucket", F.lit(False).alias("follows"), "doc_id", "text", "key").union(heads.select("before", F.lit(True), "doc_id", "text", "key"))

    def emit(docs_: list[tuple], chains: list[np.ndarray], nexts: list[tuple], next_chains: list[np.ndarray]) -> pa.RecordBatch:
        edited = [t[: len(t) - len(t) // 4] + u[: len(t) // 4] for (_, t), (_, u) in zip(docs_, nexts, strict=True)]
        raws = [e.encode("utf-8", "replace") for e in edited]
        changed = filters(raws)
        rows_ = [
            (i, len(t), hashlib.sha256(r).hexdigest(), dump(c), dump(x), likeness(c, x), likeness(c, y))
            for (i, t), r, c, x, y in zip(docs_, raws, chains, changed, next_chains, strict=True)
        ]
        cols = list(zip(*rows_, strict=True)) if rows_ else [()] * len(OUT)
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, (_, k) in zip(cols, OUT, strict=True)], names=[n for n, _ in OUT])

    def run(batches):
        waiting: tuple | None = None  # the document whose successor has not come yet, and its chain
        for b in batches:
            follows, ids, texts = (b.column(k).to_pylist() for k in (1, 2, 3))
            chains = filters([t.encode("utf-8", "replace") for t in texts])
            first, second = [], []
            for f, i, t, c in zip(follows, ids, texts, chains, strict=True):
                if waiting is not None:
                    first.append(waiting)
                    second.append(((i, t), c))
                waiting = None if f else ((i, t), c)
            yield emit([d for d, _ in first], [c for _, c in first], [d for d, _ in second], [c for _, c in second])

    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    ordered = rows.repartition("bucket").sortWithinPartitions("bucket", "follows", "key")
    return ordered.select("bucket", "follows", "doc_id", "text").mapInArrow(run, schema)
