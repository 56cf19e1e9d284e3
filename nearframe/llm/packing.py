"""Best-fit packing of token sequences by exact complements.

Only the histogram of piece lengths (at most ``capacity`` rows, whatever the data) is planned on the driver.
``Sums`` indexes the sums of one, two and three available lengths by their value.  For the longest open length,
``plan`` looks up its gap there and consumes, as often as the counts allow, a combination that fills it exactly; what
has no complement is filled best fit.  The plan is a list of segments ``(length, first ordinal, sequence, offset, per
sequence)``; each pattern exhausts at least one length, so there are at most ``capacity`` patterns a pass.  Pieces find
their place by their ordinal among the pieces of their length, which is numbered per task and then offset by
running counts, so no length, however common, meets in one task.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from nearframe.llm.bpe import Vocabulary, loaded, share
from nearframe.llm.common import Scratch, prepare

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, ordinal long"
SEGMENT = ["first", "last", "sequence", "offset", "per"]


class Sums:
    """Combinations of one, two and three lengths by their sum, for lengths with a count above 0.

    ``pairs[s]``: the longer length of each pair of sum s, ascending; ``triples[s]``: the longest length of triples of
    sum s, ascending.  Lengths only ever run out, so entries of those that have are passed over and dropped.
    """

    def __init__(self, left: np.ndarray):
        self.capacity = len(left) - 1
        open_ = np.flatnonzero(left[1:] > 0) + 1
        total = open_[:, None] + open_[None, :]
        a, b = np.nonzero((total <= self.capacity) & (open_[:, None] >= open_[None, :]))
        self.pairs = self._by_sum(total[a, b], open_[a])
        # a triple of longest length x: a pair of the rest whose longer length is at most x
        least = np.array([p[0] if p else self.capacity + 1 for p in self.pairs])
        rest = np.arange(self.capacity + 1)
        total = open_[:, None] + rest[None, :]
        a, r = np.nonzero((total <= self.capacity) & (least[None, :] <= open_[:, None]))
        self.triples = self._by_sum(total[a, r], open_[a])

    def _by_sum(self, total: np.ndarray, longest: np.ndarray) -> list[list[int]]:
        order = np.lexsort((longest, total))
        cuts = np.searchsorted(total[order], np.arange(self.capacity + 2))
        values = longest[order].tolist()
        return [values[s:e] for s, e in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]

    def find(self, gap: int, left: np.ndarray) -> list[int] | None:
        """Available lengths that sum to gap: one, two or three; the longest first, of triples then the most even pair."""
        if left[gap]:
            return [gap]
        pairs = self.pairs[gap]
        for k in range(len(pairs) - 1, -1, -1):
            x = pairs[k]
            if left[x] and left[gap - x] > (2 * x == gap):
                return [x, gap - x]
        triples = self.triples[gap]
        for k in range(len(triples) - 1, -1, -1):
            x = triples[k]
            if not left[x]:
                continue
            left[x] -= 1
            rest = gap - x
            y = next((y for y in self.pairs[rest] if y <= x and left[y] and left[rest - y] > (2 * y == rest)), None)
            left[x] += 1
            if y is not None:
                return [x, y, rest - y]
        return None

    def drop(self, left: np.ndarray) -> None:
        """Forgets combinations of lengths that have run out."""
        self.pairs = [[x for x in p if left[x] and left[s - x]] if p else p for s, p in enumerate(self.pairs)]
        self.triples = [[x for x in p if left[x]] if p else p for p in self.triples]


def plan(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Segments (length, first ordinal, last ordinal + 1, first sequence, offset, pieces a sequence)."""
    left = np.zeros(capacity + 1, np.int64)
    for size, n in counts.items():
        left[size] = n
    used = np.zeros(capacity + 1, np.int64)
    out, sequence = [], 0
    sums, known = Sums(left), int((left > 0).sum())
    while (open_ := np.flatnonzero(left)).size:
        longest = int(open_[-1])
        left[longest] -= 1
        pattern, gap = [longest], capacity - longest
        while gap:
            more = sums.find(gap, left)
            if more is None:
                fits = np.flatnonzero(left[: gap + 1])
                if not fits.size:
                    break
                more = [int(fits[-1])]  # best fit: the longest that the gap takes
            for x in more:
                left[x] -= 1
            pattern += more
            gap -= sum(more)
        for x in pattern:
            left[x] += 1
        need = {x: pattern.count(x) for x in pattern}
        times = min(int(left[x]) // n for x, n in need.items())
        offset = 0
        for x, n in need.items():
            out.append((x, int(used[x]), int(used[x]) + n * times, sequence, offset, n))
            used[x] += n * times
            left[x] -= n * times
            offset += n * x
        sequence += times
        if (now := int((left > 0).sum())) < known // 2:
            sums.drop(left)
            known = now
    return out


def _encoder(source: str) -> Callable[[str], list[int]]:
    """The vocabulary's compiled encoder; texts that it refuses go to the array encoder."""
    vocab: Vocabulary = loaded(source)
    fast = getattr(vocab, "fast", None)
    if fast is None:
        import tiktoken

        special = {s: i for s, i in vocab.special.items()}
        ranks = {b: i for i, b in enumerate(vocab.bytes_of) if b and i not in special.values()}
        pattern = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
        fast = vocab.fast = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens=special)

    def encode(text: str) -> list[int]:
        try:
            return fast.encode(text, allowed_special="all", disallowed_special=())
        except BaseException as e:  # the Rust side panics on some very long runs
            if isinstance(e, (KeyboardInterrupt, SystemExit, MemoryError)):
                raise
            return vocab.encode([text])[0]

    return encode


def pieces(df: DataFrame, path: str, capacity: int = 1024, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The pieces of all texts: ids and end_id, cut into `capacity` tokens; only the first may be shorter."""
    spark = df.sparkSession
    prepare(spark)
    source = share(spark, path)

    def run(batches):
        encode = _encoder(source.value)
        part = TaskContext.get().partitionId()
        seen: dict[int, int] = {}
        for batch in batches:
            rows: list[tuple] = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = np.array([*encode(text or ""), end_id], "<u4")
                head = len(ids) % capacity or capacity
                cuts = [0, *range(head, len(ids) + 1, capacity)]
                for k, (s, e) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
                    nth = seen.get(e - s, 0)
                    seen[e - s] = nth + 1
                    rows.append((doc, k, s, e - s, zlib.crc32(ids[s:e].tobytes()), part, nth))
            if rows:
                cols = list(zip(*rows, strict=True))
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]
                names = ["doc_id", "piece", "start", "length", "ids_crc32", "part", "ordinal"]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=names)

    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, PIECES)


def pack(df: DataFrame, path: str, capacity: int = 1024, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Packs whole texts into sequences of at most `capacity` tokens.

    Returns per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.  A null or empty text is
    one piece with end_id alone; repeated rows are packed each; null ids stay null; an empty table gives an
    empty table; other columns are not carried. The table of running counts has a row for each task and length; it is joined
    as Spark sees fit, and broadcast only while it is below spark.sql.autoBroadcastJoinThreshold.
    """
    spark = df.sparkSession
    scratch = Scratch(spark, "pack")
    cut = scratch.write(pieces(df, path, capacity, end_id, id_col, text_col), "pieces")
    here = scratch.write(cut.groupBy("part", "length").agg((F.max("ordinal") + 1).alias("n")), "counts")
    # at most `capacity` rows reach the driver
    counts = {r["length"]: r["n"] for r in here.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    order = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = here.select("part", "length", F.coalesce(F.sum("n").over(order), F.lit(0)).alias("before"))
    segments = plan(counts, capacity)
    # the plan as one row a length: bounded by the capacity, so it can be broadcast at any input size; as an Arrow
    # table it is a local relation: from a list it would be an RDD that takes Python workers of a kind of its own
    table: dict[int, list[dict[str, int]]] = {}
    for size, *rest in segments:
        table.setdefault(size, []).append(dict(zip(SEGMENT, rest, strict=True)))
    kinds = [pa.int64(), pa.list_(pa.struct([(name, pa.int64()) for name in SEGMENT]))]
    arrays = [pa.array(x, kind) for x, kind in zip((list(table), list(table.values())), kinds, strict=True)]
    lookup = spark.createDataFrame(pa.Table.from_arrays(arrays, names=["length", "segments"]))
    placed = (
        cut.join(before, ["part", "length"])
        .join(F.broadcast(lookup), "length")
        .withColumn("nth", F.col("ordinal") + F.col("before"))
        .withColumn("s", F.filter("segments", lambda x: (x["first"] <= F.col("nth")) & (F.col("nth") < x["last"]))[0])
        .withColumn("k", F.col("nth") - F.col("s.first"))
    )
    return placed.select(
        "doc_id", "piece", "start", "length", "ids_crc32",
        (F.col("s.sequence") + F.expr("k div s.per")).alias("sequence_id"),
        (F.col("s.offset") + (F.col("k") % F.col("s.per")) * F.col("length")).alias("offset"),
    )
