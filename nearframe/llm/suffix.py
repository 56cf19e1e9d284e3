"""Repeated byte strings by sorted suffixes, deep-shallow.

A string of ``min_len`` bytes that repeats contains, at the same place in each copy, the same anchor: the
leftmost of its ``KMER``-byte strings with the smallest hash.  So suffixes are sorted only at anchors (one in
some 75 bytes), and only those whose anchor string stands elsewhere too:

1. Every anchor has the run of window starts that chose it, and thus a context: the bytes of those windows.
   Anchors of equal contexts (128-bit digests of the bytes) are counted, and one stands for them.
2. Different contexts of one anchor string are sorted twice, by the bytes from the anchor on and by those
   before it, backwards: multikey quicksort to ``SHALLOW`` bytes, then a blind trie for each group that is
   still tied.  A window t bytes before the anchor repeats iff another context lies with it in one interval
   of common prefix >= t on the left and >= min_len - t on the right.
3. An anchor string with more than ``GROUP`` different contexts does not meet in one task: a distributed step sorts
   further into the depth.  Windows with t in a..b need a common left of a bytes and a common right of min_len - b, so
   contexts that share those bytes are a group; groups that are still too large halve their range of t, down to single
   windows, which are equal throughout.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from nearframe.llm.common import Scratch, prepare
from nearframe.llm.vectext import prefix_hash, slice_hash, window_argmin

KMER = 50
SHALLOW = 16
GROUP = 4096
#: A key of more than a HOT-th of all rows (so there are fewer than HOT of them) is dealt over several tasks.
HOT = 1000
CHUNK = 1 << 19


# -- sorting ------------------------------------------------------------------------------------------
def common(a: bytes, b: bytes) -> int:
    """Length of the common prefix."""
    n = min(len(a), len(b))
    x = int.from_bytes(a[:n], "big") ^ int.from_bytes(b[:n], "big")
    return n - (x.bit_length() + 7) // 8


class BlindTrie:
    """A trie of branching places only: [depth, {byte or -1: child}, a leaf below]; leaves are lists of indices."""

    def __init__(self, strings: list[bytes], first: int):
        self.strings = strings
        self.root: list = [first]

    def _leaf(self, node: list) -> list[int]:
        while isinstance(node[0], tuple):
            node = node[1]
        return node

    def insert(self, i: int) -> None:
        s, node = self.strings[i], self.root
        while isinstance(node[0], tuple):  # blind: bytes between branching places are not looked at
            depth, children = node[0]
            node = children.get(s[depth] if depth < len(s) else -1, node[1])
        other = self.strings[node[0]]
        h = common(s, other)
        if h == len(s) == len(other):
            node.append(i)
            return
        parent, key, node = None, None, self.root
        while isinstance(node[0], tuple) and node[0][0] < h:
            depth, children = node[0]
            parent, key = node, s[depth] if depth < len(s) else -1
            node = children[key]
        mine = s[h] if h < len(s) else -1
        if isinstance(node[0], tuple) and node[0][0] == h:
            node[0][1][mine] = [i]
            return
        sample = self.strings[self._leaf(node)[0]]
        fork = [(h, {mine: [i], sample[h] if h < len(sample) else -1: node}), node]
        if parent is None:
            self.root = fork
        else:
            parent[0][1][key] = fork
            if parent[1] is node:
                parent[1] = fork

    def order(self) -> list[int]:
        out, stack = [], [self.root]
        while stack:
            node = stack.pop()
            if isinstance(node[0], tuple):
                stack.extend(child for _, child in sorted(node[0][1].items(), key=lambda x: -x[0]))
            else:
                out.extend(node)
        return out


def deep_shallow(strings: list[bytes], shallow: int = SHALLOW) -> tuple[list[int], list[int]]:
    """Order of the strings and the common prefix of each with its predecessor (0 for the first)."""
    order: list[int] = []
    stack: list[tuple[list[int], int]] = [(list(range(len(strings))), 0)]
    while stack:
        group, depth = stack.pop()
        if len(group) == 1:
            order.append(group[0])
        elif depth >= shallow:
            trie = BlindTrie(strings, group[0])
            for i in group[1:]:
                trie.insert(i)
            order.extend(trie.order())
        else:  # multikey quicksort: three ways by the byte at this depth
            at = [strings[i][depth] if depth < len(strings[i]) else -1 for i in group]
            pivot = at[len(at) // 2]
            less = [i for i, c in zip(group, at, strict=True) if c < pivot]
            same = [i for i, c in zip(group, at, strict=True) if c == pivot]
            more = [i for i, c in zip(group, at, strict=True) if c > pivot]
            if more:
                stack.append((more, depth))
            if pivot == -1:
                # all ended here and are equal; they come after less, before more
                if less:
                    raise AssertionError("nothing sorts before the end of a string")
                order.extend(same)
                continue
            stack.append((same, depth + 1))
            if less:
                stack.append((less, depth))
    lcp = [0] * len(order)
    for k in range(1, len(order)):
        lcp[k] = common(strings[order[k - 1]], strings[order[k]])
    return order, lcp


def reach(left: list[bytes], right: list[bytes], min_len: int) -> list[tuple[int, int]]:
    """For each context how far its repeated windows go before and behind the anchor; (-1, -1) if none repeats.

    left: bytes before the anchor, backwards; right: bytes from the anchor on.
    """
    m = len(left)
    lo, ll = deep_shallow(left)
    ro, rl = deep_shallow(right)
    best = [(-1, -1)] * m
    if m <= 8:
        r = {}
        for a in range(m):
            low = 1 << 30
            for b in range(a + 1, m):
                low = min(low, rl[b])
                r[ro[a], ro[b]] = r[ro[b], ro[a]] = low
        for a in range(m):
            low = 1 << 30
            for b in range(a + 1, m):
                low = min(low, ll[b])
                i, j = lo[a], lo[b]
                if low + r[i, j] >= min_len:
                    for x in (i, j):
                        best[x] = (max(best[x][0], low), max(best[x][1], r[i, j]))
        return best
    lo_, ll_, ro_, rl_ = (np.array(x) for x in (lo, ll, ro, rl))
    before, behind = np.array([len(x) for x in left]), np.array([len(x) for x in right])
    far, near = np.full(m, -1), np.full(m, -1)
    cl, cr = np.empty(m, np.int64), np.empty(m, np.int64)
    for t in range(min(int(before.max()), min_len) + 1):
        ok = np.flatnonzero((before >= t) & (behind >= min_len - t))
        if len(ok) < 2:
            continue
        cl[lo_] = np.cumsum(ll_ < t)
        cr[ro_] = np.cumsum(rl_ < min_len - t)
        _, inv, n = np.unique(cl[ok] * (m + 1) + cr[ok], return_inverse=True, return_counts=True)
        twice = ok[n[inv] > 1]
        far[twice] = t
        near[twice] = np.maximum(near[twice], min_len - t)
    return list(zip(far.tolist(), near.tolist(), strict=True))


# -- anchors ------------------------------------------------------------------------------------------
def anchors_of(raws: list[bytes], min_len: int) -> tuple[np.ndarray, ...]:
    """text number, place, kmer hash, context digest in two halves, bytes before, bytes behind for all anchors of the texts."""
    pieces = [(i, s) for i, r in enumerate(raws) if len(r) >= min_len for s in range(0, len(r) - min_len + 1, CHUNK)]
    out = []
    lo = 0
    while lo < len(pieces):
        hi, size, parts = lo, 0, []
        while hi < len(pieces) and (hi == lo or size < CHUNK):
            i, s = pieces[hi]
            parts.append(raws[i][s : s + CHUNK + min_len - 1])
            size += len(parts[-1])
            hi += 1
        data = np.frombuffer(b"".join(parts), np.uint8)
        lens = np.array([len(p) for p in parts])
        begin = np.concatenate([[0], np.cumsum(lens)[:-1]])
        prefix = prefix_hash(data)
        at = np.arange(len(data) - KMER + 1)
        key = slice_hash(prefix, at, at + KMER)
        anchor = window_argmin(key, min_len - KMER + 1)
        window = np.arange(len(anchor))
        piece = np.repeat(np.arange(len(parts)), lens)[: len(anchor)]
        inside = window + min_len <= (begin + lens)[piece]
        anchor, window, piece = anchor[inside], window[inside], piece[inside]
        new = np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (piece[1:] != piece[:-1])])
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(anchor)) - 1
        a, p_lo, p_hi, piece = anchor[first], window[first], window[last], piece[first]
        whole = memoryview(data)
        digests = b"".join([hashlib.blake2b(whole[x:y], digest_size=16).digest() for x, y in zip(p_lo.tolist(), (p_hi + min_len).tolist(), strict=True)])
        context = np.frombuffer(digests, "<i8").reshape(-1, 2)
        source = np.array([i for i, _ in pieces[lo:hi]])[piece]
        place = a - begin[piece] + np.array([s for _, s in pieces[lo:hi]])[piece]
        out.append((source, place, key[a].view(np.int64), context[:, 0], context[:, 1], (a - p_lo).astype(np.int32), (p_hi + min_len - a).astype(np.int32)))
        lo = hi
    if not out:
        z = np.empty(0, np.int64)
        return z, z, z, z, z, z.astype(np.int32), z.astype(np.int32)
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


ANCHOR = "k1 long, k2 long, pos long, kmer long, ctx long, ctx2 long, before int, behind int"


def _anchors(docs: DataFrame, min_len: int) -> DataFrame:
    def run(batches):
        for b in batches:
            raws = [(t or "").encode("utf-8", "replace") for t in b.column(2).to_pylist()]
            source, *cols = anchors_of(raws, min_len)
            k1, k2 = (np.asarray(b.column(i))[source] for i in (0, 1))
            names = ["k1", "k2", "pos", "kmer", "ctx", "ctx2", "before", "behind"]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in (k1, k2, *cols)], names=names)

    return docs.select("k1", "k2", "text").mapInArrow(run, ANCHOR)


CONTEXT = "k1 long, k2 long, pos long, kmer long, n long, d long, left binary, right binary"


def _contexts(reps: DataFrame, docs: DataFrame) -> DataFrame:
    """The bytes around each representative anchor."""
    per_doc = reps.groupBy("k1", "k2").agg(F.collect_list(F.struct("pos", "kmer", "n", "d", "before", "behind")).alias("anchors"))
    joined = docs.select("k1", "k2", "text").join(per_doc, ["k1", "k2"])
    names = [f.name for f in T._parse_datatype_string(CONTEXT).fields]
    kinds = [pa.int64()] * 6 + [pa.binary()] * 2

    def run(batches):
        for b in batches:
            rows = []
            for k1, k2, text, anchors in zip(*[c.to_pylist() for c in b.columns], strict=True):
                raw = text.encode("utf-8", "replace")
                for a in anchors:
                    p = a["pos"]
                    rows.append((k1, k2, p, a["kmer"], a["n"], a["d"], raw[p - a["before"] : p][::-1], raw[p : p + a["behind"]]))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    return joined.select("k1", "k2", "text", "anchors").mapInArrow(run, CONTEXT)


SPAN = "k1 long, k2 long, s long, e long"


def _spans(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) if rows else [()] * 4
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["k1", "k2", "s", "e"])


def _sorted_spans(contexts: DataFrame, key: list[str], min_len: int) -> DataFrame:
    """Spans of contexts that occur once but share windows with another one; groups stream through in order of the key."""
    width = len(key)

    def flush(group: list[tuple], out: list[tuple]) -> None:
        if len(group) > 1:
            reached = reach([g[-2] for g in group], [g[-1] for g in group], min_len)
            for (k1, k2, pos, n, _, _), (far, near) in zip((g[width:] for g in group), reached, strict=True):
                if far >= 0 and n == 1:
                    out.append((k1, k2, pos - far, pos + near))

    def run(batches):
        group: list[tuple] = []
        for b in batches:
            out: list[tuple] = []
            for row in zip(*[c.to_pylist() for c in b.columns], strict=True):
                if group and group[-1][:width] != row[:width]:
                    flush(group, out)
                    group = []
                group.append(row)
            yield _spans(out)
        out = []
        flush(group, out)
        yield _spans(out)

    return contexts.select(*key, "k1", "k2", "pos", "n", "left", "right").repartition(*key).sortWithinPartitions(*key).mapInArrow(run, SPAN)


def _split_spans(contexts: DataFrame, min_len: int, scratch: Scratch) -> DataFrame | None:
    """The same for anchor strings of very many contexts: groups by the bytes that windows in a range of t need alike."""
    key = ["kmer", "a", "b", "same"]
    rows = contexts.select("kmer", F.lit(0).alias("a"), F.lit(min_len - KMER).alias("b"), "k1", "k2", "pos", "n", "left", "right")
    out: DataFrame | None = None
    while not rows.isEmpty():
        middle = F.floor((F.col("a") + F.col("b")) / 2).cast("int")
        halves = F.array(F.struct(F.col("a"), middle.alias("b")), F.struct((middle + 1).alias("a"), F.col("b")))
        parts = rows.withColumn("half", F.explode(halves)).withColumns({"a": F.col("half.a"), "b": F.col("half.b")}).drop("half")
        parts = parts.where((F.col("a") <= F.col("b")) & (F.length("left") >= F.col("a")) & (F.length("right") >= min_len - F.col("b")))
        same = F.concat(F.expr("substring(left, 1, a)"), F.expr(f"substring(right, 1, {min_len} - b)"))
        parts = scratch.write(parts.withColumn("same", same), "parts")
        sizes = scratch.write(parts.groupBy(*key).agg(F.count("*").alias("size")).where("size > 1"), "part-sizes")
        met = scratch.write(parts.join(sizes, key), "split")
        scratch.drop(parts, sizes)
        window = met.where("a = b and n = 1").select("k1", "k2", (F.col("pos") - F.col("a")).alias("s"), (F.col("pos") - F.col("a") + min_len).alias("e"))
        small = _sorted_spans(met.where((F.col("size") <= GROUP) & (F.col("a") < F.col("b"))), key, min_len)
        found = window.union(small)
        out = found if out is None else out.union(found)
        rows = met.where((F.col("size") > GROUP) & (F.col("a") < F.col("b"))).drop("same", "size")
    return out


def _among(rows: DataFrame, keys: DataFrame, key: list[str], total: int) -> DataFrame:
    """The rows (of total) whose key is one of keys, which has each key once with its number of rows n.

    A very common key would meet in one task, and be split by Spark only if it comes in many blocks: it is salted
    instead, by as many parts as it has HOT-ths of all rows. The list of such keys has fewer than HOT rows.
    """
    dealt = keys.select(*key, F.ceil(F.col("n") * HOT / F.lit(max(total, 1))).cast("int").alias("parts"))
    salt = F.coalesce(F.pmod(F.xxhash64("k1", "k2", "pos"), F.col("parts")), F.lit(0)).cast("int")
    salted = rows.join(F.broadcast(dealt.where("parts > 1")), key, "left").withColumn("salt", salt).drop("parts")
    every = dealt.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
    return salted.join(every, [*key, "salt"], "left_semi").drop("salt")


def repeated_spans(docs: DataFrame, min_len: int, scratch: Scratch) -> DataFrame:
    """(k1, k2, s, e): byte spans of windows of min_len bytes that start anywhere else too; docs: k1, k2, text."""
    found = scratch.write(_anchors(docs, min_len), "anchors")
    again = scratch.write(found.groupBy("kmer").agg(F.count("*").alias("n")).where("n > 1"), "kmers")
    some = scratch.write(_among(found, again, ["kmer"], found.count()), "repeated")
    scratch.drop(found, again)
    key = ["kmer", "ctx", "ctx2", "before", "behind"]
    groups = scratch.write(some.groupBy(*key).agg(F.count("*").alias("n"), F.min(F.struct("k1", "k2", "pos")).alias("rep")), "contexts")
    whole = _among(some, groups.where("n > 1"), key, some.count()).select(
        "k1", "k2", (F.col("pos") - F.col("before")).alias("s"), (F.col("pos") + F.col("behind")).alias("e")
    )
    several = groups.groupBy("kmer").agg(F.count("*").alias("d"), F.min("n").alias("least")).where("d > 1 and least = 1").select("kmer", "d")
    several = scratch.write(several, "several")
    reps = groups.join(several, "kmer").select("rep.k1", "rep.k2", "rep.pos", "kmer", "n", "d", "before", "behind")
    contexts = scratch.write(_contexts(reps, docs), "bytes")
    found = whole.union(_sorted_spans(contexts.where(F.col("d") <= GROUP), ["kmer"], min_len))
    deep = _split_spans(contexts.where(F.col("d") > GROUP), min_len, scratch)
    return scratch.write(found if deep is None else found.union(deep), "spans")


def remove_repeats(df: DataFrame, text_col: str = "text", min_len: int = 200, id_col: str = "doc_id", as_text: bool = False) -> DataFrame:
    """Adds what is left of each text without the bytes of repeated strings of min_len bytes, judged on the input.

    Adds n_bytes, n_removed, spans array<struct<s,e>> (maximal removed runs of bytes) and kept binary (as_text:
    a string, without the bytes of characters that a cut has split); columns of these names are replaced. A null text counts as empty; matches never cross rows; rows that repeat an id
    are texts of their own, and copies of each other if their texts are equal. An empty table gives an empty
    table. Texts of any length are treated whole.
    """
    spark = df.sparkSession
    prepare(spark, 256)
    scratch = Scratch(spark, "suffix")
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    k1, k2 = F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(-1)).alias("k1"), F.xxhash64(F.lit(7), text).alias("k2")
    docs = df.select(k1, k2, text.alias("text"))
    spans = repeated_spans(docs, min_len, scratch)
    per_doc = spans.distinct().groupBy("k1", "k2").agg(F.sort_array(F.collect_list(F.struct("s", "e"))).alias("spans"))
    added = ["n_bytes", "n_removed", "spans", "kept"]
    rest = [c for c in df.columns if c.lower() not in added]
    own = df.select(F.struct(*[F.col(f"`{c}`") for c in rest]).alias("row"), k1, k2, text.alias("text"))
    joined = own.join(per_doc, ["k1", "k2"], "left").select("row", "text", "spans")
    fields = [T.StructField("row", joined.schema["row"].dataType)] + T._parse_datatype_string(
        f"n_bytes long, n_removed long, spans array<struct<s:long,e:long>>, kept {'string' if as_text else 'binary'}").fields
    span_type = pa.list_(pa.struct([pa.field("s", pa.int64()), pa.field("e", pa.int64())]))

    def run(batches):
        for b in batches:
            size, gone, runs, kept = [], [], [], []
            for t, spans_ in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                raw = t.encode("utf-8", "replace")
                merged: list[list[int]] = []
                for x in spans_ or []:
                    if merged and x["s"] <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], x["e"])
                    else:
                        merged.append([x["s"], x["e"]])
                ends = [0, *(e for _, e in merged)]
                starts = [*(s for s, _ in merged), len(raw)]
                left = b"".join([raw[e:s] for e, s in zip(ends, starts, strict=True)])
                size.append(len(raw))
                gone.append(len(raw) - len(left))
                runs.append([{"s": s, "e": e} for s, e in merged])
                kept.append(left.decode("utf-8", "ignore") if as_text else left)
            arrays = [b.column(0), pa.array(size, pa.int64()), pa.array(gone, pa.int64()), pa.array(runs, span_type), pa.array(kept, pa.string() if as_text else pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays, names=["row", *added])

    return joined.mapInArrow(run, T.StructType(fields)).select("row.*", *added)
