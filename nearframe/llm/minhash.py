"""Near-duplicate documents by SetSketch registers.

A register holds floor(1 - log_b(x)) of the smallest of the exponential variates that its hash gives the
elements of a set, truncated to 0..q+1.  Registers of a union are the larger ones of the parts (``merge``), and
two sets agree in a register with a probability close to their Jaccard similarity.  Four 16-bit registers are
one 64-bit band value.

1. Documents of equal shingle sets form a class, and one of them represents it from here on.
2. Representatives that share a band value share a bucket.  In each round every bucket names a centre, and
   members that are not yet in the centre's component are compared with it alone: rows are linear in members,
   and a group of near copies becomes one component without all its pairs being made.
3. What is left are buckets that hold several components.  Two of their members can only be linked if they share one
   of their rarest shingles (the first n - ceil(n * threshold) + 1 of n, by how many members have them), and those
   that one member alone has don't count.  Members meet at such a shingle: up to ``MEET`` as pairs, so rows are linear
   in members; a shingle that more have in common brings its members together in blocks of bounded size.
4. Pairs pass if the jointly most likely similarity of their registers could reach the threshold.  Every link is
   then confirmed on full shingle sets of 128-bit hashes, and components come from confirmed links only.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearframe.llm.common import Scratch, prepare
from nearframe.llm.components import components
from nearframe.llm.vectext import shingle_sets

REGISTERS = 120
BAND = 4
B, A, Q = 1.001, 20.0, 65534
ROUNDS = 3
#: Members of a rare shingle that meet as pairs; of one that more have, blocks of so many members (and bytes of sets) meet.
MEET, BLOCK, BLOCK_BYTES = 32, 256, 16 << 20
#: Registers of the estimate within blocks.
FINE = 1024
#: Standard errors below the threshold at which an estimate still goes to the exact check.
MARGIN = 6.0
_rng = np.random.Generator(np.random.PCG64(77))
_MUL = _rng.integers(1, 1 << 63, 1024, np.uint64) | np.uint64(1)
_ADD = _rng.integers(0, 1 << 63, 1024, np.uint64)


def sketch(elements: np.ndarray, m: int = REGISTERS) -> np.ndarray:
    """m uint16 registers of a set of 64-bit hashes (all 0 for an empty set)."""
    low = np.full(m, np.iinfo(np.uint64).max, np.uint64)
    step = max(1, 40_000 // m)
    for k in range(0, len(elements), step):
        x = elements[None, k : k + step] * _MUL[:m, None] + _ADD[:m, None]
        np.minimum(low, x.min(axis=1), out=low)
    if not len(elements):
        return np.zeros(m, np.uint16)
    x = -np.log1p(-(low.astype(np.float64) + 0.5) / 2.0**64) / A
    return np.clip(np.floor(1 - np.log(x) / np.log(B)), 0, Q + 1).astype(np.uint16)


def merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Registers of the union of two sets."""
    return np.maximum(a, b)


def jaccard(r1: np.ndarray, r2: np.ndarray, n1: np.ndarray, n2: np.ndarray, steps: int = 200) -> np.ndarray:
    """The most likely similarity of pairs, from registers (pairs, m) and the sets' sizes, on a grid."""
    m = r1.shape[1]
    more, less = (r1 > r2).sum(axis=1), (r1 < r2).sum(axis=1)
    u, v = n1 / (n1 + n2), n2 / (n1 + n2)
    top = np.minimum(u / v, v / u)
    j = np.linspace(0, 1, steps + 1)[None, :] * top[:, None]

    def p(x: np.ndarray) -> np.ndarray:
        return -np.log1p(-np.clip(x, 0, 1) * (B - 1) / B) / np.log(B)

    pu, pv = p(u[:, None] - v[:, None] * j), p(v[:, None] - u[:, None] * j)
    tiny = 1e-12
    score = (
        more[:, None] * np.log(np.maximum(pu, tiny))
        + less[:, None] * np.log(np.maximum(pv, tiny))
        + (m - more - less)[:, None] * np.log(np.maximum(1 - pu - pv, tiny))
    )
    return np.take_along_axis(j, score.argmax(axis=1)[:, None], axis=1)[:, 0]


def could_link(r1: np.ndarray, r2: np.ndarray, n1: np.ndarray, n2: np.ndarray, num: int, den: int) -> np.ndarray:
    t = num / den
    floor = t - MARGIN * (t * (1 - t) / r1.shape[1]) ** 0.5
    # registers are equal at least as often as the sets are alike, so too few equal ones settle it
    sized = (np.minimum(n1, n2) * den >= np.maximum(n1, n2) * num) & ((r1 == r2).mean(axis=1) >= floor)
    ok = np.zeros(len(n1), bool)
    if sized.any():
        ok[sized] = jaccard(r1[sized], r2[sized], n1[sized].astype(float), n2[sized].astype(float)) >= floor
    return ok


def _rows(names: list[str], kinds: list[pa.DataType], rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) if rows else [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=names)


def _raw(texts: pa.Array) -> list[bytes]:
    return [(t or "").encode("utf-8", "replace") for t in texts.to_pylist()]


def sketches(df: DataFrame, id_col: str, text_col: str, words: int, m: int = REGISTERS) -> DataFrame:
    """doc_id, n_shingles, set_key (null: empty set), registers."""
    prepare(df.sparkSession, 256)

    def run(batches):
        for b in batches:
            rows = []
            for doc, s in zip(b.column(0).to_pylist(), shingle_sets(_raw(b.column(1)), words), strict=True):
                key = hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None
                rows.append((doc, len(s), key, sketch(s[:, 0], m).astype("<u2").tobytes() if len(s) else None))
            yield _rows(["doc_id", "n_shingles", "set_key", "registers"], [pa.int64(), pa.int64(), pa.binary(), pa.binary()], rows)

    base = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return base.mapInArrow(run, "doc_id long, n_shingles long, set_key binary, registers binary")


def _sets(df: DataFrame, words: int) -> DataFrame:
    """rep and elements: the first halves of all hashes in order, then their second halves."""

    def run(batches):
        for b in batches:
            made = shingle_sets(_raw(b.column(1)), words)
            yield _rows(["rep", "elements"], [pa.int64(), pa.binary()], [(i, s.T.tobytes()) for i, s in zip(b.column(0).to_pylist(), made, strict=True)])

    return df.mapInArrow(run, "rep long, elements binary")


def _bands(reps: DataFrame, m: int) -> DataFrame:
    count = m // BAND

    def run(batches):
        for b in batches:
            regs = np.frombuffer(b"".join(b.column(1).to_pylist()), "<u2").reshape(b.num_rows, -1)[:, : count * BAND]
            value = np.ascontiguousarray(regs).view("<i8").reshape(-1)
            rep = np.repeat(np.asarray(b.column(0)), count)
            band = np.tile(np.arange(count, dtype=np.int32), b.num_rows)
            yield pa.RecordBatch.from_arrays([pa.array(rep), pa.array(band), pa.array(value)], names=["rep", "band", "value"])

    return reps.select("rep", "registers").mapInArrow(run, "rep long, band int, value long")


def _set(elements: bytes) -> np.ndarray:
    return np.frombuffer(elements, np.uint64).reshape(2, -1)


def _linked(x: np.ndarray, y: np.ndarray, num: int, den: int) -> bool:
    """den * intersection >= num * union, of two sets that are not empty."""
    n, m = x.shape[1], y.shape[1]
    at = np.searchsorted(x[0], y[0])
    at[at == n] = 0
    both = int(np.count_nonzero((x[0][at] == y[0]) & (x[1][at] == y[1])))
    return den * both >= num * (n + m - both)


def _likely(pairs: DataFrame, classes: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs (a, b) whose registers and sizes allow a similarity of num / den."""

    def run(batches):
        for b in batches:
            if b.num_rows:
                n1, n2 = (np.asarray(b.column(c)) for c in (2, 3))
                r1, r2 = (np.frombuffer(b"".join(b.column(c).to_pylist()), "<u2").reshape(b.num_rows, -1) for c in (4, 5))
                ok = pa.array(could_link(r1, r2, n1, n2, num, den))
                yield pa.RecordBatch.from_arrays([b.column(0).filter(ok), b.column(1).filter(ok)], names=["a", "b"])

    side = [classes.select(F.col("rep").alias(c), F.col("n_shingles").alias(f"n{c}"), F.col("registers").alias(f"r{c}")) for c in "ab"]
    met = pairs.join(side[1], "b").join(side[0], "a").select("a", "b", "na", "nb", "ra", "rb")
    return met.mapInArrow(run, "a long, b long")


def _confirm(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs (a, b) whose full sets have den * intersection >= num * union."""

    def run(batches):
        for b in batches:
            keep = []
            last, x = None, np.empty((2, 0), np.uint64)
            for i, j, p, q in zip(*[c.to_pylist() for c in b.columns], strict=True):
                if p is not last:
                    last, x = p, _set(p)
                if _linked(x, _set(q), num, den):
                    keep.append((i, j))
            yield _rows(["u", "v"], [pa.int64(), pa.int64()], keep)

    left = sets.select(F.col("rep").alias("a"), F.col("elements").alias("ea"))
    right = sets.select(F.col("rep").alias("b"), F.col("elements").alias("eb"))
    return pairs.join(right, "b").join(left, "a").select("a", "b", "ea", "eb").mapInArrow(run, "u long, v long")


def _meeting(members: DataFrame, sets: DataFrame, num: int, den: int, scratch: Scratch) -> DataFrame:
    """(shingle, rep, label, n, m, centre): members of several components at the rare shingles where links must meet.

    Sets of a similarity of num / den or more have at least c = ceil(n * num / den) shingles in common, n being the size
    of either; in any order of all shingles, their first n - c + 1 then share one. The order is by frequency among the
    members, so most sets begin with shingles of their own, which need no row. m: rows at the shingle; centre: its least rep.
    """

    def run(batches):
        for b in batches:
            for rep, e in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                first = _set(e)[0].view(np.int64)
                own = int.from_bytes(hashlib.blake2b(e, digest_size=8).digest(), "little", signed=True)
                cols = [np.full(len(first), x, np.int64) for x in (rep, own, len(first))]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in (*cols, first)], names=["rep", "own", "n", "shingle"])

    every = sets.join(members.select("rep"), "rep", "left_semi").mapInArrow(run, "rep long, own long, n long, shingle long")
    every = scratch.write(every, "shingles")
    often = scratch.write(every.groupBy("shingle").agg(F.count("*").alias("f")).where("f > 1"), "often")
    by_set = every.join(often, "shingle").groupBy("rep", "own", "n").agg(F.sort_array(F.collect_list(F.struct("f", "shingle"))).alias("common"))
    # the first places belong to the set's own shingles; what is left of the prefix meets others
    prefix = F.col("n") - F.ceil(F.col("n") * num / F.lit(den)) + 1
    left = F.greatest(prefix - (F.col("n") - F.size("common")), F.lit(0)).cast("int")
    rows = by_set.select("rep", "n", F.explode(F.slice("common", F.lit(1), left)).alias("c")).select("rep", "n", F.col("c.shingle").alias("shingle"))
    rows = scratch.write(rows.join(members, "rep"), "prefixes")
    met = rows.groupBy("shingle").agg(F.count("*").alias("m"), F.min("rep").alias("centre"), F.min("label").alias("lo"), F.max("label").alias("hi"))
    met = scratch.write(met.where("lo <> hi").drop("lo", "hi"), "meetings")
    out = scratch.write(rows.join(met, "shingle"), "met")
    scratch.drop(every, often, rows, met)
    return out


def _apart(members: DataFrame, sets: DataFrame, classes: DataFrame, num: int, den: int, scratch: Scratch) -> DataFrame:
    """Links (u, v) between components that the rounds have left apart; members: rep, label of unresolved buckets."""
    met = _meeting(members, sets, num, den, scratch)
    few, many = met.where(F.col("m") <= MEET), met.where(F.col("m") > MEET)
    side = [few.select("shingle", F.col("rep").alias(c), F.col("label").alias(f"l{c}"), F.col("n").alias(f"n{c}")) for c in "ab"]
    sized = F.least("na", "nb") * den >= F.greatest("na", "nb") * num
    pairs = scratch.write(side[0].join(side[1], "shingle").where((F.col("a") < F.col("b")) & (F.col("la") != F.col("lb")) & sized).select("a", "b").distinct(), "pairs")
    links = _confirm(_likely(pairs, classes, num, den), sets, num, den)
    return links if many.isEmpty() else links.union(_blocks(many.select("rep", "label", "n", "centre").distinct(), sets, num, den, scratch))


def _blocks(rows: DataFrame, sets: DataFrame, num: int, den: int, scratch: Scratch) -> DataFrame:
    """Links between members (rep, label, n, centre) of meetings of more than MEET, in blocks.

    Meetings that overlap form a cluster. A cluster is cut into blocks of about BLOCK members (fewer if their sets
    are large), and every two blocks meet in a group of their own, with finer registers and full sets. A group
    passes over pairs that its own links have already joined, so it returns fewer links than it has members.
    """
    rows = scratch.write(rows, "many")
    spans = components(rows.select(F.col("rep").alias("u"), F.col("centre").alias("v")), scratch)
    spans = scratch.write(spans.select(F.col("node").alias("rep"), F.col("root").alias("cluster")), "clusters")
    members = scratch.write(rows.groupBy("rep", "label").agg(F.max("n").alias("n")).join(spans, "rep"), "members")
    parts = F.greatest(F.ceil(F.count("*") / F.lit(BLOCK)), F.ceil(F.sum("n") * 16 / F.lit(BLOCK_BYTES)))
    size = scratch.write(members.groupBy("cluster").agg(parts.cast("int").alias("blocks")), "sizes")
    placed = members.drop("n").join(size, "cluster").withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    fine = _fine(sets.join(members.select("rep"), "rep", "left_semi"))
    met = placed.join(fine, "rep").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "cluster", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "block", "rep", "label", "registers", "elements"
    )

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("rep", kind="stable")
        regs = np.frombuffer(b"".join(pdf["registers"]), "<u2").reshape(len(pdf), -1)
        rep, block = (pdf[c].to_numpy() for c in ("rep", "block"))
        sets_ = [_set(e) for e in pdf["elements"]]
        n = np.array([s.shape[1] for s in sets_], np.int64)
        label = np.unique(pdf["label"].to_numpy(), return_inverse=True)[1]
        out = []
        for i in range(len(pdf)):
            later = np.arange(len(pdf)) > i
            if key[1] != key[2]:
                later &= block != block[i]
            at = np.flatnonzero(later & (label != label[i]) & (np.minimum(n, n[i]) * den >= np.maximum(n, n[i]) * num))
            if not len(at):
                continue
            at = at[could_link(np.broadcast_to(regs[i], (len(at), regs.shape[1])), regs[at], np.full(len(at), n[i]), n[at], num, den)]
            for j in at.tolist():
                if label[i] != label[j] and _linked(sets_[i], sets_[j], num, den):
                    out.append((rep[i], rep[j]))
                    label[label == label[j]] = label[i]
        return pd.DataFrame(out, columns=["u", "v"], dtype="int64")

    return met.groupBy("cluster", "lo", "hi").applyInPandas(run, "u long, v long")


def _fine(sets: DataFrame) -> DataFrame:
    """rep, elements and FINE registers of each set."""

    def run(batches):
        for b in batches:
            regs = [sketch(_set(e)[0], FINE).astype("<u2").tobytes() for e in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(regs, pa.binary())], names=["rep", "elements", "registers"])

    return sets.select("rep", "elements").mapInArrow(run, "rep long, elements binary, registers binary")


def _relabel(labels: DataFrame | None, links: DataFrame, scratch: Scratch) -> DataFrame:
    """(rep, root) after further links (u, v): only old components are joined, by their roots."""
    if labels is None:
        return components(links, scratch).withColumnRenamed("node", "rep")
    of = {c: labels.select(F.col("rep").alias(c), F.col("root").alias(f"r{c}")) for c in "uv"}
    between = links.join(of["u"], "u", "left").join(of["v"], "v", "left").select(F.coalesce("ru", "u").alias("u"), F.coalesce("rv", "v").alias("v"))
    merged = scratch.write(components(between, scratch).withColumnRenamed("root", "new"), "merged")
    old = labels.join(merged, F.col("root") == F.col("node"), "left").select("rep", F.coalesce("new", "root").alias("root"))
    return old.union(merged.join(labels.select(F.col("rep").alias("node")), "node", "left_anti").select(F.col("node").alias("rep"), F.col("new").alias("root")))


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, num: int = 80, den: int = 100, registers: int = REGISTERS) -> DataFrame:
    """Links documents with den * |A and B| >= num * |A or B| over distinct `words`-word shingles.

    Returns doc_id, n_shingles, component_id (smallest id reachable), kept (doc_id = component_id).  Words are
    runs without ASCII white space, A-Z lowered; a text of fewer words is one shingle; a text without words
    (null, empty) has none, links with nothing and is kept.  Rows that repeat an id count as one document.  Rows
    without an id link with nothing: their component_id is null and kept is true.  An empty table gives an
    empty table; other columns are not carried.
    """
    spark = df.sparkSession
    scratch = Scratch(spark, "near")
    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    sk = scratch.write(sketches(docs, "doc_id", "text", words, registers), "sketches")
    usable = sk.where("set_key is not null and doc_id is not null")
    classes = scratch.write(
        usable.groupBy("set_key").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n_shingles"), F.first("registers").alias("registers")),
        "classes",
    )
    bands = _bands(classes, registers)
    # counted apart, so that the join below is on plain rows and a large bucket can be split
    shared = scratch.write(bands.groupBy("band", "value").agg(F.count("*").alias("n")).where("n > 1").drop("n"), "shared")
    live = scratch.write(bands.join(shared, ["band", "value"]), "buckets")
    named = scratch.write(live.select("rep").distinct(), "live")
    texts = docs.join(named.withColumnRenamed("rep", "doc_id"), "doc_id", "left_semi")
    sets = scratch.write(_sets(texts, words), "sets")
    labels: DataFrame | None = None
    tried: DataFrame | None = None
    active, round_, last = live, 0, ROUNDS == 0
    while True:
        tagged = active.withColumn("label", F.col("rep")) if labels is None else active.join(labels, "rep", "left").withColumn("label", F.coalesce("root", "rep")).drop("root")
        order = F.struct(F.xxhash64("rep", F.lit(round_)) if round_ else F.lit(0).cast("long"), F.col("rep"), F.col("label"))
        centres = tagged.groupBy("band", "value").agg(F.min(order).alias("c"), F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi")
        centres = scratch.write(centres.select("band", "value", F.col("c.rep").alias("centre"), F.col("c.label").alias("centre_label")), "centres")
        here = scratch.write(tagged.join(centres, ["band", "value"]), "active")  # members of buckets with several components
        if here.isEmpty():
            break
        active = here.select("band", "value", "rep")
        if last:
            found = _apart(scratch.write(here.select("rep", "label").distinct(), "apart"), sets, classes, num, den, scratch)
        else:
            pairs = here.where("label <> centre_label").select(F.least("rep", "centre").alias("a"), F.greatest("rep", "centre").alias("b")).distinct()
            if tried is not None:
                pairs = pairs.join(tried, ["a", "b"], "left_anti")
            new = scratch.write(pairs, "pairs")
            tried = new if tried is None else tried.union(new)
            found = _confirm(_likely(new, classes, num, den), sets, num, den)
        found = scratch.write(found, "links")
        joined = not found.isEmpty()
        if joined:
            labels = scratch.write(_relabel(labels, found, scratch), "labels")
        if last:
            break
        round_ += 1
        last = round_ >= ROUNDS or not joined
    out = sk.join(classes.select("set_key", "rep"), "set_key", "left")
    if labels is not None:
        out = out.join(labels, "rep", "left")
    else:
        out = out.withColumn("root", F.lit(None).cast("long"))
    scratch.drop(live, sets)
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("root", "rep", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))
