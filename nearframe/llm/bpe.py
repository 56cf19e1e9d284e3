"""Byte-level BPE over whole texts: contiguous rank arrays, a batch of short words at a time.

Each distinct word is a row of two small matrices, the part ids and the merge ranks of adjacent parts.
Every pass finds the lowest rank of each row (leftmost on ties), deletes the boundary behind it and looks
up the ranks of the two new neighbours.  Words over ``LONG_WORD`` bytes use a heap over a linked list,
since scanning is quadratic in a word's length.  Words are cached per worker up to ``CACHE_WORDS``.

The vocabulary file is read on the driver and broadcast (its size does not depend on the data).
"""

from __future__ import annotations

import gc
import heapq
import json
from itertools import chain

import numpy as np
import pyarrow as pa
import unicodedata
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from nearframe.llm.common import add_columns, position, prepare

CACHE_WORDS = 250_000
LONG_WORD = 128
# The white space of the Unicode standard, and English contractions of the pattern.
SPACES = [9, 10, 11, 12, 13, 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
ONE_LETTER = "stmd"
TWO_LETTERS = ("re", "ve", "ll")
OTHER, LETTER, NUMBER, SPACE = range(4)


def byte_chars() -> list[str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


def char_classes() -> np.ndarray:
    kinds = {"L": LETTER, "N": NUMBER}
    table = np.fromiter((kinds.get(unicodedata.category(chr(c))[0], OTHER) for c in range(0x110000)), np.uint8, 0x110000)
    table[SPACES] = SPACE
    return table


class Vocabulary:
    """Lookup tables from the text of a tokenizer file; ``encode`` and ``decode`` work on lists of texts."""

    def __init__(self, source: str):
        spec = json.loads(source)
        model = spec["model"]
        to_byte = {c: b for b, c in enumerate(byte_chars())}
        vocab: dict[str, int] = model["vocab"]
        size = max([*vocab.values(), *(t["id"] for t in spec.get("added_tokens", []))]) + 1
        self.bytes_of: list[bytes] = [b""] * size
        for token, i in vocab.items():
            self.bytes_of[i] = bytes(to_byte[c] for c in token) if all(c in to_byte for c in token) else token.encode()
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        for token, i in self.special.items():
            self.bytes_of[i] = token.encode()
        # two bytes an entry where the vocabulary allows it: the matrices of a block then stay in cache
        self.kind = np.uint16 if size < 2**16 - 1 else np.int32
        self.none = int(np.iinfo(self.kind).max)
        self.byte_id = np.array([vocab[c] for c in byte_chars()], self.kind)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        keys = np.array([vocab[a] * size + vocab[b] for a, b in pairs], np.int64)
        order = np.argsort(keys, kind="stable")
        self.size, self.keys, self.rank_at = size, keys[order], order.astype(self.kind)
        self.merged = np.array([vocab[a + b] for a, b in pairs], self.kind)
        self.classes = char_classes()
        self.cache: dict[str, tuple[int, ...]] = {}

    # -- words ------------------------------------------------------------------------------------
    def starts(self, cp: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Marks where words begin. cp: code points of texts laid end to end; first: marks texts' starts."""
        n = len(cp)
        kind = self.classes[cp]
        space = kind == SPACE
        prev_space = np.empty(n, bool)
        prev_space[0], prev_space[1:] = False, space[:-1]
        prev_space[first] = False
        changed = np.empty(n, bool)
        changed[0], changed[1:] = True, kind[1:] != kind[:-1]
        blank = cp == 32
        prev_blank = np.empty(n, bool)
        prev_blank[0], prev_blank[1:] = False, blank[:-1]
        prev_blank[first] = False
        # a word starts where the class changes, except behind a blank, which belongs to the word
        start = changed & ~prev_blank
        start |= first
        # the last white space of a longer run, when text follows, is a word's start of its own
        follows = np.empty(n, bool)
        follows[-1], follows[:-1] = False, ~space[1:] & ~first[1:]
        start |= space & prev_space & follows
        start[space & ~prev_space] = True
        quotes = np.flatnonzero(start & (cp == 39))
        for q in quotes.tolist():
            tail = "".join(map(chr, cp[q + 1 : q + 3].tolist()))
            size = 1 if tail[:1] and tail[0] in ONE_LETTER else 2 if tail in TWO_LETTERS else 0
            if size and not first[q + 1 : q + 1 + size].any():
                start[q + 1 : q + 1 + size] = False
                if q + 1 + size < n:
                    start[q + 1 + size] = True
        return start

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a.astype(np.int64) * self.size + b
        at = np.searchsorted(self.keys, key)
        at[at == len(self.keys)] = 0
        return np.where(self.keys[at] == key, self.rank_at[at], self.kind(self.none))

    def merge_words(self, words: list[bytes]) -> list[tuple[int, ...]]:
        out: list[tuple[int, ...] | None] = [None] * len(words)
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        for low, high in ((0, 4), (4, 8), (8, 12), (12, 16), (16, 24), (24, 48), (48, LONG_WORD)):
            of = np.flatnonzero((lengths > low) & (lengths <= high))
            step = max(1, 60_000 // high)
            for k in range(0, len(of), step):
                self._merge_block(words, of[k : k + step], lengths, high, out)
        for i in np.flatnonzero(lengths > LONG_WORD).tolist():
            out[i] = self._merge_long(words[i])
        for i in np.flatnonzero(lengths == 0).tolist():
            out[i] = ()
        return out  # type: ignore[return-value]

    def _merge_block(self, words, of, lengths, width, out) -> None:
        n = len(of)
        chars = np.frombuffer(b"".join([words[i].ljust(width, b"\0") for i in of.tolist()]), np.uint8)
        parts = self.byte_id[chars].reshape(n, width)
        count = lengths[of].copy()
        cols = np.arange(width)
        ranks = np.full((n, width), self.none, self.kind)
        ranks[:, :-1] = self.ranks(parts[:, :-1], parts[:, 1:])
        ranks[cols[None, :] >= (count - 1)[:, None]] = self.none
        ids, row = of, np.arange(n)
        while True:
            at = ranks.argmin(axis=1)
            best = ranks[row[: len(at)], at]
            live = best != self.none
            if not live.all():
                for i, p, c in zip(ids[~live].tolist(), parts[~live].tolist(), count[~live].tolist(), strict=True):
                    out[i] = tuple(p[:c])
                if not live.any():
                    return
                parts, ranks, count, ids, at, best = (x[live] for x in (parts, ranks, count, ids, at, best))
            r = row[: len(at)]
            # delete the boundary behind `at`: later parts and ranks move one place to the left
            later = cols[None, :-1] > at[:, None]
            parts[:, :-1] = np.where(later, parts[:, 1:], parts[:, :-1])
            ranks[:, :-1] = np.where(later, ranks[:, 1:], ranks[:, :-1])
            ranks[:, -1] = self.none
            parts[r, at] = self.merged[best]
            count -= 1
            has_left, has_right = at > 0, at < count - 1
            left, right = np.maximum(at - 1, 0), np.minimum(at + 1, width - 1)
            mine = parts[r, at]
            ranks[r, at] = np.where(has_right, self.ranks(mine, parts[r, right]), self.kind(self.none))
            fresh = self.ranks(parts[r, left], mine)
            ranks[r[has_left], left[has_left]] = fresh[has_left]

    def _merge_long(self, word: bytes) -> tuple[int, ...]:
        part = self.byte_id[np.frombuffer(word, np.uint8)]
        n = len(part)
        ranks = self.ranks(part[:-1], part[1:])
        heap = [(r, i) for i, r in enumerate(ranks.tolist()) if r != self.none]
        heapq.heapify(heap)
        parts = part.tolist()
        nxt, prv, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        known = dict(zip(self.keys.tolist(), self.rank_at.tolist(), strict=True)) if n > 2000 else None

        def rank(a: int, b: int) -> int:
            key = a * self.size + b
            if known is not None:
                return known.get(key, self.none)
            at = int(np.searchsorted(self.keys, key))
            return int(self.rank_at[at]) if at < len(self.keys) and self.keys[at] == key else self.none

        while heap:
            r, i = heapq.heappop(heap)
            j = nxt[i]
            if not alive[i] or j >= n or rank(parts[i], parts[j]) != r:
                continue
            parts[i] = int(self.merged[r])
            alive[j] = False
            nxt[i] = nxt[j]
            if nxt[j] < n:
                prv[nxt[j]] = i
                if (x := rank(parts[i], parts[nxt[i]])) != self.none:
                    heapq.heappush(heap, (x, i))
            if prv[i] >= 0 and (x := rank(parts[prv[i]], parts[i])) != self.none:
                heapq.heappush(heap, (x, prv[i]))
        return tuple(p for p, a in zip(parts, alive, strict=True) if a)

    # -- texts ------------------------------------------------------------------------------------
    def encode(self, texts: list[str]) -> list[list[int]]:
        """Ids of each text; a special token's string inside a text is that token."""
        out: list[list[int]] = [[] for _ in texts]
        collecting = gc.isenabled()
        gc.disable()  # millions of words and tuples, none in a cycle
        try:
            self._encode_all(texts, out)
        finally:
            if collecting:
                gc.enable()
        return out

    def _encode_all(self, texts: list[str], out: list[list[int]]) -> None:
        group: list[int] = []
        size = 0
        for i, t in enumerate(texts):
            if any(s in t for s in self.special):
                out[i] = self._with_special(t)
            elif t:
                group.append(i)
                size += len(t)
                if size > 500_000:
                    self._encode_group(texts, group, out)
                    group, size = [], 0
        if group:
            self._encode_group(texts, group, out)

    def _with_special(self, text: str) -> list[int]:
        for s, i in self.special.items():
            if s in text:
                pieces = self.encode(text.split(s))
                return list(chain.from_iterable([*p, i] for p in pieces))[:-1]
        return []

    def _encode_group(self, texts: list[str], group: list[int], out: list[list[int]]) -> None:
        joined = "".join([texts[i] for i in group])
        cp = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        ends = np.cumsum([len(texts[i]) for i in group])
        first = np.zeros(len(cp), bool)
        first[0] = True
        first[ends[:-1]] = True
        at = np.flatnonzero(self.starts(cp, first))
        cuts = at.tolist()
        words = [joined[s:e] for s, e in zip(cuts, [*cuts[1:], len(joined)], strict=True)]
        cache = self.cache
        coded = list(map(cache.get, words))
        missing = [k for k, c in enumerate(coded) if c is None]
        if missing:
            new = list({words[k] for k in missing})
            fresh = dict(zip(new, self.merge_words([w.encode("utf-8", "replace") for w in new]), strict=True))
            if len(cache) < CACHE_WORDS:
                cache.update(fresh)
            for k in missing:
                coded[k] = fresh[words[k]]
        bounds = [0, *np.searchsorted(at, ends).tolist()]
        for i, s, e in zip(group, bounds[:-1], bounds[1:], strict=True):
            out[i] = list(chain.from_iterable(coded[s:e]))

    def decode(self, ids: list[int]) -> str:
        of = self.bytes_of
        return b"".join([of[i] for i in ids]).decode("utf-8", "replace")


_LOADED: dict[int, Vocabulary] = {}


def loaded(source: str) -> Vocabulary:
    """One Vocabulary per worker process."""
    key = hash(source)
    if key not in _LOADED:
        _LOADED.clear()
        _LOADED[key] = Vocabulary(source)
    return _LOADED[key]


def share(spark, path: str):
    """The vocabulary file as a broadcast: executors need not have it."""
    with open(path, encoding="utf-8") as f:
        return spark.sparkContext.broadcast(f.read())


def encode(df: DataFrame, path: str, text_col: str = "text", decoded_col: str | None = None) -> DataFrame:
    """Adds ``ids`` array<int> (null text: empty array), and the ids decoded again if decoded_col names a column.

    Rows keep their other columns; an input column named like an output is replaced. An empty table gives an
    empty table. Repeated rows are encoded each. Texts of any length are encoded whole.
    """
    spark = df.sparkSession
    prepare(spark)
    source = share(spark, path)
    at = position(df, text_col)
    fields = [T.StructField("ids", T.ArrayType(T.IntegerType(), False), False)]
    if decoded_col:
        fields.append(T.StructField(decoded_col, T.StringType(), False))

    def run(batch: pa.RecordBatch) -> list[pa.Array]:
        vocab = loaded(source.value)
        ids = vocab.encode([t or "" for t in batch.column(at).to_pylist()])
        offsets = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
        flat = np.fromiter(chain.from_iterable(ids), np.int32, int(offsets[-1]))
        item = pa.field("element", pa.int32(), False)
        out = [pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat), type=pa.list_(item))]
        if decoded_col:
            out.append(pa.array([vocab.decode(x) for x in ids], pa.string()))
        return out

    return add_columns(df, fields, run)


def decode(df: DataFrame, path: str, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """Adds the text of an ids column; null ids give an empty text, bytes that are not UTF-8 give U+FFFD."""
    spark = df.sparkSession
    prepare(spark)
    source = share(spark, path)
    at = position(df, ids_col)

    def run(batch: pa.RecordBatch) -> list[pa.Array]:
        vocab = loaded(source.value)
        return [pa.array([vocab.decode(x or []) for x in batch.column(at).to_pylist()], pa.string())]

    return add_columns(df, [T.StructField(out_col, T.StringType(), False)], run)
