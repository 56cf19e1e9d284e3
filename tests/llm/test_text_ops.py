"""BPE, packing, media, fingerprints and licences against brute force, round trips and edge cases."""

import base64
import hashlib
import math
import struct
import zlib
from collections import Counter
from itertools import combinations

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from nearframe.llm import bpe, fingerprint, licenses, media, packing, queries
from nearframe.llm.vectext import BASE, BYTE_CODE, prefix_hash, shingle_sets, slice_hash, window_argmin

PATH = public_tokenizers.path("byte_bpe_50k.json")
TOK = Tokenizer.from_file(PATH)
DOCS = "doc_id long, text string"
ODD = [None, "", " ", "a\n\n b", "it's we'll 'S x'", "x<|endoftext|>y", "漢字 123abc!? é", "ab" * 900 + " ", "\t\r\n", "same", "same", "z" * 70, "👩‍👩‍👧 ²①"]


@pytest.fixture(scope="module")
def vocab():
    with open(PATH, encoding="utf-8") as f:
        return bpe.Vocabulary(f.read())


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(list(enumerate(ODD)), DOCS)


@pytest.fixture(scope="module")
def real(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")


def ids_of(text):
    return TOK.encode(text or "", add_special_tokens=False).ids


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from(" '\n\tstrevml1²é<|>."), st.characters(codec="utf-8")), max_size=60))
def test_encoder_is_the_librarys(vocab, text):
    got = vocab.encode([text])[0]
    assert got == ids_of(text)
    assert vocab.decode(got) == TOK.decode(got, skip_special_tokens=False)


def test_long_words_and_cache_bound(vocab, monkeypatch):
    monkeypatch.setattr(bpe, "CACHE_WORDS", 3)
    texts = ["q" * 3000, "abc" * 400 + "é" * 200, "one two three four five six one two", "x " * 500]
    assert vocab.encode(texts) == [ids_of(t) for t in texts]


def test_bpe_table(spark, odd):
    out = bpe.encode(odd.withColumnRenamed("doc_id", "IDS").selectExpr("IDS as doc_id", "text", "1 as ids", "2 as Decoded"), PATH, decoded_col="decoded")
    assert out.columns == ["doc_id", "text", "ids", "decoded"]
    for r in out.collect():
        assert r["ids"] == ids_of(r["text"]) and r["decoded"] == (r["text"] or "")
    assert bpe.encode(odd.where("doc_id < 0"), PATH).count() == 0
    assert [r["decoded"] for r in bpe.decode(spark.createDataFrame([(None,), ([464],), ([447],)], "ids array<int>"), PATH).collect()] == ["", "The", "�"]


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 30), min_size=1, max_size=20))
def test_plan_places_every_piece_once(counts):
    seq, seen = {}, {}
    for size, first, last, sequence, offset, per in packing.plan(counts, 64):
        for n in range(first, last):
            seen[size, n] = seen.get((size, n), 0) + 1
            k = n - first
            seq.setdefault(sequence + k // per, []).append((offset + k % per * size, size))
    assert seen == {(s, n): 1 for s, c in counts.items() for n in range(c)}
    for parts in seq.values():
        end = 0
        for at, size in sorted(parts):
            assert at == end
            end += size
        assert end <= 64
    total = sum(s * c for s, c in counts.items())
    assert len(seq) <= 2 * -(-total // 64) + 1  # no two sequences would fit in one


def test_complements():
    left = np.zeros(101, np.int64)
    left[[10, 20, 30]] = 1
    sums = packing.Sums(left)
    assert sums.find(30, left) == [30]
    assert sums.find(50, left) == [30, 20]
    assert sorted(sums.find(60, left)) == [10, 20, 30]
    assert sums.find(20, left) == [20]
    left[20] = 0
    assert sums.find(20, left) is None  # 10 is there once only
    left[10] = 2
    assert sums.find(20, left) == [10, 10]


@settings(max_examples=80, deadline=None)
@given(st.dictionaries(st.integers(1, 40), st.integers(1, 4), min_size=1, max_size=12), st.integers(1, 40), st.sets(st.integers(1, 40)))
def test_index_of_sums_is_complete(counts, gap, gone):
    """A combination is found iff trying all of them finds one, also when lengths have run out since."""
    left = np.zeros(41, np.int64)
    for size, n in counts.items():
        left[size] = n
    sums = packing.Sums(left)
    for size in gone:
        left[size] = 0
    sums.drop(left)
    each = [s for s, n in counts.items() for _ in range(n) if s not in gone]
    exists = any(sum(c) == gap for k in (1, 2, 3) for c in combinations(each, k))
    found = sums.find(gap, left)
    assert (found is not None) == exists
    if found:
        assert sum(found) == gap and len(found) <= 3 and all(found.count(x) <= left[x] for x in found)


def test_packing_table(spark, odd, real):
    for df in (odd, real):
        want = {}
        for doc, text in df.collect():
            ids = [*ids_of(text), 2]
            head = len(ids) % 1024 or 1024
            cuts = [0, *range(head, len(ids) + 1, 1024)]
            for k, (s, e) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
                want[doc, k] = (s, e - s, zlib.crc32(struct.pack(f"<{e - s}I", *ids[s:e])))
        rows = packing.pack(df.selectExpr("*", "1 as length", "'x' as part"), PATH).collect()
        assert {(r["doc_id"], r["piece"]): (r["start"], r["length"], r["ids_crc32"]) for r in rows} == want
        seq = {}
        for r in rows:
            seq.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        for parts in seq.values():
            assert [a for a, _ in sorted(parts)] == [0, *np.cumsum([n for _, n in sorted(parts)])[:-1]] and sum(n for _, n in parts) <= 1024
        total = sum(r["length"] for r in rows)
        assert len(seq) <= -(-total // 1024) * 1.02 + 1
    assert packing.pack(odd.where("doc_id < 0"), PATH).count() == 0
    twice = packing.pack(odd.union(odd), PATH)
    assert twice.count() == 2 * len(ODD)


def test_packing_plan_takes_no_python_workers(spark, odd):
    # a table made from a list is an RDD: its workers stay beside those of the operators, in a daemon of their own
    plan = packing.pack(odd, PATH)._jdf.queryExecution().optimizedPlan().toString()
    assert "LocalRelation" in plan and "LogicalRDD" not in plan


def test_telephony_tables():
    assert media.MULAW[[0xFF, 0x7F, 0x00, 0x80]].tolist() == [0, 0, -32124, 32124]
    assert media.ALAW[[0xD5, 0x55, 0x2A, 0xAA]].tolist() == [8, -8, -32256, 32256]
    for codec in media.TAGS:
        assert media.unwave(media.wave(b"12345678" * 32, codec))[3] == b"12345678" * 32
    for bad in (b"", b"RIFF1234WAVE", media.wave(b"abcd")[:-2]):
        with pytest.raises(ValueError):
            media.unwave(bad)


def test_adpcm_blocks_and_resampling():
    x = (np.sin(np.arange(3000) / 20) * 9000).astype(np.int16)
    blob = media.wave(media.encode_ima(x), "ima", block=256)
    rate, y = media.decode(blob)
    assert rate == media.RATE and np.abs(y[: len(x)].astype(int) - x).mean() < 200
    blocks = np.frombuffer(media.unwave(blob)[3], np.uint8).reshape(-1, 256)
    assert np.array_equal(media.decode_ima(blocks), np.concatenate([media.decode_ima(b[None]) for b in blocks]))
    assert media.resample(np.array([0, 10], np.int16), 8000, 16000).tolist() == [0, 5, 10, 10]
    assert len(media.resample(x, 8000, 11025)) == len(x) * 11025 // 8000


def test_media_table(spark, odd):
    stored = media.store_text(odd.selectExpr("*", "3 as N_bytes", "4 as media"))
    back = media.read_back(stored).collect()
    for r in back:
        raw = (r["text"] or "").encode()
        payload = raw + b"\0" * (-len(raw) % 64 or (0 if raw else 64))
        assert (r["n_bytes"], r["payload_bytes"]) == (len(raw), len(payload)) and len(payload) % 64 == 0 and payload
        assert r["payload_sha256"] == hashlib.sha256(payload).hexdigest() and r["tail_crc32"] == zlib.crc32(payload[-64:])
        assert r["media_sha256"] == hashlib.sha256(bytes(r["media"])).hexdigest() and r["media_bytes"] == len(r["media"])
    same = {r["feature"] for r in back if r["text"] == "same"}
    assert len(same) == 1
    pcm = media.pcm(spark.createDataFrame([(media.wave(b"ab"),), (None,), (b"junk",)], "media binary")).collect()
    assert len(pcm[0]["pcm"]) == 8 and pcm[1]["pcm"] is None and pcm[2]["pcm"] is None
    assert media.read_back(spark.createDataFrame([(None,)], "media binary")).first()["feature"] is None
    assert media.store_text(odd.where("doc_id < 0")).count() == 0


def test_media_of_odd_blobs(spark):
    """No WAVE file, a cut one, block size 0, rate 0, a short format: null values by both readers, no error."""
    good = media.wave(bytes(range(64)), "ima", block=64)
    odd = [b"", b"junk", good[:50], good[:32] + b"\0\0" + good[34:], good[:24] + b"\0\0\0\0" + good[28:], b"RIFF\4\0\0\0WAVEfmt \2\0\0\0\1\0data\0\0\0\0", None, good]
    df = spark.createDataFrame([(k, b) for k, b in enumerate(odd)], "doc_id long, MEDIA binary")
    made = {r["doc_id"]: r["pcm"] for r in media.pcm(df, "media", 8000).collect()}
    back = {r["doc_id"]: r["feature"] for r in media.read_back(df).collect()}
    assert [k for k in made if made[k] is not None] == [k for k in back if back[k] is not None] == [len(odd) - 1]
    assert bytes(made[len(odd) - 1]) == media.decode_ima(np.frombuffer(bytes(range(64)), np.uint8).reshape(1, 64)).astype("<i2").tobytes()


def test_pcm_is_packed_without_loss_and_feature_recomputed(spark, odd):
    rng = np.random.default_rng(8)
    for n in (0, 1, 2, 3, 501):
        x = rng.integers(-32768, 32768, n).astype(np.int16)
        assert np.array_equal(media.unpack_pcm(media.pack_pcm(x)), x)
    for codec in ("mulaw", "alaw", "ima"):
        stored = media.store_text(odd, codec=codec)
        rows = media.read_back(media.pcm(stored, packed=True), pcm_col="pcm", packed=True).collect()
        assert sorted(r["feature"] for r in rows) == sorted(r["feature"] for r in media.read_back(stored).collect())
        for r in rows:  # plain loops over what the header says
            raw = (r["text"] or "").encode()
            raw += b"\0" * (-len(raw) % 64 or (0 if raw else 64))
            if codec == "ima":
                continue
            low = [int((media.MULAW if codec == "mulaw" else media.ALAW)[b]) for b in raw]
            up = [v for a, b in zip(low, [*low[1:], low[-1]], strict=True) for v in (a, (a + b) >> 1)]
            want = f"{codec};n={len(up)};ms={sum(v * v for v in up) // len(up)};peak={max(map(abs, up))};zc={sum((a < 0) != (b < 0) for a, b in zip(up, up[1:]))};"
            assert r["feature"].startswith(want)


def test_window_argmin_and_hashes():
    rng = np.random.default_rng(0)
    for n, w in ((1, 3), (3, 3), (50, 7), (200, 64), (64, 1)):
        key = rng.integers(0, 6, n).astype(np.uint64)
        want = [p + int(key[p : p + w].argmin()) for p in range(n - w + 1)]
        assert window_argmin(key, w).tolist() == want
    data = np.frombuffer(b"abcabcxabc", np.uint8)
    h = slice_hash(prefix_hash(data), np.array([0, 3, 7, 1]), np.array([3, 6, 10, 4]))
    assert h[0] == h[1] == h[2] != h[3]
    a, b, c = shingle_sets([b"A b  c\td e", b"a B c d e", b"a b"], 4)
    assert np.array_equal(a, b) and len(a) == 2 and len(c) == 1
    assert [len(x) for x in shingle_sets([b"", b" \n", b"w"], 4)] == [0, 0, 1]


def test_entropies_are_exact():
    data = np.random.default_rng(1).integers(97, 105, 500).astype(np.uint8)
    got = fingerprint.entropies(data)
    for p in range(0, 437, 13):
        n = np.bincount(data[p : p + 64])
        n = n[n > 0] / 64
        assert abs(got[p] - -(n * np.log2(n)).sum() / 6 * 1000) <= 1


def test_fingerprints_do_not_depend_on_the_batch():
    rng = np.random.default_rng(2)
    raws = [b"", b"tiny", bytes(rng.integers(97, 123, 64).astype(np.uint8)), b"a" * 500, *(bytes(rng.integers(97, 123, n).astype(np.uint8)) for n in (65, 130, 3000, 40_000))]
    together = fingerprint.filters(raws)
    for r, f in zip(raws, together, strict=True):
        assert np.array_equal(f, fingerprint.filters([r])[0])
        assert np.array_equal(fingerprint.load(fingerprint.dump(f)), f)
    assert len(together[0]) == 0 and len(together[-1]) > 1
    assert fingerprint.likeness(together[0], together[0]) == 1 and fingerprint.likeness(together[0], together[1]) == 0
    part = fingerprint.filters([raws[-1][:30_000] + raws[-2]])[0]
    assert fingerprint.likeness(part, together[-1]) > 0.6 > 0.3 > fingerprint.likeness(together[-2], together[-1])


def test_compared_with_next(spark, real, odd):
    for df in (real, odd, odd.where("doc_id = 3"), odd.where("doc_id < 0")):
        docs = sorted(map(tuple, df.collect()))
        rows = sorted(fingerprint.compare_with_next(df.selectExpr("*", "1 as bucket", "2 as follows")).collect())
        assert len(rows) == len(docs)
        for k, (r, (doc, text)) in enumerate(zip(rows, docs, strict=True)):
            t, u = text or "", docs[(k + 1) % len(docs)][1] or ""
            edited = t[: len(t) - len(t) // 4] + u[: len(t) // 4]
            a, b, c = (fingerprint.filters([x.encode()])[0] for x in (t, edited, u))
            want = (doc, len(t), hashlib.sha256(edited.encode()).hexdigest(), fingerprint.dump(a), fingerprint.dump(b), fingerprint.likeness(a, b), fingerprint.likeness(a, c))
            assert tuple(r) == want
    assert base64.b64decode(rows[0]["fingerprint"].split(":")[1]) is not None if rows else True


def plain_chain(raw):
    """The fingerprint of one text by loops: a list of sets of bits."""
    def code(x):
        h = (sum(int(BYTE_CODE[b]) * pow(BASE, k, 1 << 64) for k, b in enumerate(x)) + len(x) * 0xD6E8FEB86659FD93) % 2**64
        h = (h ^ h >> 30) * 0xBF58476D1CE4E5B9 % 2**64
        h = (h ^ h >> 27) * 0x94D049BB133111EB % 2**64
        return h ^ h >> 31

    part = [0] + [round(-(c / 64) * math.log2(c / 64) / 6 * 1000 * 2**20) for c in range(1, 65)]
    rank = []
    for p in range(len(raw) - 63):
        h = min(sum(part[c] for c in Counter(raw[p : p + 64]).values()) >> 20, 1000)
        rank.append(1000 - abs(h - 690) if 100 <= h <= 990 else 65535)
    points = Counter()
    for p in range(len(rank) - 63):
        run = rank[p : p + 64]
        points[p + run.index(min(run))] += 1
    found = [raw[p : p + 64] for p in sorted(points) if points[p] >= 16 and rank[p] < 65535]
    if not found and raw:
        p = rank.index(min(rank)) if rank else 0
        found = [raw[p : p + 64]]
    chain = [set() for _ in range(-(-len(found) // 160))]
    for k, x in enumerate(found):
        chain[k // 160] |= {code(x) >> 11 * j & 2047 for j in range(5)}
    return chain


def plain_likeness(a, b):
    if not a or not b or a == b:
        return float(a == b)

    def overlap(x, y):
        chance = len(x) * len(y) / 2048
        return min(max((len(x & y) - chance) / max(min(len(x), len(y)) - chance, 1e-9), 0), 1)

    ways = [sum(max(overlap(x, y) for y in q) for x in p) / len(p) for p, q in ((a, b), (b, a))]
    return sum(ways) / 2 if len(a) == len(b) else ways[len(a) > len(b)]


def bits_of(chain):
    return [set(np.flatnonzero(np.unpackbits(f)).tolist()) for f in chain]


def test_fingerprints_equal_plain_version(spark, sf):
    """Odd texts, and the whole query over the documents of the smallest table."""
    rng = np.random.default_rng(4)
    raws = [x.encode() for x in ODD if x is not None] + [b"a" * 300, bytes(rng.integers(97, 123, 127).astype(np.uint8)), bytes(rng.integers(0, 256, 900).astype(np.uint8)), b"ab" * 31, b"abcdefgh" * 8, bytes(rng.integers(97, 105, 15_000).astype(np.uint8))]
    for raw, got in zip(raws, fingerprint.filters(raws), strict=True):
        assert bits_of(got) == plain_chain(raw)
    assert any(len(plain_chain(r)) > 1 for r in raws)

    docs = [(r["doc_id"], r["text"] or "") for r in spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").collect()]
    got = {r["doc_id"]: r for r in queries.op7_fingerprints(spark, sf).collect()}
    assert len(got) == len(docs)
    chains = [plain_chain(t.encode()) for _, t in docs]
    for k, (doc, t) in enumerate(docs):
        u, cut = docs[(k + 1) % len(docs)][1], len(t) // 4
        edited = t[: len(t) - cut] + u[:cut]
        other = plain_chain(edited.encode())
        r = got[doc]
        assert (r["n_chars"], r["edited_sha256"]) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert bits_of(fingerprint.load(r["fingerprint"])) == chains[k] and bits_of(fingerprint.load(r["edited_fingerprint"])) == other
        assert r["near_edited"] == pytest.approx(plain_likeness(chains[k], other)) and r["near_next"] == pytest.approx(plain_likeness(chains[k], chains[(k + 1) % len(docs)]))


def by_hash(df):
    """(id, text) in order: null ids first, rows of one id by a hash of the text."""
    return [(r["doc_id"], r["text"] or "") for r in df.withColumn("h", F.xxhash64(F.coalesce("text", F.lit("")))).orderBy(F.asc_nulls_first("doc_id"), "h").collect()]


@pytest.mark.parametrize("many", [1, 400])
def test_next_with_null_and_repeated_ids(spark, many):
    """Also ids and rows that make up most of the table, and ids at the ends of their range."""
    rows = [(None, "n"), (5, "b" * 8), (5, "a" * 8), (9, "c" * 8), (2**63 - 1, "z" * 9), (-(2**63), "y" * 9)]
    rows += [(7, f"t{k} {'x' * k}") for k in range(many)] + [(8, "same text")] * many + [(None, f"null {k}") for k in range(many)]
    df = spark.createDataFrame(rows, DOCS)
    docs = by_hash(df)
    want = sorted((str(i), hashlib.sha256((t[: len(t) - len(t) // 4] + docs[(k + 1) % len(docs)][1][: len(t) // 4]).encode()).hexdigest()) for k, (i, t) in enumerate(docs))
    assert sorted((str(r["doc_id"]), r["edited_sha256"]) for r in fingerprint.compare_with_next(df).collect()) == want


def test_licences(spark):
    texts = ["words\nReleased under the MIT License.\nmore", "This work is LICENSED under the GNU general public license - version 3!", "Licensed under the Apache License, Version 2.0.", "nothing here", None, "", "MIT",
             "\n\n".join(["x y z", licenses.TEMPLATES["ISC"][0].replace("software", "software\n")])]
    df = spark.createDataFrame(list(enumerate(texts)), DOCS).selectExpr("*", "1 as License")
    got = {r["doc_id"]: (r["license"], r["n_matches"]) for r in licenses.scan(df).collect()}
    assert got == {0: ("MIT", 1), 1: ("GPL-3.0", 1), 2: ("Apache-2.0", 1), 3: (None, 0), 4: (None, 0), 5: (None, 0), 6: (None, 0), 7: ("ISC", 3)}
    assert licenses.scan(df.where("doc_id < 0")).count() == 0
    assert licenses.scan(df, templates={"short": ["one"]}).agg({"n_matches": "sum"}).first()[0] == 0


@pytest.mark.parametrize("name", sorted({**licenses.TEMPLATES, **licenses.NOTICES}))
def test_notices_keep_their_terms(name):
    """Each notice is found as itself, alone and within prose, not as a licence of other terms."""
    ix = licenses.standard()
    for text in licenses.TEMPLATES.get(name, []) + licenses.NOTICES.get(name, []):
        assert licenses.match(text, ix)[0] == name
        assert licenses.match(f"Some words of prose come first. {text} And more prose goes on after it.", ix)[0] == name


def test_whole_and_embedded_licences(spark):
    texts = licenses.all_templates()
    bsd, mit = texts["BSD-3-Clause"][-1], texts["MIT"][-1]
    words = " ".join(f"w{i}" for i in range(400))
    cases = {"BSD-3-Clause": "Copyright (c) 2020 A. All rights reserved.\n\nAll rights reserved.\n" + bsd, "MIT": words + "\n" + "\n".join("# " + x for x in mit.split("\n")) + "\n" + words,
             "GPL-2.0": texts["GPL-2.0"][-1] + words, "Apache-2.0": words + " " + texts["Apache-2.0"][-1], "LGPL-2.1": texts["LGPL-2.1"][0], "BSD-2-Clause": texts["BSD-2-Clause"][-1]}
    df = spark.createDataFrame([*enumerate(cases.values()), (90, f"{words} Released under the MIT License. {words}"), (91, words), (92, texts["GPL-2.0"][0])], DOCS)
    got = {r["doc_id"]: r["license"] for r in licenses.scan(df).collect()}
    assert got == dict(enumerate(cases)) | {90: "MIT", 91: None, 92: "GPL-2.0"}


@pytest.mark.parametrize("name", ["AGPL-3.0", "GPL-3.0", "GPL-2.0", "LGPL-2.1", "LGPL-2.0"])
def test_close_licences_are_told_apart(name):
    """Whole texts, also as comments, without what follows the terms or without what precedes them."""
    ix, text = licenses.standard(), licenses.all_templates()[name][-1]
    terms = text[: text.index("END OF TERMS")]
    for x in (text, "\n".join("# " + line for line in text.split("\n")), terms, terms[len(terms) // 5 :], f"Some prose. {text} And more."):
        assert licenses.match(x, ix)[0] == name


def test_windows_equal_all_windows():
    rng = np.random.default_rng(5)
    template = " ".join(f"t{i}" for i in rng.integers(0, 9, 12))
    for _ in range(60):
        text = " ".join(f"t{i}" for i in rng.integers(0, 12, 9)) + " " + " ".join(w for w in template.split() if rng.random() < 0.95) + " " + " ".join(f"t{i}" for i in rng.integers(0, 12, 9))
        w, g = text.split(), set(licenses.bigrams(template))
        dice = [2 * len(b & g) / (len(b) + len(g)) for lo in range(len(w) - 11) for b in [set(licenses.bigrams(" ".join(w[lo : lo + 12])))]]
        assert (licenses.match(text, licenses.index({"x": [template]}))[0] is not None) == (max(dice) >= licenses.THRESHOLD)


def test_media_and_pcm_are_stored_as_a_table(spark, sf):
    import glob

    base = f"{spark.sparkContext.getConf().get('spark.checkpoint.dir')}/nearframe-media-*"
    before = set(glob.glob(base))
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    got = {r["doc_id"]: r.asDict() for r in queries.op6_media(spark, sf).collect()}
    (made,) = set(glob.glob(base)) - before
    kept = {r["doc_id"]: r for r in spark.read.parquet(f"{made}/001-media").collect()}
    assert set(kept) == set(got) == {r["doc_id"] for r in docs.collect()}
    assert all(hashlib.sha256(bytes(k["media"])).hexdigest() == got[i]["media_sha256"] and f"n={len(k['pcm']) // 2};" in got[i]["feature"] for i, k in kept.items())
    direct = media.read_back(media.store_text(docs).drop("text")).drop("media")
    assert {r["doc_id"]: r.asDict() for r in direct.collect()} == got
