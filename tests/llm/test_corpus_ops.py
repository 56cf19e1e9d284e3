"""Near-duplicates, repeats, line runs, chat and language ID against brute force and edge cases."""

import collections
import hashlib
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from nearframe.llm import chat, langid, linededup, minhash, suffix
from nearframe.llm.common import Scratch
from nearframe.llm.components import components

DOCS = "doc_id long, text string"


def words(rng, n, k=400):
    return [f"w{rng.randrange(k)}" for _ in range(n)]


def brute_near(rows, width, num, den):
    sets = {}
    for doc, text in rows:
        w = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets[doc] = {tuple(w)} if 0 < len(w) < width else {tuple(w[i : i + width]) for i in range(len(w) - width + 1)}
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            both = len(sets[a] & sets[b])
            if both and den * both >= num * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), find(d), find(d) == d) for d in ids}


def near_corpus(seed):
    """Copies, a chain of gradual edits, a group of near copies, pairs just above and below the threshold."""
    rng = random.Random(seed)
    texts = [None, "", " \n", "one", "ONE", "one two", "one two three"]
    base = words(rng, 120)
    texts += [" ".join(base), " ".join(base).upper()]
    chain = list(base)
    for k in range(25):
        chain = list(chain)
        chain[(k * 17) % 120] = f"c{k}"
        texts.append(" ".join(chain))
    group = words(rng, 200)
    for k in range(60):
        g = list(group)
        for _ in range(k % 4):
            g[rng.randrange(200)] = f"g{k}"
        texts.append("\t".join(g))
    for cut in range(1, 40, 2):
        b = words(rng, 103, 10_000)
        texts += [" ".join(b), " ".join(b[:-cut] + [f"e{cut}{i}" for i in range(cut)])]
    rng.shuffle(texts)
    return list(enumerate(texts))


@pytest.mark.parametrize("seed,rounds,meet,block", [(1, 3, 32, 256), (2, 0, 1, 8), (3, 0, 1000, 256), (4, 1, 4, 4)])
def test_near_duplicates(spark, monkeypatch, seed, rounds, meet, block):
    monkeypatch.setattr(minhash, "ROUNDS", rounds)
    monkeypatch.setattr(minhash, "MEET", meet)
    monkeypatch.setattr(minhash, "BLOCK", block)
    rows = near_corpus(seed)
    df = spark.createDataFrame(rows, DOCS).selectExpr("*", "1 as rep", "2 as label")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in minhash.near_duplicates(df, words=4).collect()}
    assert got == brute_near(rows, 4, 80, 100)


def test_near_duplicates_edges(spark):
    df = spark.createDataFrame([(None, "a b c d e f"), (3, "a b c d e f"), (3, "p q r s t u"), (7, "p q r s t u"), (8, "x y")], DOCS)
    got = sorted((str(r["doc_id"]), r["component_id"], r["kept"]) for r in minhash.near_duplicates(df, words=5).collect())
    assert got == [("3", 3, True), ("3", 3, True), ("7", 3, False), ("8", 8, True), ("None", None, True)]
    assert minhash.near_duplicates(df.where("doc_id < 0")).count() == 0


def test_texts_that_a_polynomial_hash_confuses(spark):
    """Thue-Morse strings and their complements, as one word and as many."""
    tm = "0"
    for _ in range(11):
        tm += tm.translate(str.maketrans("01", "10"))
    both = [tm.translate(str.maketrans("01", x)) for x in ("ab", "ba")]
    rows = [(k, t) for k, t in enumerate([*both, *(" ".join(t) for t in both), *(" ".join(t[i : i + 64] for i in range(0, len(t), 64)) for t in both)])]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in minhash.near_duplicates(spark.createDataFrame(rows, DOCS), words=4).collect()}
    assert got == brute_near(rows, 4, 80, 100)
    assert got[1] == (1, 1, True)


def test_rows_stay_linear_where_nothing_links(spark, monkeypatch):
    """Members of one template, all alike and none linked: staged rows grow with members, not with pairs."""
    most = {}

    def counted(n):
        rng = random.Random(11)
        base = words(rng, 120, 5000)
        rows = [(k, " ".join(f"u{rng.randrange(5000)}" if rng.random() < 0.06 else w for w in base)) for k in range(n)]
        seen = []
        write = Scratch.write

        def spy(self, df, label="t", compression=None):
            out = write(self, df, label, compression)
            seen.append((out.count(), label))
            return out

        monkeypatch.setattr(Scratch, "write", spy)
        got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in minhash.near_duplicates(spark.createDataFrame(rows, DOCS), words=4).collect()}
        monkeypatch.setattr(Scratch, "write", write)
        return rows, got, max(seen)[0]

    for n in (150, 600):
        rows, got, most[n] = counted(n)
        if n == 150:
            assert got == brute_near(rows, 4, 80, 100)
    assert most[600] <= 5 * most[150]


def test_sketches_estimate_and_merge():
    rng = np.random.default_rng(3)
    x = rng.integers(0, 1 << 63, 3000, np.uint64)
    a, b = x[:2000], x[400:2600]
    ra, rb = minhash.sketch(a), minhash.sketch(b)
    assert np.array_equal(minhash.merge(ra, rb), minhash.sketch(np.union1d(a, b)))
    est = minhash.jaccard(ra[None], rb[None], np.array([2000.0]), np.array([2200.0]))[0]
    assert abs(est - 1600 / 2600) < 0.16
    assert minhash.could_link(ra[None], ra[None], np.array([2000]), np.array([2000]), 80, 100)[0]


def test_components(spark):
    rng = random.Random(5)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(110)] + [(i, i + 1) for i in range(300, 360)] + [(500, 500), (None, 3)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    got = components(spark.createDataFrame(edges, "u long, v long"), Scratch(spark, "t"))
    assert dict(map(tuple, got.collect())) == {n: find(n) for n in root}
    assert components(spark.createDataFrame([], "u long, v long"), Scratch(spark, "t")).count() == 0


def brute_repeats(rows, m):
    raws = [(t or "").encode() for _, t in rows]
    seen = {}
    for i, r in enumerate(raws):
        for p in range(len(r) - m + 1):
            seen.setdefault(r[p : p + m], []).append((i, p))
    gone = [bytearray(len(r)) for r in raws]
    for places in seen.values():
        if len(places) > 1:
            for i, p in places:
                gone[i][p : p + m] = b"\1" * m
    out = []
    for (doc, _), r, g in zip(rows, raws, gone, strict=True):
        spans = [(x.start(), x.end()) for x in re.finditer(b"\1+", bytes(g))]
        out.append((doc, len(r), sum(g), spans, bytes(c for c, d in zip(r, g, strict=True) if not d)))
    return out


def repeat_corpus(seed):
    rng = random.Random(seed)
    text = lambda n: "".join(rng.choice("abcdefgh é") for _ in range(n))
    shared, twin = text(260), text(500)
    texts = [None, "", "short", "a" * 1000, "ab" * 400, "ba" * 150, twin, twin, twin[:250] + "X" + twin[251:], text(200), text(199)]
    texts += [text(rng.randrange(150)) + shared[rng.randrange(30) : 260 - rng.randrange(30)] + text(rng.randrange(150)) for _ in range(25)]
    own = text(210)
    texts += [own + "|" + own, text(900) + shared]
    rng.shuffle(texts)
    return list(enumerate(texts))


@pytest.mark.parametrize("seed,group,chunk", [(1, 4096, 1 << 19), (2, 3, 256)])
def test_repeats(spark, monkeypatch, seed, group, chunk):
    monkeypatch.setattr(suffix, "GROUP", group)
    monkeypatch.setattr(suffix, "CHUNK", chunk)
    rows = repeat_corpus(seed)
    out = suffix.remove_repeats(spark.createDataFrame(rows, DOCS).selectExpr("*", "1 as spans", "2 as other", "3 as s"), min_len=200)
    got = sorted((r["doc_id"], r["n_bytes"], r["n_removed"], [tuple(x) for x in r["spans"]], bytes(r["kept"])) for r in out.collect())
    assert got == brute_repeats(rows, 200)
    assert out.where("other = 2 and s = 3").count() == len(rows)


def test_repeats_keep_columns_named_like_helpers(spark):
    df = spark.createDataFrame([(1, "x" * 300, 7, 8, 9)], "doc_id long, text string, k1 int, K2 int, row int")
    r = suffix.remove_repeats(df).first()
    assert (r["k1"], r["K2"], r["row"], r["n_removed"]) == (7, 8, 9, 300)
    r = linededup.dedup_lines(df).first()
    assert (r["k1"], r["K2"], r["row"], r["kept"]) == (7, 8, 9, "x" * 300)


def test_repeats_edges(spark):
    t = "".join(chr(97 + (i * i) % 23) for i in range(300))
    df = spark.createDataFrame([(1, t), (1, t), (1, t[::-1]), (None, "x"), (None, None)], DOCS)
    got = sorted((str(r["doc_id"]), r["n_removed"]) for r in suffix.remove_repeats(df).collect())
    assert [x for x in got if x[0] == "None"] == [("None", 0)] * 2 and got.count(("1", 300)) >= 2
    assert suffix.remove_repeats(df.where("doc_id < 0")).count() == 0
    text = suffix.remove_repeats(spark.createDataFrame([(1, "é" * 150), (2, "xé" + "é" * 149 + "y")], DOCS), as_text=True)
    assert {r["doc_id"]: r["kept"] for r in text.collect()} == {1: "", 2: "xy"}


def test_deep_shallow_sorts():
    rng = random.Random(4)
    for _ in range(150):
        n = rng.randrange(1, 30)
        stem = bytes(rng.choice(b"ab") for _ in range(rng.randrange(40)))
        s = [stem[: rng.randrange(len(stem) + 1)] + bytes(rng.choice(b"ab\0") for _ in range(rng.randrange(12))) for _ in range(n)]
        order, lcp = suffix.deep_shallow(s, shallow=rng.choice([0, 2, 16]))
        assert [s[i] for i in order] == sorted(s) and sorted(order) == list(range(n))
        assert lcp[1:] == [suffix.common(s[a], s[b]) for a, b in zip(order[:-1], order[1:], strict=True)]


def brute_lines(rows, m, c):
    first_run, first_line, plans = {}, {}, []
    for doc, text in sorted(rows, key=lambda r: r[0]):
        lines = (text or "").split("\n")
        used = [i for i, x in enumerate(lines) if x.strip(" \t\r")]
        seq = [lines[i] for i in used]
        gone = set()
        for p, x in enumerate(seq):
            if len(x) >= c and first_line.setdefault(x, (doc, p)) != (doc, p):
                gone.add(p)
            run = tuple(seq[p : p + m])
            if len(run) == m and first_run.setdefault(run, (doc, p)) != (doc, p):
                gone.update(range(p, p + m))
        drop = {used[p] for p in gone}
        plans.append((doc, len(seq), len(gone), "\n".join(x for i, x in enumerate(lines) if i not in drop)))
    return plans


@pytest.mark.parametrize("m", [1, 2, 3, 5])
def test_line_runs(spark, m):
    rng = random.Random(m)
    pool = [f"line {i}" * (1 + i % 9) for i in range(12)] + ["", " ", "\t"]
    rows = [(i, "\n".join(rng.choice(pool) for _ in range(rng.randrange(14)))) for i in range(60)] + [(60, None), (61, ""), (62, "\n\n")]
    df = spark.createDataFrame(rows, DOCS).selectExpr("*", "1 as seq", "2 as N_lines", "3 as kept")
    got = sorted((r["doc_id"], r["n_lines"], r["n_removed"], r["kept"]) for r in linededup.dedup_lines(df, min_lines=m, min_chars=40).collect())
    assert got == brute_lines(rows, m, 40)


def brute_runs(rows, m):
    """Maximal runs that an earlier place begins too, by comparing every two places."""
    seqs = [(d, [x for x in (t or "").split("\n") if x.strip(" \t\r")]) for d, t in sorted(rows, key=lambda r: r[0])]
    longest = {}
    for d, s in seqs:
        for p in range(len(s)):
            best = 0
            for e, t in seqs:
                for q in range(len(t)):
                    if (e, q) < (d, p):
                        k = 0
                        while p + k < len(s) and q + k < len(t) and s[p + k] == t[q + k]:
                            k += 1
                        best = max(best, k)
            longest[d, p] = best
    return sorted((d, p, k) for (d, p), k in longest.items() if k >= m and longest.get((d, p - 1)) != k + 1)


@pytest.mark.parametrize("m,size,pool", [(3, 30, 6), (2, 60, 3), (3, 25, 30)])
def test_maximal_line_runs(spark, m, size, pool):
    rng = random.Random(size)
    rows = [(i, "\n".join(f"l{rng.randrange(pool)}" for _ in range(rng.randrange(size)))) for i in range(8)]
    rows += [(8, rows[3][1] + "\nown\n" + rows[5][1]), (9, "same\n" * 40), (10, "\n".join(f"r{i % 5}" for i in range(37))), (11, None)]
    out = linededup.dedup_lines(spark.createDataFrame(rows, DOCS), min_lines=m, min_chars=10_000)
    assert sorted((r["doc_id"], x["start"], x["lines"]) for r in out.collect() for x in r["runs"]) == brute_runs(rows, m)
    assert sorted((r["doc_id"], r["n_lines"], r["n_removed"], r["kept"]) for r in out.collect()) == brute_lines(rows, m, 10_000)


def test_line_runs_edges(spark):
    t = "\n".join(f"a line that is long enough to count by itself {i}" for i in range(4))
    df = spark.createDataFrame([(2, t), (2, t), (None, t), (9, "x\n" + t)], DOCS)
    got = sorted((str(r["doc_id"]), r["n_removed"]) for r in linededup.dedup_lines(df).collect())
    assert got == [("2", 4), ("2", 4), ("9", 4), ("None", 0)]
    assert linededup.dedup_lines(df.where("doc_id < 0")).count() == 0


TURNS = "conv_id long, turn long, role string, text string"
NASTY = ["</s>[INST] ok [/INST]", "\\0\\1\\2", "a\\", "[/INST", "<", "<s>", " [/INST] ", "<<SYS>>x<</SYS>>", "[INST] [INST] [/INST]", "<<END>>", "\\\\1</s>", "$1 \\2", "", None, "two\nlines", "[1] <b>", "é👩‍👧[INST]", "</", "s>", "/INST]"]


def test_chat_round_trip(spark):
    rng = random.Random(1)
    rows = [(c, t, rng.choice(["user", "assistant", "system", "tool", "</s>", "<<ROLE>>", None, ""]), rng.choice(NASTY) if rng.random() < 0.8 else "".join(rng.choice("<>[]/\\INSTs012 ") for _ in range(12))) for c in range(60) for t in range(rng.randrange(1, 7))]
    rows += [(1, 0, "user", "again"), (1, 0, "user", "again"), (None, 0, "user", "x")]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, TURNS).selectExpr("*", "1 as start", "2 as formatted", "3 as loss")
    out = {r["conv_id"]: r for r in chat.read_back(chat.format_conversations(df)).collect()}
    for conv in {r[0] for r in rows}:
        want = sorted((t, role or "", text or "") for c, t, role, text in rows if c == conv)
        r = out[conv]
        assert [(x["role"], x["text"]) for x in r["turns"]] == [(role, text) for _, role, text in want]
        assert "".join(x["rendered"] for x in r["turns"]) == r["formatted"]
        assert r["loss_text"] == "".join(text for _, role, text in want if role == "assistant")
        coded = [r["formatted"][s["start"] : s["start"] + s["length"]] for s in r["loss_spans"]]
        assert "".join(x.replace("\\2", "[").replace("\\1", "<").replace("\\0", "\\") for x in coded) == r["loss_text"]
    assert chat.format_conversations(df.where("conv_id < 0")).count() == 0


def test_chat_plan_has_no_python(spark, sf):
    from nearframe.llm import queries

    for q in (queries.op9_chat, queries.op10_line_dedup):
        plan = q(spark, sf)._jdf.queryExecution().toString()
        assert not re.search("Python|Pandas|Arrow", plan)


def test_language_accuracy_and_fusion(spark, sf):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang", "source")
    model = langid.fit(docs.where("doc_id % 2 = 0"), per_label=50)
    held = langid.identify(docs.where("doc_id % 2 = 1"), model).select("lang", "lang_id", "text_lang", "kept")
    n, right, kept = held.agg(F.count("*"), F.sum((F.col("lang") == F.col("lang_id")).cast("int")), F.sum(F.col("kept").cast("int"))).first()
    assert right / n > 0.97 and kept / n > 0.99
    odd = spark.createDataFrame([(1, None, "fr", "a"), (2, "", "fr", "a"), (3, "12 34 !!", None, None), (4, "la", "fr-CA", "b.fr"), (5, "xqzj kwvx qqzx jjwq zxkq vvqj xkzw", "xx", "c")], "doc_id long, text string, declared string, Kept string")
    got = {r["doc_id"]: (r["lang_id"], r["kept"]) for r in langid.identify(odd, model, declared=F.col("declared")).collect()}
    assert got[1] == got[2] == got[3] == ("und", False) and got[5][1] is False
    assert langid.identify(odd.where("doc_id < 0"), model).count() == 0
    none = langid.fit(docs.where("doc_id < 0"))
    assert {r["lang_id"] for r in langid.identify(odd, none).collect()} == {"und"}


def plain_grams(text):
    """Trigrams of one text, one at a time."""
    low = [c + 32 if 65 <= c <= 90 else c for c in text.encode()]
    low = [32, *(c if 97 <= c <= 122 or c >= 128 else 32 for c in low), 32]
    out = []
    for a, b, c in zip(low, low[1:], low[2:]):
        if (a != 32) + (b != 32) + (c != 32) >= 2:
            out.append((((a << 16 | b << 8 | c) * 2654435761) % 2**32) >> 17)
    return out


def test_grams_do_not_depend_on_neighbours():
    texts = ["", "the cat", "x", "", "ab", "É à", "12", "", "Ab-Cd ef"]
    got, count = langid.grams([t.encode() for t in texts])
    assert count.tolist() == [len(plain_grams(t)) for t in texts] and count[0] == count[3] == 0
    assert got.tolist() == [g for t in texts for g in plain_grams(t)]


def plain_fusion(logp, rows):
    """{id: (language, posterior, kept, by text)} by loops; rows: id, text, declared label, host, suffix."""
    labels = [*sorted(logp), "und"]
    n = len(labels)

    def softmax(x):
        e = [math.exp(v - max(x)) for v in x]
        return [v / sum(e) for v in e]

    def sums(key):
        out = collections.defaultdict(lambda: [0.0] * n)
        for r, p, g in zip(rows, post, grams, strict=True):
            if g and key(r) is not None:
                out[key(r)] = [a + b for a, b in zip(out[key(r)], p, strict=True)]
        return out

    def smooth(c, base):
        return [(x + 20 * b) / (sum(c) + 20) for x, b in zip(c, base, strict=True)]

    def domain(r):
        return None if r[3] is None else ".".join(r[3].split(".")[-2:])

    grams = [plain_grams(r[1] or "") for r in rows]
    lik = [[*(0.3 * sum(logp[k][x] for x in g) for k in labels[:-1]), 0.3 * len(g) * -math.log(1 << 15)] for g in grams]
    post = [softmax(x) for x in lik]
    total = sums(lambda r: 0)[0]
    world = [(x + 1) / (sum(total) + n) for x in total]
    domains, hosts, declared, suffixes = sums(domain), sums(lambda r: r[3]), sums(lambda r: r[2]), sums(lambda r: r[4])
    out = {}
    for r, x, p, g in zip(rows, lik, post, grams, strict=True):
        prior = smooth(hosts[r[3]], smooth(domains[domain(r)], world)) if r[3] in hosts else world
        logs = [a + math.log(b) for a, b in zip(x, prior, strict=True)]
        for table, key in ((declared, r[2]), (suffixes, r[4])):
            if key in table:
                logs = [a + math.log((c + 0.5) / (m + 5)) for a, c, m in zip(logs, table[key], total, strict=True)]
        fused = softmax(logs)
        best = labels[fused.index(max(fused))] if g else "und"
        out[r[0]] = (best, max(fused), best != "und" and max(fused) >= 0.5, labels[p.index(max(p))] if g else "und")
    return out


def plain_model(docs):
    counts = collections.defaultdict(collections.Counter)
    for r in docs:
        if r["lang"] is not None and r["text"] is not None:
            counts[r["lang"]].update(plain_grams(r["text"]))
    return {k: [math.log((c[x] + 0.1) / (c.total() + 0.1 * (1 << 15))) for x in range(1 << 15)] for k, c in counts.items()}


def test_language_queries_equal_plain_fusion(spark, sf):
    """Both queries; the tables have fewer than 400 rows a language, so the sample is all of them."""
    from nearframe.llm import queries

    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    logp = plain_model(docs)
    label = {k: k for k in logp} | {None: None}
    pages = [r for r in langid.page_evidence(spark.read.parquet(f"{sf}/pages.parquet")).collect()]
    cases = {
        "doc_id": (queries.op2_language_id, [(r["doc_id"], r["text"], label.get(r["lang"], "other"), r["source"] and r["source"].lower(), None) for r in docs]),
        "page_id": (queries.op2_language_id_pages, [(r["page_id"], r["text"], label.get(r["declared"] and r["declared"].lower(), "other"), r["host"] and r["host"].lower(),
                    r["host"].lower().split(".")[-1] if r["host"] and "." in r["host"] else None) for r in pages]),
    }
    for key, (query, rows) in cases.items():
        want = plain_fusion(logp, rows)
        got = {r[key]: (r["lang_id"], r["posterior"], r["text_lang"]) for r in query(spark, sf).collect()}
        assert set(got) == set(want)
        for k, (lang, posterior, by_text) in got.items():
            assert posterior == pytest.approx(want[k][1], abs=1e-5) and (lang, by_text) == (want[k][0], want[k][3])


def test_fusion_of_odd_rows_in_one_batch_equals_plain(spark):
    train = spark.createDataFrame([(1, "the cat sat on the mat", "en"), (2, "le chat est sur la table", "fr"), (3, "der Hund und die Katze", "de")], "doc_id long, text string, lang string")
    rows = [(1, "", "fr", "a.b.c", "c"), (2, "the cat", None, "x.b.c", "c"), (3, None, "en", None, None), (4, "le", "other", "a.b.c", "c"), (5, "12 34", None, "b", None), (6, "die Katze", "de", None, "de"), (7, "", None, None, None)]
    df = spark.createDataFrame([(*r[:2], r[2] and r[2].replace("other", "zz-Q"), *r[3:]) for r in rows], "doc_id long, text string, d string, h string, s string").coalesce(1)
    got = {r["doc_id"]: r for r in langid.identify(df, langid.fit(train), declared=F.col("d"), host=F.col("h"), suffix=F.col("s")).collect()}
    for k, (lang, posterior, kept, by_text) in plain_fusion(plain_model(train.collect()), rows).items():
        r = got[k]
        assert (r["lang_id"], r["kept"], r["text_lang"]) == (lang, kept, by_text) and r["posterior"] == pytest.approx(posterior, abs=1e-5)
    assert got[1]["lang_id"] == got[3]["lang_id"] == got[7]["lang_id"] == "und"


def test_host_prior_and_declared_language_decide_short_text(spark):
    model = langid.Model(("aa", "bb"), np.full((2, langid.BUCKETS), -np.log(langid.BUCKETS) + 1, np.float32))
    lean = np.array(model.logp)
    g, _ = langid.grams([b"leaning towards bb always"])
    lean[1, g] += 3
    model = langid.Model(("aa", "bb"), lean)
    rows = [(i, "leaning towards bb always", "x.host.bb") for i in range(30)] + [(99, "unheard of text", "y.host.bb"), (100, "unheard of text", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, host string")
    got = {r["doc_id"]: r for r in langid.identify(df, model, host=F.col("host"), suffix=langid.suffix_of(F.col("host"))).collect()}
    assert got[99]["lang_id"] == "bb" and got[99]["posterior"] > got[100]["posterior"] - 1e-9


def test_pages(spark, sf):
    p = spark.createDataFrame([(1, "https://u@blog.x.fr:80/a", "<html lang=\"FR\"><script>no</script><p>le mot&nbsp;la</p></html>"), (2, None, None)], "page_id long, url string, html string")
    r = sorted(langid.page_evidence(p).collect())
    assert (r[0]["declared"], r[0]["host"], r[0]["text"].split()) == ("FR", "blog.x.fr", ["le", "mot", "la"])
    assert (r[1]["declared"], r[1]["host"], r[1]["text"]) == (None, None, "")


def test_pipeline_stages(spark, sf, tmp_path):
    """Each stage against its brute-force version, on its own input."""
    import corpus_pipeline as cp

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    seen = {}
    for k, (name, stage) in enumerate(cp.STAGES):
        before = {r["doc_id"]: r for r in docs.collect()}
        stage(spark, docs, sf).write.parquet(str(tmp_path / str(k)))
        after = spark.read.parquet(str(tmp_path / str(k)))
        rows = {r["doc_id"]: r["text"] for r in after.collect()} if name != "packing" else {}
        if name != "packing":
            assert after.columns == docs.columns and set(rows) <= set(before)
            assert all(r["n_chars"] == len(r["text"]) for r in after.collect())
        pairs = [(d, r["text"]) for d, r in sorted(before.items())]
        if name == "language_id":
            assert set(rows) == set(before)  # every document here is in a language
        elif name == "line_dedup":
            want = {d: kept for d, n, gone, kept in brute_lines(pairs, cp.LINES, cp.LINE_CHARS) if (gone < n or n == 0) and kept}
            assert rows == want
        elif name == "near_dedup":
            assert set(rows) == {d for d, (_, _, kept) in brute_near(pairs, cp.SHINGLE_WORDS, 80, 100).items() if kept}
        elif name == "suffix_dedup":
            want = {d: left.decode("utf-8", "ignore") for d, n, gone, _, left in brute_repeats(pairs, cp.REPEAT_BYTES) if gone < n}
            assert rows == {d: t for d, t in want.items() if t}
        else:
            assert {r["doc_id"] for r in after.collect()} == set(before)
        seen[name] = after.count()
        docs = after
    assert seen["packing"] >= seen["suffix_dedup"] > 0
    assert hashlib.sha256(b"").hexdigest()


def test_languages_beyond_the_bound_are_other(spark, monkeypatch):
    monkeypatch.setattr(langid, "MAX_LABELS", 2)
    texts = {"aa": "alpha bravo", "bb": "kilo lima", "cc": "xyz uvw", "dd": "uvw xyz xyz"}
    data = [(10 * n + k, " ".join([t] * 9), lang) for n, (lang, t) in enumerate(texts.items()) for k in range(3 if lang < "cc" else 1)]
    df = spark.createDataFrame(data, "doc_id long, text string, lang string")
    model = langid.fit(df)
    assert model.labels == ("aa", "bb", "other")
    got = {r["doc_id"]: r["lang_id"] for r in langid.identify(df, model, declared=F.col("lang")).collect()}
    assert got == {i: lang if lang < "cc" else "other" for i, _, lang in data}


def test_pipeline_keeps_unique_rows_of_repeated_ids(spark, sf):
    import corpus_pipeline as cp

    a, b, c = (" ".join(f"{x}{i}" for i in range(40)) for x in "abc")
    near = a.replace("a39", "other")
    rows = [(3, a), (7, near), (7, b), (8, c), (8, c), (None, b), (None, "only here " * 9)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = sorted((str(r["doc_id"]), r["text"]) for r in cp.near_dedup(spark, docs, sf).collect())
    assert [t for _, t in got].count(a) == [t for _, t in got].count(b) == [t for _, t in got].count(c) == 1
    assert len(got) == 4 and ("None", "only here " * 9) in got and cp.near_dedup(spark, docs.where("doc_id < 0"), sf).count() == 0


def test_columns_named_like_helpers_and_other_case(spark):
    from nearframe.llm import licenses

    df = spark.createDataFrame([(1, "Released under the MIT License.", "en", 5, 6)], "doc_id long, TEXT string, lang string, _ int, __text int")
    r = licenses.scan(df, "text").first()
    assert (r["license"], r["_"], r["__text"]) == ("MIT", 5, 6)
    r = langid.identify(df, langid.fit(df), "text", declared=F.col("lang")).first()
    assert (r["_"], r["__text"], r["lang_id"]) == (5, 6, "en")
