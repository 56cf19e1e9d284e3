"""Edge cases and properties of the vector and graph operators."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from nearframe.functions import distance as d
from nearframe.operators import exact, graph_analytics, graph_build, graph_search
from nearframe.operators import quantize as qz
from nearframe.sources import tables, vecs

V = "id long, v array<double>"


def rows(spark, values):
    return spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(values)], V)


def asked(df):
    return df.select(F.col("id").alias("q"), "v")


def test_metrics_differ_and_zero_vector(spark):
    r = spark.createDataFrame([([1.0, 0.0], [2.0, 1.0]), ([0.0, 0.0], [1.0, 1.0])], "a array<double>, b array<double>")
    out = r.select(*[d.distance(m, F.col("a"), F.col("b")).alias(m) for m in d.METRICS]).collect()
    assert [round(x, 6) for x in out[0]] == [1.414214, -2.0, round(1 - 2 / 5**0.5, 6)]
    assert out[1]["cos"] == 2.0 and out[1]["ip"] == 0.0
    with pytest.raises(ValueError):
        d.distance("manhattan", F.col("a"), F.col("b"))


@pytest.mark.parametrize("limit", [1 << 20, -1])
def test_knn_ties_small_base_and_empty(spark, limit):
    base = rows(spark, [[0, 0], [1, 0], [0, 1], [1, 0], [5, 5]])
    got = exact.knn(asked(base.where("id = 0")), base, 3, exclude_self=True, broadcast_bytes=limit).orderBy("rank").collect()
    assert [r["id"] for r in got] == [1, 2, 3]
    assert exact.knn(asked(base.where("id = 0")), base, 99, broadcast_bytes=limit).count() == 5
    assert exact.knn(asked(base.where("id < 0")), base, 3, broadcast_bytes=limit).count() == 0
    assert exact.knn(asked(base), base.where("id < 0"), 3, broadcast_bytes=limit).count() == 0


def test_nulls_take_no_part(spark):
    base = spark.createDataFrame([(0, [0.0]), (1, None), (None, [1.0]), (2, [2.0])], V)
    assert sorted(r["id"] for r in exact.knn(asked(base.where("id = 0")), base, 9).collect()) == [0, 2]


def test_probing_every_cell_is_exact(spark):
    rng = np.random.default_rng(1)
    base = rows(spark, rng.normal(size=(120, 5)).tolist())
    q = asked(base.where("id % 10 = 0"))
    index = qz.IvfIndex(7).train(base).add(base)
    same = lambda df: sorted((r["q"], r["rank"], r["id"]) for r in df.collect())
    assert same(index.search(q, 6, 7)) == same(exact.knn(q, base, 6))
    assert {r["recall"] for r in exact.recall(exact.knn(q, base, 6), exact.knn(q, base, 6), 6).collect()} == {1.0}


def test_uneven_chunks(spark):
    assert qz.chunk_offsets(10, 4) == [0, 3, 6, 8, 10]
    rng = np.random.default_rng(2)
    x = rng.normal(size=(40, 10))
    base = rows(spark, x.tolist())
    off = qz.chunk_offsets(10, 4)
    codes = {r["id"]: r["codes"] for r in qz.pq_encode(base, qz.pq_codebook(base, 8, off), off).collect()}
    for i in range(40):
        want = [int(((x[:8, a:b] - x[i, a:b]) ** 2).sum(axis=1).argmin()) for a, b in zip(off[:-1], off[1:], strict=True)]
        assert codes[i] == want
    tables_ = qz.adc_table(asked(base.where("id < 5")), qz.pq_codebook(base, 8, off), off)
    whole = qz.adc_scan(tables_, qz.pq_encode(base, qz.pq_codebook(base, 8, off), off), 4).collect()
    blocks = qz.adc_scan(tables_, qz.pq_encode(base, qz.pq_codebook(base, 8, off), off), 4, block_bytes=300).collect()
    assert sorted(map(tuple, whole)) == sorted(map(tuple, blocks))


def kernels(edges, degree):
    """The pruning steps, edge by edge."""
    rank = {(s, t): r for s, t, r in edges}
    out = {}
    for s, t, r in edges:
        out.setdefault(s, []).append((r, t))
    cnt = {(s, t): sum(1 for rz, z in out[s] if rz < r and rank.get((z, t), 1 << 30) < r) for s, t, r in edges}
    kept = {s: [t for _, _, t in sorted((cnt[s, t], r, t) for r, t in o)[:degree]] for s, o in out.items()}
    back = {}
    for s, ts in kept.items():
        for t in ts:
            if s not in kept.get(t, []):
                back.setdefault(t, []).append((cnt[s, t], s))
    final = {}
    for n in set(kept) | set(back):
        r = [s for _, s in sorted(back.get(n, []))[: degree // 2]]
        final[n] = (r + kept.get(n, []))[: max(degree, len(r))]
    return cnt, final


@pytest.mark.parametrize("seed,n,cand,degree", [(3, 40, 8, 4), (4, 25, 6, 2), (5, 30, 5, 6)])
def test_pruning_equals_edge_by_edge(spark, seed, n, cand, degree):
    base = rows(spark, np.random.default_rng(seed).normal(size=(n, 3)).tolist())
    e = graph_build.knn_graph(base, cand).cache()
    cnt, final = kernels([(r["src"], r["dst"], r["rank"]) for r in e.collect()], degree)
    counted = graph_build.detour_counts(e)
    assert {(r["src"], r["dst"]): r["cnt"] for r in counted.collect()} == cnt
    pruned = graph_build.prune(counted, degree)
    got = {}
    for r in sorted(graph_build.merged(pruned, graph_build.reverse_edges(pruned, degree), degree).collect()):
        got.setdefault(r["src"], []).append(r["dst"])
    assert got == final
    assert all(len(set(v)) == len(v) for v in got.values())


def test_reciprocal_graph_has_no_reverse_edges_and_hub_is_cut(spark):
    both = spark.createDataFrame([(a, b, 0, 0) for a in range(4) for b in range(4) if a != b], "src long, dst long, slot int, cnt long")
    assert graph_build.reverse_edges(both, 4).count() == 0
    star = spark.createDataFrame([(i, 0, 0, i % 3) for i in range(1, 20)], "src long, dst long, slot int, cnt long")
    assert [r["pred"] for r in graph_build.reverse_edges(star, 6).orderBy("slot").collect()] == [3, 6, 9]


def test_wide_beam_finds_all_and_both_paths_agree(spark):
    base = rows(spark, np.random.default_rng(6).normal(size=(60, 4)).tolist()).cache()
    graph = graph_build.build(base, 12, 8).cache()
    q = graph_search.entries(asked(base.where("id % 9 = 0")), "fixed", 0)
    found = graph_search.in_memory(q, base, graph, 5, 60, 4)
    assert exact.recall(found, exact.knn(asked(base.where("id % 9 = 0")), base, 5), 5).agg(F.min("recall")).first()[0] == 1.0
    a = graph_search.in_memory(q, base, graph, 5, 8, 2, max_hops=4).select("q", "id", "rank").collect()
    b = graph_search.hops(q, base, graph.select("src", "dst"), 5, 8, 2, 4).select("q", "id", "rank").collect()
    assert sorted(map(tuple, a)) == sorted(map(tuple, b))


def test_analytics_on_two_components(spark):
    e = spark.createDataFrame([(1, 2, 1.0), (2, 3, 1.0), (1, 3, 5.0), (7, 8, 1.0), (9, 9, 1.0)], "src long, dst long, weight double")
    assert dict(map(tuple, graph_analytics.components(e).collect())) == {1: 1, 2: 1, 3: 1, 7: 7, 8: 7, 9: 9}
    assert dict(map(tuple, graph_analytics.bfs(e, 1).collect())) == {1: 0, 2: 1, 3: 1}
    assert dict(map(tuple, graph_analytics.sssp(e, 1).collect())) == {1: 0.0, 2: 1.0, 3: 2.0}
    assert abs(sum(r["rank"] for r in graph_analytics.pagerank(e, 8).collect()) - 1) < 1e-9
    assert graph_analytics.bfs(e, 55).count() == 0


@pytest.mark.parametrize("kind", ["fvecs", "bvecs", "ivecs"])
def test_vector_files(spark, tmp_path, kind):
    x = np.random.default_rng(8).integers(0, 200, (30, 6))
    (tmp_path / f"x.{kind}").write_bytes(vecs.dump(x, kind))
    got = vecs.read(spark, str(tmp_path / f"x.{kind}"), kind).orderBy("vec_id").collect()
    assert [list(map(int, r["embedding"])) for r in got] == x.tolist()
    assert vecs.read(spark, str(tmp_path / f"x.{kind}"), kind, limit=7).count() == 7
    df = spark.createDataFrame([(i, [float(v) if kind == "fvecs" else int(v) for v in r]) for i, r in enumerate(x)], f"vec_id long, embedding array<{'float' if kind == 'fvecs' else 'int'}>")
    vecs.write(df, str(tmp_path / "w"), kind)
    assert [list(map(int, r["embedding"])) for r in vecs.read_written(spark, str(tmp_path / "w"), kind).orderBy("vec_id").collect()] == x.tolist()
    with pytest.raises(ValueError):
        vecs.parse(b"\x02\0\0\0\0", kind)


def test_tables(spark, tmp_path):
    g = spark.createDataFrame([(0, 0, 1), (0, 1, 2), (1, 0, 0)], "src long, slot long, dst long")
    tables.dump_graph(g, str(tmp_path / "g"))
    assert tables.load_graph(spark, str(tmp_path / "g"), 1).count() == 2
    assert {r["src"]: r["nbrs"] for r in tables.pack_graph(g).collect()} == {0: [1, 2], 1: [0]}
    ids = spark.createDataFrame([(0, 10), (1, 11), (2, 12)], "local long, id long")
    tables.dump_subgraph(g, ids, str(tmp_path / "s"))
    assert sorted(map(tuple, tables.load_graph(spark, str(tmp_path / "s")).collect())) == [(10, 0, 11), (10, 1, 12), (11, 0, 10)]
    assert tables.graph_name("g", 64, 32, 10_000_000) == "g_64_32_10M"
    assert tables.written_back(g, str(tmp_path / "w"))[1] == 0
    (tmp_path / "b").write_bytes(bytes(range(100)))
    got = tables.read_blocks(spark, str(tmp_path / "b"), 10, 12, 8).orderBy("block").collect()
    assert b"".join(bytes(r["data"]) for r in got) == bytes(range(10, 100))
    edges = spark.createDataFrame([(0, 0, 1, 2.0)], "src long, slot long, dst long, weight double")
    tables.split_edges(edges, str(tmp_path / "e"))
    assert spark.read.parquet(str(tmp_path / "e/val")).count() == 1


def test_stream_goes_on_where_it_stopped(spark, tmp_path):
    from nearframe.streaming.assign import assign_stream, read_stream, run_available

    def arrive(n, values):
        spark.createDataFrame([(n + i, [float(x) for x in v], 0) for i, v in enumerate(values)], "vec_id long, embedding array<float>, label int").write.mode("append").parquet(str(tmp_path / "in"))

    centres = rows(spark, [[0, 0], [10, 10]])
    for n, values in ((0, [[1, 1], [9, 9]]), (2, [[0, 2]])):
        arrive(n, values)
        run_available(assign_stream(read_stream(spark, str(tmp_path / "in")), centres), str(tmp_path / "out"), str(tmp_path / "ck"))
    assert sorted((r["vec_id"], r["cell"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [(0, 0), (1, 1), (2, 0)]


def test_plans(spark, sf):
    """The prefix filter reaches the scan, and top-k limits before the exchange."""
    plan = tables.load_vectors(spark, f"{sf}/embeddings.parquet", 10).select("vec_id")._jdf.queryExecution().toString()
    assert "LessThan(vec_id,10)" in plan and "ReadSchema: struct<vec_id:bigint>" in plan
    base = qz.vectors(spark.read.parquet(f"{sf}/embeddings.parquet"))
    assert "WindowGroupLimit" in exact.knn(asked(base.where("id < 3")), base, 3)._jdf.queryExecution().toString()


def test_trade_components_cover_all_orders(spark, sf):
    from nearframe.plans.registry import QUERIES

    o, l = (spark.read.parquet(f"{sf}/{t}.parquet").toPandas() for t in ("orders", "lineitem"))
    met = o.merge(l, left_on="o_orderkey", right_on="l_orderkey")
    up: dict[int, int] = {}

    def root(x: int) -> int:
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in zip(met["o_custkey"] * 2, met["l_suppkey"] * 2 + 1, strict=True):
        a, b = sorted((root(int(a)), root(int(b))))
        up[b] = a
    assert dict(map(tuple, QUERIES["graph_cc_trade"](spark, sf).collect())) == {x: root(x) for x in up}


@pytest.mark.parametrize("name", ["ivf_search_nprobe", "ivf_index_api", "rvq_search", "pq_adc_topk", "pq_rerank"])
def test_readme_gives_recall_as_measured(spark, name):
    import os
    import re

    from nearframe.plans import registry

    sf = "/root/testdata/sf0.01"
    with open(os.path.join(os.path.dirname(__file__), "..", "README.md"), encoding="utf-8") as f:
        given = float(re.search(rf"^\| {name}\b.*\| ([0-9.]+) \|$", f.read(), re.M)[1])
    base = registry.base(spark, sf)
    found = registry.QUERIES[name](spark, sf)
    truth = exact.knn(registry.asked(base), base, 10, exclude_self=name != "ivf_index_api")
    assert exact.recall(found, truth, 10).agg(F.avg("recall")).first()[0] == pytest.approx(given, abs=0.005)
    assert given >= 0.9


def test_searches_and_upserts_take_all_rows(spark, sf):
    from nearframe.plans.registry import QUERIES

    e = spark.read.parquet(f"{sf}/events.parquet").toPandas().sort_values("event_id").groupby("user_id").tail(1)
    want = {u: (i, t.upper() if i % 3 == 0 else t) for u, i, t in zip(e["user_id"], e["event_id"], e["event_type"], strict=True)}
    assert {r["user_id"]: (r["event_id"], r["event_type"]) for r in QUERIES["upsert_latest_wins"](spark, sf).collect()} == want
    near = rows(spark, [[0], [1], [5]])
    assert [tuple(r)[:2] for r in exact.FlatIndex().add(near).search(asked(near), 1, exclude_self=True).orderBy("q").collect()] == [(0, 1), (1, 0), (2, 1)]


def test_long_chains_are_followed_to_their_end(spark, sf, monkeypatch):
    from nearframe.plans import registry

    n = 45
    chain = spark.createDataFrame([(i, i + 1, 1.0, 1) for i in range(n)] + [(0, n, 100.0, 100)], "src long, dst long, dist double, w long").coalesce(1).cache()
    monkeypatch.setattr(registry, "sparse", lambda *_: chain)
    assert dict(map(tuple, registry.QUERIES["graph_sssp"](spark, sf).collect())) == {i: i for i in range(n + 1)}
    monkeypatch.setattr(registry, "sparse", lambda *_: chain.where("w = 1"))
    monkeypatch.setattr(graph_analytics, "FOLD", 16, raising=False)
    assert dict(map(tuple, registry.QUERIES["graph_bfs"](spark, sf).collect())) == {i: i for i in range(n + 1)}
    for f in (lambda: graph_analytics.bfs(chain.where("w = 1"), 0, 3), lambda: graph_analytics.sssp(chain, 0, F.col("w"), 3)):
        with pytest.raises(RuntimeError):
            f()
    monkeypatch.setattr(graph_analytics, "CYCLE_CHECK", 8, raising=False)
    with pytest.raises(ValueError):
        graph_analytics.sssp(spark.createDataFrame([(1, 2, -1.0), (2, 1, 0.0)], "src long, dst long, weight double"), 1)


def test_beam_search_is_the_same_by_both_paths(spark, monkeypatch):
    base = rows(spark, np.random.default_rng(8).normal(size=(50, 4)).tolist()).cache()
    graph = graph_build.build(base, 8, 4).select("src", "dst").cache()
    q = graph_search.entries(asked(base.where("id % 9 = 0")), "random", n=60)  # one or another entry is no vertex
    found = [graph_search.beam_search(q, base, graph, 5, 6, 2)]
    monkeypatch.setattr(graph_search, "MEMORY_BYTES", 0)
    found.append(graph_search.beam_search(q, base, graph, 5, 6, 2))
    a, b = ([(*r[:2], round(r[2], 9), *r[3:]) for r in f.orderBy("q", "rank").collect()] for f in found)
    assert found[0].dtypes == found[1].dtypes and a and a == b


def test_joins_of_beam_search_go_on_to_the_end(spark):
    line = rows(spark, [[i] for i in range(30)]).coalesce(1).cache()
    graph = spark.createDataFrame([(i, i + 1) for i in range(29)], "src long, dst long").coalesce(1).cache()
    far = asked(line.where("id = 29")).withColumn("entry", F.lit(0).cast("long"))
    r = graph_search.hops(far, line, graph, 1, 4, 1, None).first()
    assert (r["id"], r["hops"], r["dist_comps"], r["entry"]) == (29, 30, 30, 0)


def hard_vectors(case):
    rng = np.random.default_rng(case)
    v = rng.normal(size=(240, 5))
    if case == 1:
        v = rng.integers(0, 2, (240, 3)).astype(float)  # ties
    elif case == 2:
        v[:150] = v[0]  # copies
        v[::7] = 0
    elif case == 3:
        v *= 10.0 ** rng.integers(-20, 20, (240, 1))
    elif case == 4:
        v = v[0] + 1e-9 * v  # nearer than single precision tells
    elif case == 5:
        v[5], v[7] = np.nan, np.inf
    return v


@pytest.mark.parametrize("case", range(6))
@pytest.mark.parametrize("metric", d.METRICS)
def test_sieve_changes_no_result(metric, case, monkeypatch):
    for name, n in (("TILE", 16), ("BLOCK", 37), ("MERGE", 100)):
        monkeypatch.setattr(exact, name, n)
    v, ids = hard_vectors(case), np.random.default_rng(1).permutation(240) * 3
    with np.errstate(all="ignore"):
        near = exact.Nearest(metric, ids[::4], v[::4], 5, True)
        near.add(ids[:100], v[:100])
        near.add(ids[100:], v[100:])
        want = []
        for q, x in zip(ids[::4].tolist(), v[::4], strict=True):
            dist = exact.pairwise(metric, np.repeat(x[None, :], 240, axis=0), v)
            met = sorted((a, i) for a, i in zip(dist.tolist(), ids.tolist(), strict=True) if np.isfinite(a) and i != q)
            want += [(q, i, a, r + 1) for r, (a, i) in enumerate(met[:5])]
        assert sorted(zip(*(x.tolist() for x in near.result()), strict=True)) == sorted(want)


def test_strips_rank_where_they_search(spark):
    """A strip's task sees the whole base: no rows a block for a final top-k, and no groups of pairs of blocks."""
    base = rows(spark, np.random.default_rng(3).normal(size=(90, 4)).tolist())
    plan = exact.knn(asked(base), base, 3, broadcast_bytes=-1)._jdf.queryExecution().toString()
    assert "MapInArrow" in plan and "Window" not in plan and "FlatMapGroups" not in plan
    same = lambda df: sorted((r["q"], r["rank"], r["id"]) for r in df.collect())
    assert same(exact.knn(asked(base), base, 3, broadcast_bytes=-1)) == same(exact.knn(asked(base), base, 3))


def test_pruning_broadcasts_no_edges(spark):
    e = spark.createDataFrame([(0, 1, 0), (1, 2, 0), (0, 2, 1)], "src long, dst long, rank int")
    pruned = graph_build.prune(graph_build.detour_counts(e), 2)
    for df in (pruned, graph_build.reverse_edges(pruned, 2), graph_build.merged(pruned, graph_build.reverse_edges(pruned, 2), 2)):
        assert "Broadcast" not in df._jdf.queryExecution().executedPlan().toString()


def test_beam_search_passes_nothing_by_the_driver(spark, monkeypatch):
    base = rows(spark, np.random.default_rng(9).normal(size=(40, 4)).tolist())
    graph = spark.createDataFrame([(i, (i * j + 1) % 40) for i in range(40) for j in (1, 3, 7)], "src long, dst long")
    q = graph_search.entries(asked(base.where("id % 9 = 0")), "fixed", 0)
    state = q.select("q", F.col("entry").alias("id"), F.lit(1.0).alias("dist"), F.lit(None).cast("int").alias("hop"))
    for df in graph_search._expand(state, q, base, graph, 6, 2, "l2", 1):
        assert "Broadcast" not in df._jdf.queryExecution().executedPlan().toString()

    def fail(*_):
        raise AssertionError("a broadcast")

    monkeypatch.setattr(type(spark.sparkContext), "broadcast", fail)
    found = graph_search.in_memory(q, base, graph, 5, 6, 2)
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString() and found.count() == 25


@pytest.mark.parametrize("held", [1 << 29, 1000])
def test_all_distances_are_sorted_in_bounded_memory(spark, sf, held, monkeypatch):
    from nearframe.plans import registry

    x = np.random.default_rng(7).integers(0, 3, (60, 2)).astype(float)  # many ties
    base = rows(spark, x.tolist()).cache()
    got = {}
    for r in exact.sort_all(asked(base.where("id % 10 = 0")), base, exclude_self=True, held_bytes=held).orderBy("q", "rank").collect():
        got.setdefault(r["q"], []).append((r["dist"], r["id"]))
    dist = exact.distances("l2", x[::10], x)
    assert got == {q: sorted((dist[q // 10, i], i) for i in range(60) if i != q) for q in range(0, 60, 10)}
    monkeypatch.setattr(exact, "SORTED_BYTES", 100)
    assert exact.sort_all(asked(base), base, held_bytes=held).count() == 3600
    monkeypatch.setattr(exact, "knn", None)  # which holds k rows a query
    registry.QUERIES["distance_sort_full"](spark, sf)


def test_analysis_of_a_graph_makes_it_once(spark, tmp_path, sf, monkeypatch):
    from nearframe.plans import registry

    made = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            made.add(b.num_rows)
            yield b

    g = spark.createDataFrame([(i, 0, (i + 1) % 9, 1.0) for i in range(9)], "src long, slot long, dst long, weight double").repartition(3)
    for use in (lambda x: tables.dump_graph(x, str(tmp_path / "g")), lambda x: tables.split_edges(x, str(tmp_path / "e")), lambda x: graph_analytics.components(x).collect()):
        before = made.value
        use(g.mapInArrow(count, g.schema))
        assert made.value - before == 9
    calls = []
    knn = graph_build.knn_graph
    monkeypatch.setattr(graph_build, "knn_graph", lambda *a: calls.append(a) or knn(*a))
    registry.QUERIES["neighbour_selection"](spark, sf)
    assert len(calls) == 1


def test_cells_in_several_strips(spark, monkeypatch):
    base = rows(spark, np.random.default_rng(4).normal(size=(700, 4)).tolist()).cache()
    monkeypatch.setattr(graph_build, "STRIP", 256)
    got = graph_build.subgraph(base, qz.first_rows(base, 2), 5, probes=2)  # every cell is probed
    same = lambda df: sorted(map(tuple, df.select("src", "dst", "rank").collect()))
    assert same(got) == same(graph_build.knn_graph(base, 5))
    assert "FlatMapGroups" not in got._jdf.queryExecution().toString()
