"""All queries of the vector and graph engine, with their DuckDB equivalents.

A query set is every vector whose id is divisible by 100, against all vectors.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nearframe.functions import bloom, integers
from nearframe.functions.distance import METRICS, minus, norm, norm_squared
from nearframe.operators import arrays, exact, graph_analytics, graph_build, graph_search
from nearframe.operators import quantize as qz
from nearframe.sources.staging import stage

# The vectors have no cluster structure, so 0.9 of the true neighbours takes most cells: 14 of 16, and as many entry clusters.
K, NLIST, NPROBE, N1, N2 = 10, 16, 14, 16, 16
ENTRIES = NPROBE * N2
CHUNKS, CODES, ADC_TOP = 16, 256, 50
CANDIDATES, DEGREE, BEAM, WIDTH, HOPS = 16, 8, 16, 2, 3
DIM = 64

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn

    return add


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def base(spark: SparkSession, sf: str) -> DataFrame:
    return qz.vectors(table(spark, sf, "embeddings"))


def asked(rows: DataFrame) -> DataFrame:
    return rows.where("id % 100 = 0").select(F.col("id").alias("q"), "v")


def scaled(rows: DataFrame) -> DataFrame:
    return rows.select("id", F.transform("v", lambda x: x * (1 + F.col("id") % 5)).alias("v"))


def shown(found: DataFrame) -> DataFrame:
    return found.select("q", "id", F.round("dist", 6).alias("dist"), F.col("rank").cast("int").alias("rank"))


# -- SQL parts -----------------------------------------------------------------------------------------
E = "e AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v, label FROM embeddings)"
S = "s AS (SELECT id, list_transform(v, lambda x: x * (1 + id % 5)) AS v FROM e)"
SQL_DIST = {
    "l2": "list_distance({a}, {b})",
    "ip": "-list_inner_product({a}, {b})",
    "cos": "CASE WHEN list_inner_product({a}, {a}) = 0 OR list_inner_product({b}, {b}) = 0 THEN 2.0 ELSE 1 - list_cosine_similarity({a}, {b}) END",
}


def sql_dist(metric: str, a: str = "q.v", b: str = "b.v") -> str:
    return SQL_DIST[metric].format(a=a, b=b)


def sql_top(pairs: str, k: int = K) -> str:
    """The k best of pairs(q, id, dist)."""
    return f"SELECT q, id, round(dist, 6) AS dist, CAST(row_number() OVER (PARTITION BY q ORDER BY dist, id) AS INTEGER) AS rank FROM ({pairs}) QUALIFY rank <= {k}"


def sql_knn(metric: str, source: str = "e", k: int = K) -> str:
    return sql_top(f"SELECT q.id AS q, b.id, {sql_dist(metric)} AS dist FROM {source} q, {source} b WHERE q.id % 100 = 0 AND b.id <> q.id", k)


# -- distances and exact search ------------------------------------------------------------------------
for _m in METRICS:
    query(f"knn_{_m}_topk", f"WITH {E} {sql_knn(_m)}")(
        lambda spark, sf, m=_m: shown(exact.knn(asked(base(spark, sf)), base(spark, sf), K, m, exclude_self=True))
    )
    query(f"knn_scaled_{_m}", f"WITH {E}, {S} {sql_knn(_m, 's')}")(
        lambda spark, sf, m=_m: shown(exact.knn(asked(scaled(base(spark, sf))), scaled(base(spark, sf)), K, m, exclude_self=True))
    )


@query("knn_grid_l2", f"WITH {E} {sql_knn('l2')}")
def _(spark, sf):
    """The same search by the grid of blocks, as for query sets too large to send."""
    return shown(exact.knn(asked(base(spark, sf)), base(spark, sf), K, "l2", exclude_self=True, broadcast_bytes=-1))


@query("flat_index_search", f"WITH {E} {sql_knn('l2')}")
def _(spark, sf):
    rows = base(spark, sf)
    index = exact.FlatIndex("l2").add(rows.where("id % 2 = 0")).add(rows.where("id % 2 <> 0"))
    return shown(index.search(asked(rows), K, exclude_self=True))


query("vector_norms", f"WITH {E} SELECT id, round(sqrt(list_inner_product(v, v)), 6) AS norm FROM e")(lambda spark, sf: base(spark, sf).select("id", F.round(norm(F.col("v")), 6).alias("norm")))
query("vector_norms_sq", f"WITH {E} SELECT id, round(list_inner_product(v, v), 6) AS norm_sq FROM e")(lambda spark, sf: base(spark, sf).select("id", F.round(norm_squared(F.col("v")), 6).alias("norm_sq")))


@query("vector_center", f"WITH {E}, c AS (SELECT v FROM e ORDER BY id LIMIT 1) SELECT e.id, round(list_sum(list_transform(range(1, {DIM} + 1), lambda i: abs(e.v[i] - c.v[i]))), 6) AS l1, round(e.v[1] - c.v[1], 6) AS first FROM e, c")
def _(spark, sf):
    rows = base(spark, sf)
    centre = qz.as_array(qz.first_rows(rows, 1))
    moved = rows.withColumn("c", centre).select("id", minus(F.col("v"), F.col("c")[0]["v"]).alias("d"))
    return moved.select("id", F.round(F.aggregate("d", F.lit(0.0), lambda a, x: a + F.abs(x)), 6).alias("l1"), F.round(F.col("d")[0], 6).alias("first"))


@query("distance_block_stats", f"WITH {E}, d AS (SELECT q.id AS q, {sql_dist('l2')} AS dist FROM e q, e b WHERE q.id % 100 = 0 AND b.id <> q.id) SELECT q, count(*) AS n, round(min(dist), 6) AS nearest, round(max(dist), 6) AS farthest FROM d GROUP BY q")
def _(spark, sf):
    """All distances of the query set, summed up where they are made: the nearest and the farthest."""
    found = exact.distance_stats(asked(base(spark, sf)), base(spark, sf), "l2", exclude_self=True)
    return found.select("q", "n", F.round("nearest", 6).alias("nearest"), F.round("farthest", 6).alias("farthest"))


@query("distance_sort_full", f"WITH {E} " + sql_top(f"SELECT q.id AS q, b.id, {sql_dist('l2')} AS dist FROM e q, e b WHERE q.id % 100 = 0 AND b.id <> q.id", 1 << 40))
def _(spark, sf):
    rows = base(spark, sf)
    return shown(exact.sort_all(asked(rows), rows, "l2", exclude_self=True))


RADIUS = 1.2


@query("radius_search", f"WITH {E} SELECT q.id AS q, b.id, round({sql_dist('l2')}, 6) AS dist FROM e q, e b WHERE q.id % 100 = 0 AND b.id <> q.id AND {sql_dist('l2')} <= {RADIUS}")
def _(spark, sf):
    rows = base(spark, sf)
    return exact.within(asked(rows), rows, RADIUS, "l2", exclude_self=True).select("q", "id", F.round("dist", 6).alias("dist"))


@query("knn_filtered_label", f"WITH {E} " + sql_top(f"SELECT q.id AS q, b.id, {sql_dist('l2')} AS dist FROM e q, e b WHERE q.id % 100 = 0 AND b.id <> q.id AND b.label = 3"))
def _(spark, sf):
    rows = qz.vectors(table(spark, sf, "embeddings").where("label = 3"))
    return shown(exact.knn(asked(base(spark, sf)), rows, K, "l2", exclude_self=True))


@query("load_prefix", "SELECT count(*) AS n, CAST(sum(label) AS BIGINT) AS labels, max(vec_id) AS last FROM embeddings WHERE vec_id < 200")
def _(spark, sf):
    from nearframe.sources.tables import load_vectors

    return load_vectors(spark, f"{sf}/embeddings.parquet", 200).agg(F.count("*").alias("n"), F.sum("label").alias("labels"), F.max("vec_id").alias("last"))


# -- inverted lists --------------------------------------------------------------------------------------
CELLS = f"c AS (SELECT id, v FROM e ORDER BY id LIMIT {NLIST})"
ASSIGN = f"a AS (SELECT id, v, cell, cell_dist FROM (SELECT e.id, e.v, c.id AS cell, {sql_dist('l2', 'e.v', 'c.v')} AS cell_dist FROM e, c) QUALIFY row_number() OVER (PARTITION BY id ORDER BY cell_dist, cell) = 1)"
PROBES = f"p AS (SELECT q, v, cell FROM (SELECT e.id AS q, e.v, c.id AS cell, {sql_dist('l2', 'e.v', 'c.v')} AS d FROM e, c WHERE e.id % 100 = 0) QUALIFY row_number() OVER (PARTITION BY q ORDER BY d, cell) <= {NPROBE})"
IVF = f"WITH {E}, {CELLS}, {ASSIGN}, {PROBES}"
IVF_PAIRS = f"SELECT p.q, a.id, {sql_dist('l2', 'p.v', 'a.v')} AS dist FROM p JOIN a USING (cell) WHERE p.q <> a.id"


def ivf(spark, sf) -> tuple[DataFrame, DataFrame]:
    rows = base(spark, sf)
    centres = qz.first_rows(rows, NLIST)
    return centres, qz.assign(rows, centres)


query("argmin_nearest_centroid", f"{IVF} SELECT id, cell, round(cell_dist, 6) AS dist FROM a")(lambda spark, sf: ivf(spark, sf)[1].select("id", "cell", F.round("cell_dist", 6).alias("dist")))
query("ivf_assign", f"{IVF} SELECT id, cell FROM a")(lambda spark, sf: ivf(spark, sf)[1].select("id", "cell"))
query("ivf_list_sizes", f"{IVF} SELECT cell, count(*) AS n FROM a GROUP BY cell")(lambda spark, sf: ivf(spark, sf)[1].groupBy("cell").agg(F.count("*").alias("n")))


@query("ivf_search_nprobe", f"{IVF} {sql_top(IVF_PAIRS)}")
def _(spark, sf):
    centres, cells = ivf(spark, sf)
    return shown(qz.ivf_search(asked(base(spark, sf)), cells, centres, K, NPROBE, exclude_self=True))


@query("ivf_index_api", f"{IVF} {sql_top(IVF_PAIRS.replace(' WHERE p.q <> a.id', ''))}")
def _(spark, sf):
    rows = base(spark, sf)
    return shown(qz.IvfIndex(NLIST).train(rows).add(rows).search(asked(rows), K, NPROBE))


@query("ivf_lloyd_step", f"WITH {E}, {CELLS}, {ASSIGN}, x AS (SELECT cell, unnest(v) AS x, unnest(range(0, {DIM})) AS j FROM a) SELECT cell AS id, CAST(j AS INTEGER) AS j, round(avg(x), 6) AS x FROM x GROUP BY cell, j")
def _(spark, sf):
    rows = base(spark, sf)
    return qz.lloyd(rows, qz.first_rows(rows, NLIST)).select("id", F.posexplode("v").alias("j", "x")).select("id", "j", F.round("x", 6).alias("x"))


@query("recall_ivf", f"{IVF}, t AS (SELECT q, id FROM ({sql_knn('l2')})), f AS (SELECT q, id FROM ({sql_top(IVF_PAIRS)})) SELECT t.q, count(f.id) AS hits, round(count(f.id) / {K}.0, 6) AS recall FROM t LEFT JOIN f ON f.q = t.q AND f.id = t.id GROUP BY t.q")
def _(spark, sf):
    rows = base(spark, sf)
    centres, cells = ivf(spark, sf)
    found = qz.ivf_search(asked(rows), cells, centres, K, NPROBE, exclude_self=True)
    truth = exact.knn(asked(rows), rows, K, exclude_self=True)
    return exact.recall(found, truth, K).select("q", "hits", F.round("recall", 6).alias("recall"))


# -- two-layer residual quantisation ---------------------------------------------------------------------
SUB = f"list_transform(range(1, {DIM} + 1), lambda i: {{a}}[i] - {{b}}[i])"
RVQ = f"""WITH {E}, k1 AS (SELECT id, v FROM e ORDER BY id LIMIT {N1}),
n1 AS (SELECT id, v, c1, cv FROM (SELECT e.id, e.v, k1.id AS c1, k1.v AS cv, {sql_dist('l2', 'e.v', 'k1.v')} AS d FROM e, k1) QUALIFY row_number() OVER (PARTITION BY id ORDER BY d, c1) = 1),
r AS (SELECT id, v, c1, {SUB.format(a='v', b='cv')} AS r FROM n1),
k2 AS (SELECT row_number() OVER (ORDER BY id) - 1 AS id, r FROM (SELECT id, r FROM r ORDER BY id LIMIT {N2})),
n2 AS (SELECT id, v, c1, c2, d FROM (SELECT r.id, r.v, r.c1, k2.id AS c2, {sql_dist('l2', 'r.r', 'k2.r')} AS d FROM r, k2) QUALIFY row_number() OVER (PARTITION BY id ORDER BY d, c2) = 1)"""


def rvq(spark, sf) -> tuple[DataFrame, DataFrame, DataFrame]:
    rows = base(spark, sf)
    coarse, fine = qz.rvq_train(rows, N1, N2)
    return rows, coarse, fine


@query("rvq_train_residual", f"{RVQ} SELECT id, round(sqrt(list_inner_product(r, r)), 6) AS residual_norm FROM k2")
def _(spark, sf):
    return rvq(spark, sf)[2].select("id", F.round(norm(F.col("v")), 6).alias("residual_norm"))


@query("rvq_entry_cluster", f"{RVQ} SELECT id, c1, c2, round(d, 6) AS dist FROM n2")
def _(spark, sf):
    return qz.rvq_assign(*rvq(spark, sf)).select("id", "c1", "c2", F.round("dist", 6).alias("dist"))


PLACES = f"""places AS (SELECT k1.id AS c1, k2.id AS c2, list_transform(range(1, {DIM} + 1), lambda i: k1.v[i] + k2.r[i]) AS v FROM k1, k2),
pe AS (SELECT q, v, c1, c2 FROM (SELECT e.id AS q, e.v, places.c1, places.c2, {sql_dist('l2', 'e.v', 'places.v')} AS d FROM e, places WHERE e.id % 100 = 0) QUALIFY row_number() OVER (PARTITION BY q ORDER BY d, c1, c2) <= {ENTRIES})"""


@query("rvq_search", f"{RVQ}, {PLACES} " + sql_top(f"SELECT q.q, b.id, {sql_dist('l2')} AS dist FROM pe q JOIN n2 b USING (c1, c2) WHERE b.id <> q.q"))
def _(spark, sf):
    rows, coarse, fine = rvq(spark, sf)
    return shown(qz.rvq_search(asked(rows), rows, coarse, fine, K, exclude_self=True, probes=ENTRIES))


@query("ivf_calibrated_recall")
def _(spark, sf):
    """The least nprobe at which the query set finds 0.9 of its true neighbours, and the recall of a search with it."""
    rows = base(spark, sf)
    centres, cells = ivf(spark, sf)
    lists = stage(cells)
    truth = stage(exact.knn(asked(rows), rows, K, exclude_self=True))
    n = qz.probes_for(asked(rows), truth, lists, centres, 0.9)
    found = qz.ivf_search(asked(rows), lists, centres, K, n, exclude_self=True)
    return exact.recall(found, truth, K).agg(F.lit(n).alias("nprobe"), F.round(F.avg("recall"), 6).alias("recall"))


# -- product quantisation ----------------------------------------------------------------------------------
OFFSETS = qz.chunk_offsets(DIM, CHUNKS)
_CUT = ", ".join(f"v[{a + 1}:{b}]" for a, b in zip(OFFSETS[:-1], OFFSETS[1:], strict=True))
PQ = f"""WITH {E}, ch AS (SELECT id, unnest(range(0, {CHUNKS})) AS chunk, unnest([{_CUT}]) AS part FROM e),
seed AS (SELECT id, row_number() OVER (ORDER BY id) - 1 AS code FROM e ORDER BY id LIMIT {CODES}),
book AS (SELECT seed.code, ch.chunk, ch.part FROM seed JOIN ch USING (id)),
code AS (SELECT id, chunk, code FROM (SELECT ch.id, ch.chunk, book.code, list_distance(ch.part, book.part) AS d FROM ch JOIN book USING (chunk)) QUALIFY row_number() OVER (PARTITION BY id, chunk ORDER BY d, code) = 1),
t AS (SELECT ch.id AS q, ch.chunk, book.code, power(list_distance(ch.part, book.part), 2) AS d FROM ch JOIN book USING (chunk) WHERE ch.id % 100 = 0)"""
# sums of whole numbers of 1e-9, so that equal sums are equal in any order
ADC = "SELECT t.q, code.id, CAST(sum(CAST(round(t.d * 1000000000) AS BIGINT)) AS DOUBLE) / 1000000000 AS dist FROM t JOIN code USING (chunk, code) WHERE t.q <> code.id GROUP BY t.q, code.id"


def pq(spark, sf) -> tuple[DataFrame, DataFrame, DataFrame]:
    rows = base(spark, sf)
    book = qz.pq_codebook(rows, CODES, OFFSETS)
    return rows, book, qz.pq_encode(rows, book, OFFSETS)


query("pq_encode", f"{PQ} SELECT id, CAST(chunk AS INTEGER) AS chunk, CAST(code AS INTEGER) AS code FROM code")(lambda spark, sf: pq(spark, sf)[2].select("id", F.posexplode("codes").alias("chunk", "code")))


@query("pq_adc_table", f"{PQ} SELECT q, CAST(chunk AS INTEGER) AS chunk, CAST(code AS INTEGER) AS code, round(d, 6) AS dist FROM t")
def _(spark, sf):
    rows, book, _ = pq(spark, sf)
    t = qz.adc_table(asked(rows), book, OFFSETS).select("q", F.posexplode("t").alias("chunk", "row"))
    return t.select("q", "chunk", F.posexplode("row").alias("code", "d")).select("q", "chunk", "code", F.round("d", 6).alias("dist"))


def adc(spark, sf, m: int) -> DataFrame:
    rows, book, codes = pq(spark, sf)
    t = qz.adc_table(asked(rows), book, OFFSETS).withColumn("t", F.transform("t", lambda c: F.transform(c, lambda x: F.round(x * 1_000_000_000))))
    return qz.adc_scan(t, codes, m, exclude_self=True).withColumn("dist", F.col("dist") / 1_000_000_000)


query("pq_adc_topk", f"{PQ} {sql_top(ADC, ADC_TOP)}")(lambda spark, sf: shown(adc(spark, sf, ADC_TOP)))


@query(
    "pq_adc_centroid",
    f"""{PQ}, mid AS (SELECT list(m ORDER BY j) AS m FROM (SELECT j, avg(x) AS m FROM (SELECT unnest(v) AS x, unnest(range(0, {DIM})) AS j FROM e) GROUP BY j)),
qc AS (SELECT e.id AS q, list_transform(range(1, {DIM} + 1), lambda i: e.v[i] - mid.m[i]) AS v FROM e, mid WHERE e.id % 100 = 0),
qch AS (SELECT q, unnest(range(0, {CHUNKS})) AS chunk, unnest([{_CUT}]) AS part FROM qc)
SELECT q, CAST(book.chunk AS INTEGER) AS chunk, CAST(code AS INTEGER) AS code, round(power(list_distance(qch.part, book.part), 2), 6) AS dist FROM qch JOIN book USING (chunk)""",
)
def _(spark, sf):
    """Tables of {CODES} codes a chunk for queries less the centroid of all vectors."""
    rows, book, _ = pq(spark, sf)
    mid = rows.select(F.posexplode("v").alias("j", "x")).groupBy("j").agg(F.avg("x").alias("x")).agg(F.transform(F.sort_array(F.collect_list(F.struct("j", "x"))), lambda s: s["x"]).alias("m"))
    t = qz.adc_table(asked(rows).crossJoin(F.broadcast(mid)).select("q", "v", "m"), book, OFFSETS, F.col("m"))  # mid is one row
    return t.select("q", F.posexplode("t").alias("chunk", "row")).select("q", "chunk", F.posexplode("row").alias("code", "d")).select("q", "chunk", "code", F.round("d", 6).alias("dist"))


@query("pq_rerank", f"{PQ}, f AS (SELECT q, id FROM ({sql_top(ADC, ADC_TOP)})) " + sql_top(f"SELECT f.q, f.id, {sql_dist('l2', 'a.v', 'b.v')} AS dist FROM f JOIN e a ON a.id = f.q JOIN e b ON b.id = f.id"))
def _(spark, sf):
    rows = base(spark, sf)
    return shown(qz.rerank(adc(spark, sf, ADC_TOP), asked(rows), rows, K))


# -- graph build ---------------------------------------------------------------------------------------------
KNN = f"knn AS (SELECT src, dst, rank, dist FROM (SELECT a.id AS src, b.id AS dst, dist, row_number() OVER (PARTITION BY a.id ORDER BY dist, b.id) - 1 AS rank FROM (SELECT a.id AS a_id, b.id AS b_id, {sql_dist('l2', 'a.v', 'b.v')} AS dist FROM e a, e b WHERE a.id <> b.id) p JOIN e a ON a.id = p.a_id JOIN e b ON b.id = p.b_id) WHERE rank < {CANDIDATES})"
DET = "det AS (SELECT xy.src, xy.dst, xy.rank, count(zy.src) AS cnt FROM knn xy LEFT JOIN knn xz ON xz.src = xy.src AND xz.rank < xy.rank LEFT JOIN knn zy ON zy.src = xz.dst AND zy.dst = xy.dst AND zy.rank < xy.rank GROUP BY 1, 2, 3)"
PR = f"pr AS (SELECT src, dst, slot, cnt FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY cnt, rank) - 1 AS slot FROM det) WHERE slot < {DEGREE})"
REV = f"rev AS (SELECT node, pred, slot, cnt FROM (SELECT x.dst AS node, x.src AS pred, x.cnt, row_number() OVER (PARTITION BY x.dst ORDER BY x.cnt, x.src) - 1 AS slot FROM pr x WHERE NOT EXISTS (SELECT 1 FROM pr y WHERE y.src = x.dst AND y.dst = x.src)) WHERE slot < {DEGREE // 2})"
FIN = f"fin AS (SELECT node AS src, slot, pred AS dst FROM rev UNION ALL SELECT pr.src, pr.slot + coalesce(n, 0), pr.dst FROM pr LEFT JOIN (SELECT node, count(*) AS n FROM rev GROUP BY node) m ON m.node = pr.src WHERE pr.slot + coalesce(n, 0) < {DEGREE})"
GRAPH = f"{E}, {KNN}, {DET}, {PR}, {REV}, {FIN}"


def edges(spark, sf) -> DataFrame:
    return stage(graph_build.knn_graph(base(spark, sf), CANDIDATES))


def final_graph(spark, sf) -> DataFrame:
    return stage(graph_build.build(base(spark, sf), CANDIDATES, DEGREE))


query("knn_graph", f"WITH {E}, {KNN} SELECT src, dst, CAST(rank AS INTEGER) AS rank, round(dist, 6) AS dist FROM knn")(lambda spark, sf: graph_build.knn_graph(base(spark, sf), CANDIDATES).select("src", "dst", F.col("rank").cast("int").alias("rank"), F.round("dist", 6).alias("dist")))
query("graph_detour_count", f"WITH {GRAPH} SELECT src, dst, CAST(rank AS INTEGER) AS rank, cnt FROM det")(lambda spark, sf: graph_build.detour_counts(edges(spark, sf)).select("src", "dst", F.col("rank").cast("int").alias("rank"), "cnt"))
query("graph_prune", f"WITH {GRAPH} SELECT src, dst, CAST(slot AS INTEGER) AS slot, cnt FROM pr")(lambda spark, sf: graph_build.prune(graph_build.detour_counts(edges(spark, sf)), DEGREE).select("src", "dst", F.col("slot").cast("int").alias("slot"), "cnt"))
query("graph_reverse", f"WITH {GRAPH} SELECT node, pred, CAST(slot AS INTEGER) AS slot, cnt FROM rev")(lambda spark, sf: graph_build.reverse_edges(stage(graph_build.prune(graph_build.detour_counts(edges(spark, sf)), DEGREE)), DEGREE).select("node", "pred", F.col("slot").cast("int").alias("slot"), "cnt"))
query("graph_final", f"WITH {GRAPH} SELECT src, CAST(slot AS BIGINT) AS slot, dst FROM fin")(lambda spark, sf: graph_build.build(base(spark, sf), CANDIDATES, DEGREE))
query("graph_degree_stats", f"WITH {GRAPH}, o AS (SELECT src, count(*) AS d FROM fin GROUP BY src), i AS (SELECT dst, count(*) AS d FROM fin GROUP BY dst) SELECT count(*) AS nodes, CAST(sum(d) AS BIGINT) AS edges, min(d) AS min_out, max(d) AS max_out, (SELECT max(d) FROM i) AS max_in FROM o")(lambda spark, sf: graph_build.degree_stats(final_graph(spark, sf)))


@query(
    "subgraph_merge",
    f"{IVF}, w AS (SELECT src, dst, dist, row_number() OVER (PARTITION BY src ORDER BY dist, dst) - 1 AS rank FROM (SELECT x.id AS src, y.id AS dst, {sql_dist('l2', 'x.v', 'y.v')} AS dist FROM a x JOIN a y USING (cell) WHERE x.id <> y.id)), "
    f"u AS (SELECT src, dst, min(dist) AS dist FROM (SELECT src, dst, dist FROM w WHERE rank < {DEGREE} UNION ALL SELECT q AS src, id AS dst, dist FROM (SELECT q.id AS q, b.id, {sql_dist('l2')} AS dist FROM e q, e b WHERE q.id % 100 = 0 AND b.id <> q.id) QUALIFY row_number() OVER (PARTITION BY q ORDER BY dist, id) <= {DEGREE}) GROUP BY src, dst) "
    f"SELECT src, dst, CAST(row_number() OVER (PARTITION BY src ORDER BY dist, dst) - 1 AS INTEGER) AS rank FROM u QUALIFY rank < {DEGREE}",
)
def _(spark, sf):
    """Edges within cells, merged with exact edges of the query set."""
    rows = base(spark, sf)
    local = graph_build.subgraph(rows, qz.first_rows(rows, NLIST), DEGREE)
    sure = exact.knn(asked(rows), rows, DEGREE, exclude_self=True).select(F.col("q").alias("src"), F.col("id").alias("dst"), "dist")
    return graph_build.merge_graphs(local, sure, DEGREE).select("src", "dst", F.col("rank").cast("int").alias("rank"))


@query("graph_build_in_cells")
def _(spark, sf):
    """A graph from the nearest cells of each vector, and the share of the exact graph's k-NN edges that it finds."""
    rows = base(spark, sf)
    near = stage(graph_build.subgraph(rows, qz.first_rows(rows, NLIST), CANDIDATES, probes=NPROBE))
    return exact.recall(near.select(F.col("src").alias("q"), F.col("dst").alias("id")), edges(spark, sf).select(F.col("src").alias("q"), F.col("dst").alias("id")), CANDIDATES).agg(F.count("*").alias("vectors"), F.round(F.avg("recall"), 4).alias("recall"))


# -- graph search ----------------------------------------------------------------------------------------------
def _hop_sql(n: int) -> str:
    """State after hop n from state after hop n - 1 (st<n>: q, id, dist, expanded)."""
    p = f"st{n - 1}"
    return f""", li{n} AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY dist, id) AS r FROM {p}),
op{n} AS (SELECT q, id FROM li{n} WHERE r <= {BEAM} AND NOT expanded QUALIFY row_number() OVER (PARTITION BY q ORDER BY dist, id) <= {WIDTH}),
nw{n} AS (SELECT DISTINCT o.q, g.dst AS id FROM op{n} o JOIN graph g ON g.src = o.id WHERE NOT EXISTS (SELECT 1 FROM {p} s WHERE s.q = o.q AND s.id = g.dst)),
st{n} AS MATERIALIZED (SELECT s.q, s.id, s.dist, s.expanded OR EXISTS (SELECT 1 FROM op{n} o WHERE o.q = s.q AND o.id = s.id) AS expanded FROM {p} s
  UNION ALL SELECT n.q, n.id, {sql_dist('l2', 'a.v', 'b.v')}, FALSE FROM nw{n} n JOIN e a ON a.id = n.q JOIN e b ON b.id = n.id)"""


BEAM_SQL = f"WITH {GRAPH}, graph AS MATERIALIZED (SELECT src, dst FROM fin), st0 AS (SELECT q.id AS q, b.id, {sql_dist('l2')} AS dist, FALSE AS expanded FROM e q, e b WHERE q.id % 100 = 0 AND b.id = 0)" + "".join(_hop_sql(n) for n in range(1, HOPS + 1))


@query("beam_search_fixed_hops", f"{BEAM_SQL} " + sql_top(f"SELECT q, id, dist FROM st{HOPS}"))
def _(spark, sf):
    rows = base(spark, sf)
    q = graph_search.entries(asked(rows), "fixed", 0)
    return shown(graph_search.hops(q, rows, final_graph(spark, sf).select("src", "dst"), K, BEAM, WIDTH, HOPS))


#: Beam of the searches to the end, and hops that are written out in their SQL (one after the end changes nothing).
WIDE, MOST_HOPS = 64, 80


def _search_sql(start: str) -> str:
    """State (q, id, dist, hop) after as many hops as it takes, from start (q, id, dist)."""
    out = f", st0 AS MATERIALIZED (SELECT q, id, dist, CAST(NULL AS INTEGER) AS hop FROM ({start}))"
    for n in range(1, MOST_HOPS + 1):
        p = f"st{n - 1}"
        out += f""", op{n} AS MATERIALIZED (SELECT q, id FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY dist, id) AS r FROM {p}) WHERE r <= {WIDE} AND hop IS NULL QUALIFY row_number() OVER (PARTITION BY q ORDER BY dist, id) <= {WIDTH}),
nw{n} AS (SELECT DISTINCT o.q, g.dst AS id FROM op{n} o JOIN graph g ON g.src = o.id ANTI JOIN {p} s ON s.q = o.q AND s.id = g.dst),
st{n} AS MATERIALIZED (SELECT s.q, s.id, s.dist, CASE WHEN o.q IS NULL THEN s.hop ELSE {n} END AS hop FROM {p} s LEFT JOIN op{n} o ON o.q = s.q AND o.id = s.id
  UNION ALL SELECT n.q, n.id, {sql_dist('l2', 'a.v', 'b.v')}, NULL FROM nw{n} n JOIN e a ON a.id = n.q JOIN e b ON b.id = n.id)"""
    return out


def _found_sql(entry: str, k: int = K) -> str:
    return f"""SELECT f.q, f.id, f.dist, f.rank, c.hops, c.dist_comps, n.entry FROM ({sql_top(f'SELECT q, id, dist FROM st{MOST_HOPS}', k)}) f
JOIN (SELECT q, coalesce(max(hop), 0) AS hops, count(*) AS dist_comps FROM st{MOST_HOPS} GROUP BY q) c USING (q) JOIN ({entry}) n USING (q)"""


FIXED = "SELECT id AS q, 0::BIGINT AS entry FROM e WHERE id % 100 = 0"
#: A fixed rule that mixes: every query another entry, the same in SQL.
MIXED = "SELECT id AS q, (id * 7919 + 13) % (SELECT count(*) FROM e) AS entry FROM e WHERE id % 100 = 0"


def _start(entry: str) -> str:
    return f"SELECT n.q, b.id, {sql_dist('l2', 'a.v', 'b.v')} AS dist FROM ({entry}) n JOIN e a ON a.id = n.q JOIN e b ON b.id = n.entry"


GRAPHED = f"{GRAPH}, graph AS MATERIALIZED (SELECT src, dst FROM fin)"


def searched(spark, sf, queries: DataFrame, k: int = K) -> DataFrame:
    found = graph_search.beam_search(queries, base(spark, sf), final_graph(spark, sf), k, WIDE, WIDTH)
    return found.withColumn("dist", F.round("dist", 6)).withColumn("hops", F.col("hops").cast("int"))


@query("beam_search", f"WITH {GRAPHED}{_search_sql(_start(FIXED))} {_found_sql(FIXED)}")
def _(spark, sf):
    return searched(spark, sf, graph_search.entries(asked(base(spark, sf)), "fixed", 0))


@query("beam_search_random_entry", f"WITH {GRAPHED}{_search_sql(_start(MIXED))} {_found_sql(MIXED)}")
def _(spark, sf):
    rows = base(spark, sf)
    prior = asked(rows).select("q", F.pmod(F.col("q") * 7919 + 13, F.lit(rows.count())).alias("entry"))
    return searched(spark, sf, graph_search.entries(asked(rows), "prior", prior=prior))


@query("beam_search_hashed_entry")
def _(spark, sf):
    """Entries by a hash that SQL does not have."""
    rows = base(spark, sf)
    return searched(spark, sf, graph_search.entries(asked(rows), "random", n=rows.count()))


PRIOR = "SELECT x.id AS q, coalesce(f.entry, w.entry) AS entry FROM n2 x LEFT JOIN (SELECT c1, c2, min(id) AS entry FROM n2 GROUP BY c1, c2) f USING (c1, c2) LEFT JOIN (SELECT c1, min(id) AS entry FROM n2 GROUP BY c1) w ON w.c1 = x.c1 WHERE x.id % 100 = 0"


def hybrid(spark, sf) -> DataFrame:
    """The two-layer index picks an entry vertex near the query: the first vector of its entry cluster, else of its cell."""
    rows, coarse, fine = rvq(spark, sf)
    cells = stage(qz.rvq_assign(rows, coarse, fine))
    own = cells.groupBy("c1", "c2").agg(F.min("id").alias("fine_entry"))
    wide = cells.groupBy("c1").agg(F.min("id").alias("coarse_entry"))
    q = stage(qz.rvq_assign(asked(rows).select(F.col("q").alias("id"), "v"), coarse, fine))
    prior = q.join(own, ["c1", "c2"], "left").join(wide, "c1", "left").select(F.col("id").alias("q"), F.coalesce("fine_entry", "coarse_entry").alias("entry"))
    return searched(spark, sf, graph_search.entries(asked(rows), "prior", prior=prior))


query("hybrid_search", f"{RVQ}, {GRAPHED.removeprefix(E + ', ')}{_search_sql(_start(PRIOR))} {_found_sql(PRIOR)}")(hybrid)


@query("recall_beam", f"WITH {GRAPHED}{_search_sql(_start(FIXED))}, t AS (SELECT q, id FROM ({sql_knn('l2')})), f AS (SELECT q, id FROM ({sql_top(f'SELECT q, id, dist FROM st{MOST_HOPS}', K + 1)}) WHERE q <> id) SELECT t.q, count(f.id) AS hits, round(count(f.id) / {K}.0, 6) AS recall FROM t LEFT JOIN f ON f.q = t.q AND f.id = t.id GROUP BY t.q")
def _(spark, sf):
    rows = base(spark, sf)
    found = searched(spark, sf, graph_search.entries(asked(rows), "fixed", 0), K + 1).where("q <> id")
    return exact.recall(found, exact.knn(asked(rows), rows, K, exclude_self=True), K).select("q", "hits", F.round("recall", 6).alias("recall"))


@query("candidate_merge_topl", f"{IVF}, x AS ({sql_top(IVF_PAIRS)}), y AS ({sql_knn('l2', 'e', 5)}), u AS (SELECT q, id, dist, TRUE AS visited FROM x UNION ALL SELECT q, id, dist, FALSE FROM y WHERE NOT EXISTS (SELECT 1 FROM x WHERE x.q = y.q AND x.id = y.id)) SELECT q, id, dist, visited, CAST(row_number() OVER (PARTITION BY q ORDER BY dist, id) AS INTEGER) AS rank FROM u QUALIFY rank <= {K}")
def _(spark, sf):
    rows = base(spark, sf)
    centres, cells = ivf(spark, sf)
    have = shown(qz.ivf_search(asked(rows), cells, centres, K, NPROBE, exclude_self=True)).withColumn("visited", F.lit(True))
    new = shown(exact.knn(asked(rows), rows, 5, exclude_self=True)).withColumn("visited", F.lit(False))
    return graph_search.merge_lists(have, new, K).select("q", "id", "dist", "visited", F.col("rank").cast("int").alias("rank"))


@query("visited_dedupe", f"WITH {GRAPH} SELECT DISTINCT o.src AS q, g.dst AS id FROM fin o JOIN fin g ON g.src = o.dst WHERE o.src % 100 = 0 AND g.dst <> o.src AND NOT EXISTS (SELECT 1 FROM fin s WHERE s.src = o.src AND s.dst = g.dst)")
def _(spark, sf):
    g = final_graph(spark, sf).select("src", "dst")
    two = g.where("src % 100 = 0").join(g.select(F.col("src").alias("dst"), F.col("dst").alias("far")), "dst")
    return two.where("far <> src").select(F.col("src").alias("q"), F.col("far").alias("id")).distinct().join(g.select(F.col("src").alias("q"), F.col("dst").alias("id")), ["q", "id"], "left_anti")


# -- graph analytics: two nearest neighbours of each vector, and customers with their suppliers ----------------
SPARSE = f"{E}, {KNN}, sg AS (SELECT src, dst, dist, CAST(round(dist * 1000) AS BIGINT) AS w FROM knn WHERE rank < 4)"
TRADE = "tr AS (SELECT DISTINCT o_custkey * 2 AS src, l_suppkey * 2 + 1 AS dst FROM orders JOIN lineitem ON l_orderkey = o_orderkey)"


def sparse(spark, sf) -> DataFrame:
    return stage(graph_build.knn_graph(base(spark, sf), 4).withColumn("w", F.round(F.col("dist") * 1000).cast("long")))


def trade(spark, sf) -> DataFrame:
    o, l = table(spark, sf, "orders"), table(spark, sf, "lineitem")
    met = o.join(l, F.col("l_orderkey") == F.col("o_orderkey"))
    return met.select((F.col("o_custkey") * 2).alias("src"), (F.col("l_suppkey") * 2 + 1).alias("dst")).distinct()


def _least_sql(name: str, start: str, edge: str, value: str) -> str:
    """Recursion that keeps the least value of each node and ends when none improves; edge: (src, dst, w)."""
    return f"{name}(node, {value}) USING KEY (node) AS ({start} UNION SELECT g.dst, min(b.{value} + g.w) FROM {name} b JOIN ({edge}) g ON g.src = b.node LEFT JOIN recurring.{name} o ON o.node = g.dst WHERE o.node IS NULL OR b.{value} + g.w < o.{value} GROUP BY g.dst)"


@query("graph_bfs", f"WITH RECURSIVE {SPARSE}, {_least_sql('b', 'SELECT 0::BIGINT AS node, 0 AS level', 'SELECT src, dst, 1 AS w FROM sg', 'level')} SELECT node, level FROM b")
def _(spark, sf):
    return graph_analytics.bfs(sparse(spark, sf), 0)


@query("graph_cc", f"WITH RECURSIVE {E}, {KNN}, un AS (SELECT src AS a, dst AS b FROM knn WHERE rank < 1 UNION SELECT dst, src FROM knn WHERE rank < 1), r AS (SELECT DISTINCT a AS node, a AS far FROM un UNION SELECT r.node, un.b FROM r JOIN un ON un.a = r.far) SELECT node, min(far) AS component FROM r GROUP BY node")
def _(spark, sf):
    return graph_analytics.components(graph_build.knn_graph(base(spark, sf), 1))


@query("graph_cc_trade", f"WITH RECURSIVE {TRADE}, un AS MATERIALIZED (SELECT src AS a, dst AS b FROM tr UNION SELECT dst, src FROM tr), r(node, component) USING KEY (node) AS (SELECT DISTINCT a AS node, a AS component FROM un UNION SELECT un.b, min(r.component) FROM r JOIN un ON un.a = r.node JOIN recurring.r o ON o.node = un.b WHERE r.component < o.component GROUP BY un.b) SELECT node, component FROM r")
def _(spark, sf):
    """Components over all orders."""
    return graph_analytics.components(trade(spark, sf))


RANK_ROUNDS = 5
PAGERANK = f"WITH {E}, {KNN}, sg AS (SELECT src, dst FROM knn WHERE rank < 4), nodes AS (SELECT src AS node FROM sg UNION SELECT dst FROM sg), deg AS (SELECT src, count(*) AS d FROM sg GROUP BY src), n AS (SELECT count(*)::DOUBLE AS n FROM nodes), r0 AS (SELECT node, 1.0::DOUBLE / n AS rank FROM nodes, n)" + "".join(
    f", r{i} AS MATERIALIZED (SELECT nodes.node, 0.15 / n + 0.85::DOUBLE * (coalesce(g.got, 0) + (SELECT coalesce(sum(rank), 0) FROM r{i - 1} LEFT JOIN deg ON deg.src = node WHERE d IS NULL) / n) AS rank FROM nodes CROSS JOIN n LEFT JOIN (SELECT sg.dst, sum(r.rank / deg.d) AS got FROM sg JOIN r{i - 1} r ON r.node = sg.src JOIN deg ON deg.src = sg.src GROUP BY sg.dst) g ON g.dst = nodes.node)"
    for i in range(1, RANK_ROUNDS + 1)
)


@query("graph_pagerank", f"{PAGERANK} SELECT node, round(rank, 9) AS rank FROM r{RANK_ROUNDS}")
def _(spark, sf):
    return graph_analytics.pagerank(sparse(spark, sf), RANK_ROUNDS).select("node", F.round("rank", 9).alias("rank"))


for _w, _zero, _name in (("w", "0::BIGINT", "graph_sssp"), ("dist", "0::DOUBLE", "graph_sssp_float")):
    _sql = f"WITH RECURSIVE {SPARSE}, {_least_sql('d', f'SELECT 0::BIGINT AS node, {_zero} AS far', f'SELECT src, dst, {_w} AS w FROM sg', 'far')}"
    query(_name, f"{_sql} SELECT node, {'far' if _w == 'w' else 'round(far, 6)'} AS dist FROM d")(
        lambda spark, sf, w=_w: graph_analytics.sssp(sparse(spark, sf), 0, F.col(w)).select("node", (F.col("dist") if w == "w" else F.round("dist", 6)).alias("dist"))
    )


# -- arrays ----------------------------------------------------------------------------------------------------
@query("array_vectoradd", f"WITH {E} SELECT id, round(list_sum(list_transform(range(1, {DIM} + 1), lambda i: abs(v[i] + v[{DIM} + 1 - i]))), 6) AS l1 FROM e")
def _(spark, sf):
    added = base(spark, sf).select("id", arrays.vector_add(F.col("v"), F.reverse("v")).alias("s"))
    return added.select("id", F.round(F.aggregate("s", F.lit(0.0), lambda a, x: a + F.abs(x)), 6).alias("l1"))


@query("array_reduction", "SELECT l_returnflag, count(*) AS n, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS quantity, min(l_extendedprice) AS least, max(l_extendedprice) AS most FROM lineitem GROUP BY l_returnflag")
def _(spark, sf):
    return table(spark, sf, "lineitem").groupBy("l_returnflag").agg(F.count("*").alias("n"), F.sum(F.col("l_quantity").cast("long")).alias("quantity"), F.min("l_extendedprice").alias("least"), F.max("l_extendedprice").alias("most"))


@query("array_scan", "SELECT o_orderkey, CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) OVER (ORDER BY o_orderkey) AS BIGINT) AS running FROM orders")
def _(spark, sf):
    return arrays.prefix_sum(table(spark, sf, "orders"), "o_orderkey", F.round(F.col("o_totalprice") * 100).cast("long"), 4096).select("o_orderkey", "running")


@query("array_point_lookup", "SELECT e.event_id, o.o_orderkey, o.o_custkey FROM events e JOIN orders o ON o.o_orderkey = e.user_id")
def _(spark, sf):
    wanted = table(spark, sf, "events").select("event_id", F.col("user_id").alias("o_orderkey"))
    return wanted.join(table(spark, sf, "orders").select("o_orderkey", "o_custkey"), "o_orderkey").select("event_id", "o_orderkey", "o_custkey")


@query("array_block_access", "SELECT o_orderkey // 512 AS block, count(*) AS n, max(o_custkey) AS last FROM orders WHERE o_orderkey >= 1024 AND o_orderkey < 3072 GROUP BY 1")
def _(spark, sf):
    rows = arrays.block_read(table(spark, sf, "orders"), "o_orderkey", 2, 4, 512)
    return rows.groupBy(F.floor(F.col("o_orderkey") / 512).cast("long").alias("block")).agg(F.count("*").alias("n"), F.max("o_custkey").alias("last"))


@query("upsert_latest_wins", "WITH c AS (SELECT user_id, event_id, event_type, 0 AS fresh FROM events UNION ALL SELECT user_id, event_id, upper(event_type), 1 FROM events WHERE event_id % 3 = 0) SELECT user_id, event_id, event_type FROM c QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC, fresh DESC) = 1")
def _(spark, sf):
    """All events are the base, a third of them is changed."""
    e = table(spark, sf, "events").select("user_id", "event_id", "event_type")
    return arrays.upsert(e, e.where("event_id % 3 = 0").withColumn("event_type", F.upper("event_type")), ["user_id"], ["event_id"])


ZIPF = "WITH m AS (SELECT k + 1 AS key, power(k + 1, -0.5) AS m FROM range(0, 100) t(k)), c AS (SELECT key, (sum(m) OVER (ORDER BY key)) / (SELECT sum(m) FROM m) AS c FROM m), d AS (SELECT i, ((i * 7919 + 13) % 10000) / 10000.0::DOUBLE AS u FROM range(0, 10000) t(i))"
query("zipf_access_hist", f"{ZIPF}, x AS (SELECT i, least((SELECT count(*) FROM c WHERE c.c <= d.u) + 1, 100) AS key FROM d) SELECT key, count(*) AS n FROM x GROUP BY key")(lambda spark, sf: arrays.zipf_keys(spark, 10_000, 100, 0.5).groupBy("key").agg(F.count("*").alias("n")))


# -- scalar helpers ------------------------------------------------------------------------------------------------
_OPTS = "o AS (SELECT c.candidates, b AS bit, round(32.0 * power(2, b) / (c.candidates * 12.897) * ln(2)) AS k, 32.0 * power(2, b) / (c.candidates * 12.897) AS r FROM c, range(1, 12) t(b)), p AS (SELECT *, power(1 - exp(-k / r), k) AS p FROM o), w AS (SELECT *, row_number() OVER (PARTITION BY candidates ORDER BY CASE WHEN p < 0.03 THEN bit ELSE 1000 - bit END) AS n FROM p)"


@query("bloom_autotune", f"WITH c AS (SELECT CAST(power(2, i) AS BIGINT) AS candidates FROM range(4, 11) t(i)), {_OPTS} SELECT candidates, CAST(power(2, bit) AS INTEGER) AS words, CAST(bit AS INTEGER) AS log2_words, CAST(k AS INTEGER) AS hashes, round(p, 6) AS p FROM w WHERE n = 1")
def _(spark, sf):
    c = spark.range(4, 11).select(F.pow(F.lit(2), F.col("id")).cast("long").alias("candidates"))
    o = c.select("candidates", bloom.visited_filter(F.col("candidates")).alias("o"))
    return o.select("candidates", "o.words", "o.log2_words", "o.hashes", F.round("o.p", 6).alias("p"))


@query(
    "bloom_algebra",
    "WITH g AS (SELECT i AS n, 0.01 * (1 + i % 5) AS p, 1024.0 * (1 + i % 7) AS m, 3.0 + i % 4 AS k FROM range(100, 200) t(i)) SELECT n, ceil(n * ln(p) / (-ln(2) * ln(2))) AS size, ceil(m * (-ln(2) * ln(2)) / ln(p)) AS capacity, round(power(1 - exp(-k / (m / n)), k), 9) AS rate, ceil(m / (-k / ln(1 - exp(ln(p) / k)))) AS capacity_k, ceil(n * (-k / ln(1 - exp(ln(p) / k)))) AS size_k FROM g",
)
def _(spark, sf):
    i = F.col("id")
    g = spark.range(100, 200).select(i.alias("n"), (F.lit(0.01) * (1 + i % 5)).alias("p"), (F.lit(1024.0) * (1 + i % 7)).alias("m"), (F.lit(3.0) + i % 4).alias("k"))
    n, p, m, k = (F.col(x) for x in "npmk")
    return g.select("n", bloom.size_for(n, p).cast("double").alias("size"), bloom.capacity_for(m, p).cast("double").alias("capacity"), F.round(bloom.false_positives(k, bloom.bits_per_item(m, n)), 9).alias("rate"), bloom.capacity_with(k, m, p).cast("double").alias("capacity_k"), bloom.size_with(k, n, p).cast("double").alias("size_k"))


@query(
    "int_math_utils",
    "SELECT i AS n, i // 7 AS div_down, (i + 6) // 7 AS div_up, i // 7 * 7 AS round_down, (i + 6) // 7 * 7 AS round_up, i * i * i AS cubed, CAST(length(bin(i)) - 1 AS INTEGER) AS log2, CAST(bit_count(i) AS INTEGER) AS bits, bit_count(i) = 1 AS is_pow2, CAST(power(2, length(bin(i))) AS BIGINT) AS next_pow2, CAST(length(bin(i & -i)) AS INTEGER) AS first_set, least(i, 500) AS low, greatest(i, 500) AS high FROM range(1, 3000) t(i)",
)
def _(spark, sf):
    n, seven = F.col("id"), F.lit(7)
    return spark.range(1, 3000).select(
        n.alias("n"), integers.div_down(n, seven).alias("div_down"), integers.div_up(n, seven).alias("div_up"), integers.round_down(n, seven).alias("round_down"),
        integers.round_up(n, seven).alias("round_up"), integers.power(n, 3).alias("cubed"), integers.log_two(n).alias("log2"), integers.bit_count(n).alias("bits"),
        integers.is_power_of_two(n).alias("is_pow2"), integers.next_power_of_two(n).alias("next_pow2"), integers.first_set_bit(n).alias("first_set"),
        F.least(n, F.lit(500).cast("long")).alias("low"), F.greatest(n, F.lit(500).cast("long")).alias("high"),
    )


@query("stream_assign", f"{IVF} SELECT id AS vec_id, cell, round(cell_dist, 6) AS dist FROM a")
def _(spark, sf):
    """Vectors arrive as a stream, are assigned once, and the stream's output is read back."""
    import uuid

    from nearframe.sources.staging import shared_dir
    from nearframe.streaming.assign import assign_stream, read_stream, run_available

    out = f"{shared_dir(spark)}/nearframe-stream-{uuid.uuid4().hex[:12]}"
    centres = qz.first_rows(base(spark, sf), NLIST)
    src = f"{sf}/embeddings.parque[t]"  # a pattern takes a file as well as a folder
    run_available(assign_stream(read_stream(spark, src), centres), f"{out}/rows", f"{out}/checkpoint")
    done = spark.read.schema("vec_id long, cell long, dist double").parquet(f"{out}/rows")
    return done.select("vec_id", "cell", F.round("dist", 6).alias("dist"))


@query("dump_load_graph", f"WITH {E}, {KNN} SELECT src, CAST(rank AS BIGINT) AS slot, dst FROM knn WHERE rank < 8")
def _(spark, sf):
    """Writes a graph as a table clustered by source, and loads its first eight slots again."""
    import uuid

    from nearframe.sources.staging import shared_dir
    from nearframe.sources.tables import dump_graph, load_graph

    path = f"{shared_dir(spark)}/nearframe-graph-{uuid.uuid4().hex[:12]}"
    g = graph_build.knn_graph(base(spark, sf), CANDIDATES).select("src", F.col("rank").cast("long").alias("slot"), "dst")
    dump_graph(g, path)
    return load_graph(spark, path, 8)


@query("write_read_integrity", "SELECT count(*) AS rows, 0::BIGINT AS differing FROM supplier")
def _(spark, sf):
    import uuid

    from nearframe.sources.staging import shared_dir
    from nearframe.sources.tables import written_back

    again, differing = written_back(table(spark, sf, "supplier"), f"{shared_dir(spark)}/nearframe-check-{uuid.uuid4().hex[:12]}")
    return again.agg(F.count("*").alias("rows")).withColumn("differing", F.lit(differing).cast("long"))


def _path(spark: SparkSession, name: str) -> str:
    import uuid

    from nearframe.sources.staging import shared_dir

    return f"{shared_dir(spark)}/nearframe-{name}-{uuid.uuid4().hex[:12]}"


@query("vector_file_round_trip", f"WITH {E} SELECT id AS vec_id, len(v) AS dim, round(list_sum(v), 6) AS total FROM e")
def _(spark, sf):
    """Vectors written in blocks of .fvecs records and read again."""
    from nearframe.sources import vecs

    path = _path(spark, "vecs")
    dense = table(spark, sf, "embeddings").select("vec_id", "embedding")
    vecs.write(dense, path, "fvecs")
    back = vecs.read_written(spark, path, "fvecs")
    return back.select("vec_id", F.size("embedding").cast("long").alias("dim"), F.round(F.aggregate(F.col("embedding").cast("array<double>"), F.lit(0.0), lambda a, x: a + x), 6).alias("total"))


@query("subgraph_dump_with_ids", f"WITH {E}, {KNN} SELECT src, CAST(rank AS BIGINT) AS slot, dst FROM knn WHERE rank < 8 AND src % 5 = 0 AND dst % 5 = 0")
def _(spark, sf):
    """The part of the graph among every fifth vertex, under local ids, dumped with its own ids and loaded."""
    from nearframe.sources.tables import dump_subgraph, load_edges

    ids = base(spark, sf).where("id % 5 = 0").select((F.col("id") / 5).cast("long").alias("local"), "id")
    g = stage(graph_build.knn_graph(base(spark, sf), 8).where("src % 5 = 0 and dst % 5 = 0"))
    local = g.select((F.col("src") / 5).cast("long").alias("src"), F.col("rank").cast("long").alias("slot"), (F.col("dst") / 5).cast("long").alias("dst"))
    path = _path(spark, "part")
    dump_subgraph(local, ids, path)
    return load_edges(spark, path).where("weight = 1").select("src", "slot", "dst")


@query("edge_arrays_split", f"WITH {E}, {KNN} SELECT src, CAST(rank AS BIGINT) AS slot, dst, round(dist, 6) AS weight FROM knn WHERE rank < 4")
def _(spark, sf):
    """Targets and weights written apart and put together again by edge number."""
    from nearframe.sources.tables import split_edges

    path = _path(spark, "edges")
    split_edges(graph_build.knn_graph(base(spark, sf), 4).select("src", F.col("rank").cast("long").alias("slot"), "dst", F.col("dist").alias("weight")), path)
    return spark.read.parquet(f"{path}/dst").join(spark.read.parquet(f"{path}/val"), ["src", "slot"]).select("src", "slot", "dst", F.round("weight", 6).alias("weight"))


@query("graph_accessors", f"WITH {GRAPH} SELECT e.id AS src, CAST(count(fin.dst) AS INTEGER) AS degree, coalesce(string_agg(fin.dst, ',' ORDER BY fin.slot), '') AS nbrs FROM e LEFT JOIN fin ON fin.src = e.id WHERE e.id % 100 = 0 GROUP BY e.id")
def _(spark, sf):
    from nearframe.sources.tables import neighbours

    found = neighbours(final_graph(spark, sf), asked(base(spark, sf)).select(F.col("q").alias("id")))
    return found.select("src", "degree", F.array_join(F.col("nbrs").cast("array<string>"), ",").alias("nbrs"))


@query("block_write_dump", "SELECT c_custkey AS key, b AS block, upper(substr(hex(encode(c_name)), b * 16 + 1, 16)) AS data FROM customer, range(1, 3) t(b) WHERE length(c_name) > b * 8")
def _(spark, sf):
    """Names written as blocks of eight bytes; the second and third block of each, dumped as text."""
    from nearframe.sources.tables import dump_blocks, write_blocks

    path = _path(spark, "blocks")
    write_blocks(table(spark, sf, "customer"), path, "c_custkey", "c_name", 8)
    return dump_blocks(spark, path, 1, 2, ascii_=True).select("key", F.col("block").cast("long").alias("block"), "data")


@query("array_random_blocks", "WITH w AS (SELECT DISTINCT (i * 7919 + 13) % 60 AS block FROM range(0, 20) t(i)) SELECT o_orderkey // 64 AS block, count(*) AS n, max(o_custkey) AS last FROM orders JOIN w ON w.block = o_orderkey // 64 GROUP BY 1")
def _(spark, sf):
    wanted = spark.range(20).select(((F.col("id") * 7919 + 13) % 60).alias("block"))
    return arrays.block_pick(table(spark, sf, "orders"), "o_orderkey", wanted, 64).groupBy("block").agg(F.count("*").alias("n"), F.max("o_custkey").alias("last"))


@query("bounded_cache_hits", "SELECT user_id % 7 AS slot_class, count(*) AS accesses, CAST(sum(CASE WHEN hit THEN 1 ELSE 0 END) AS BIGINT) AS hits FROM (SELECT user_id, coalesce(lag(user_id) OVER (PARTITION BY user_id % 64 ORDER BY event_id) = user_id, FALSE) AS hit FROM events) GROUP BY 1")
def _(spark, sf):
    """Pages are users, accessed by events in order, with a cache of 64 pages."""
    e = arrays.cache_hits(table(spark, sf, "events").select("event_id", "user_id"), "event_id", "user_id", 64)
    return e.groupBy((F.col("user_id") % 7).alias("slot_class")).agg(F.count("*").alias("accesses"), F.sum(F.col("hit").cast("long")).alias("hits"))


@query("metric_averages", "SELECT event_type, hour(ts) AS hour, round(avg(value), 6) AS value FROM events GROUP BY 1, 2")
def _(spark, sf):
    log = table(spark, sf, "events").select("event_type", F.hour("ts").cast("long").alias("hour"), "value")
    return arrays.metric_averages(log, ["event_type", "hour"], ["value"]).withColumn("value", F.round("value", 6))


@query("total_time", "SELECT user_id, min(event_id) AS entry, CAST(count(*) - 1 AS BIGINT) AS steps, min(event_id) + CAST(count(*) - 1 AS BIGINT) AS total FROM events GROUP BY user_id")
def _(spark, sf):
    """A total as the sum of an entry part and a search part, a column of each."""
    parts = table(spark, sf, "events").groupBy("user_id").agg(F.min("event_id").alias("entry"), (F.count("*") - 1).alias("steps"))
    return parts.withColumn("total", F.col("entry") + F.col("steps"))


@query(
    "compare_swap",
    "SELECT i AS n, least(i, i * 7 % 1000) AS low, greatest(i, i * 7 % 1000) AS high, CASE WHEN i % 3 = 0 THEN -i ELSE i END AS assigned, i < i * 7 % 1000 AS lt, i > i * 7 % 1000 AS gt, i = i * 7 % 1000 AS eq, i * 0 AS zero, CAST(power(2, i % 40) AS BIGINT) AS pow2 FROM range(0, 2000) t(i)",
)
def _(spark, sf):
    a, b = F.col("id"), F.col("id") * 7 % 1000
    low, high = integers.swap_if(a > b, a, b)
    return spark.range(2000).select(
        a.alias("n"), low.alias("low"), high.alias("high"), integers.assign_if(a % 3 == 0, a, -a).alias("assigned"), (a < b).alias("lt"), (a > b).alias("gt"), (a == b).alias("eq"),
        (a * 0).alias("zero"), integers.power_of_two(a % 40).alias("pow2"),
    )


@query("windowed_counts", "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M') AS hour, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def _(spark, sf):
    """The streaming aggregation on a finished table: every hour is closed, none is late."""
    from nearframe.streaming.assign import windowed_counts

    found = windowed_counts(table(spark, sf, "events"))
    return found.select(F.date_format("window.start", "yyyy-MM-dd HH:mm").alias("hour"), "event_type", "n", F.round("total", 4).alias("total"))


@query("kept_table", "SELECT s_nationkey, count(*) AS n, count(DISTINCT s_suppkey) AS suppliers FROM supplier GROUP BY 1")
def _(spark, sf):
    """Two aggregations of one persisted table."""
    from nearframe.sources.tables import keep

    s = keep(table(spark, sf, "supplier"))
    return s.groupBy("s_nationkey").agg(F.count("*").alias("n")).join(s.groupBy("s_nationkey").agg(F.count_distinct("s_suppkey").alias("suppliers")), "s_nationkey")


@query("neighbour_selection", f"WITH {GRAPH} SELECT 'simple' AS how, src, dst FROM knn WHERE rank < {DEGREE} UNION ALL SELECT 'heuristic', src, dst FROM pr")
def _(spark, sf):
    """Simple selection takes the nearest, heuristic selection those of fewest detours."""
    knn = edges(spark, sf)
    found = [graph_build.select_neighbours(knn, DEGREE, how).select(F.lit(how).alias("how"), "src", "dst") for how in ("simple", "heuristic")]
    return found[0].union(found[1])
