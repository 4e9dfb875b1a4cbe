"""Indexes, sources, sinks, streams and the benchmark harness."""

from __future__ import annotations

import re
import uuid

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from vectorloom.operators import exact, graphs, ivf, kmeans, neighbors, quantizers, stats, tiered
from vectorloom.operators.blocks import vectors_of
from vectorloom.plans import harness
from vectorloom.queries.inputs import CENTERS, D, K, cte, data, label_means, queries, rounded, sq, sql_rounded, topk
from vectorloom.queries.neighbors import EXACT
from vectorloom.registry import register
from vectorloom.runtime import cut_lineage, ensure_checkpoint_dir
from vectorloom.sources import binary, catalog
from vectorloom.streaming import extend as streams


def scratch(spark, name: str) -> str:
    """A new folder in the shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


PROBES = 3
_LISTS = f"placed AS (SELECT id, v, label, c FROM data, centers QUALIFY row_number() OVER (PARTITION BY id ORDER BY {sq('v', 'cv')}, c) = 1), probes AS (SELECT query_id, qv, c FROM q, centers QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY {sq('qv', 'cv')}, c) <= {PROBES})"
_BASE = f"WITH {cte('scaled')}, {CENTERS}, {_LISTS}"
_PROBED = f"(SELECT query_id, id, {sq('qv', 'v')} AS distance FROM probes JOIN placed USING (c))"


_L1 = "(SELECT query_id, id, list_sum(list_transform(list_zip(qv, v), lambda p: abs(p[1] - p[2]))) AS distance FROM q, data)"


def _flat(spark, sf_dir, **args):
    rows = data(spark, sf_dir, "scaled")
    return rows, ivf.build_flat(rows, centers=label_means(rows), **args)


@register("ivf_flat_search", f"{_BASE} {sql_rounded(topk(_PROBED))}")
def ivf_flat_search(spark, sf_dir):
    """The three nearest of ten fixed lists."""
    rows, ix = _flat(spark, sf_dir)
    return rounded(ix.search(queries(rows), K, PROBES))


@register("ivf_flat_all_lists", EXACT)
def ivf_flat_all_lists(spark, sf_dir):
    """With all lists probed a trained index is exact."""
    rows = data(spark, sf_dir, "scaled")
    return rounded(ivf.build_flat(rows, 16).search(queries(rows), K, 16))


@register("ivf_flat_filtered", f"{_BASE} {sql_rounded(topk(_PROBED.replace('USING (c)', 'USING (c) WHERE label IN (1, 3, 5, 7)')))}")
def ivf_flat_filtered(spark, sf_dir):
    rows, ix = _flat(spark, sf_dir)
    return rounded(ix.search(queries(rows), K, PROBES, rows.where(F.col("label").isin(1, 3, 5, 7)).select("id")))


@register("ivf_flat_inner_product", f"WITH {cte('scaled')}, {CENTERS}, placed AS (SELECT id, v, c FROM data, centers QUALIFY row_number() OVER (PARTITION BY id ORDER BY list_dot_product(v, cv) DESC, c) = 1), probes AS (SELECT query_id, qv, c FROM q, centers QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY list_dot_product(qv, cv) DESC, c) <= {PROBES}) {sql_rounded(topk('(SELECT query_id, id, list_dot_product(qv, v) AS distance FROM probes JOIN placed USING (c))', K, 'distance DESC'))}")
def ivf_flat_inner_product(spark, sf_dir):
    rows, ix = _flat(spark, sf_dir, metric="inner_product")
    return rounded(ix.search(queries(rows), K, PROBES))


@register("ivf_flat_custom_metric", f"WITH {cte('scaled')} {sql_rounded(topk(_L1))}")
def ivf_flat_custom_metric(spark, sf_dir):
    """A metric of one's own (sums of absolute differences) over all lists."""
    rows = data(spark, sf_dir, "scaled")
    metric = lambda x, y: np.abs(x[:, None, :] - y[None, :, :]).sum(2)
    return rounded(ivf.build_flat(rows, 8, metric).search(queries(rows), K, 8))


@register("ivf_flat_extend", f"{_BASE} {sql_rounded(topk(_PROBED))}")
def ivf_flat_extend(spark, sf_dir):
    """Half of the rows at build, the others later."""
    rows = data(spark, sf_dir, "scaled")
    ix = ivf.build_flat(rows.where(F.col("label") < 5), centers=label_means(rows)).extend(rows.where(F.col("label") >= 5))
    return rounded(ix.search(queries(rows), K, PROBES))


@register("ivf_flat_adaptive_centers", f"{_BASE}, cells1 AS (SELECT c, unnest(range(1, len(v) + 1)) AS i, unnest(v) AS x FROM placed) SELECT c AS list_id, CAST(i AS INT) AS i, round(avg(x), 6) + 0.0 AS x FROM cells1 GROUP BY c, i")
def ivf_flat_adaptive_centers(spark, sf_dir):
    """Centres that follow the rows of their lists."""
    _, ix = _flat(spark, sf_dir)
    moved = spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(ix.recentered().centers)], "list_id int, v array<double>")
    return moved.select("list_id", F.posexplode("v").alias("i", "x")).select("list_id", (F.col("i") + 1).alias("i"), (F.round("x", 6) + 0.0).alias("x"))


@register("ivf_flat_list_sizes", f"{_BASE} SELECT c AS list_id, count(*) AS size FROM placed GROUP BY c")
def ivf_flat_list_sizes(spark, sf_dir):
    return _flat(spark, sf_dir)[1].list_sizes()


@register("ivf_flat_list_range", f"{_BASE} SELECT c AS list_id, id FROM placed WHERE c = 3 QUALIFY row_number() OVER (ORDER BY id) BETWEEN 3 AND 7")
def ivf_flat_list_range(spark, sf_dir):
    """Five rows of a list from an offset: range access is the feature."""
    return _flat(spark, sf_dir)[1].list_rows(3, 2, 5).select("list_id", "id")


@register("ivf_flat_list_surgery", f"{_BASE} SELECT c AS list_id, count(*) AS size FROM placed WHERE c <> 4 GROUP BY c UNION ALL SELECT 4, count(*) FROM data WHERE label = 2 HAVING count(*) > 0")
def ivf_flat_list_surgery(spark, sf_dir):
    """A list erased and filled again with chosen rows."""
    rows, ix = _flat(spark, sf_dir)
    return ix.erase_list(4).extend_list(4, rows.where("label = 2")).list_sizes()


@register("ivf_flat_store", f"{_BASE} {sql_rounded(topk(_PROBED))}")
def ivf_flat_store(spark, sf_dir):
    """Saved, loaded, searched."""
    rows, ix = _flat(spark, sf_dir)
    path = scratch(spark, "ivf")
    ix.save(path)
    return rounded(ivf.IvfFlat.load(spark, path).search(queries(rows), K, PROBES))


_CELLS = "cells1 AS (SELECT id, c, i, v[i] - cv[i] AS r FROM placed JOIN centers USING (c), range(1, 65) t(i)), lim AS (SELECT i, min(r) - 0.05 * (max(r) - min(r)) AS lo, (max(r) - min(r)) * 1.1 / 255 AS st FROM cells1 GROUP BY i), dec AS (SELECT id, c, list(cv[i] + lo + greatest(0, least(255, round_even((r - lo) / st, 0))) * st ORDER BY i) AS m FROM cells1 JOIN lim USING (i) JOIN centers USING (c) GROUP BY id, c)"


@register("ivf_sq_search", f"{_BASE}, {_CELLS} {sql_rounded(topk(f'(SELECT query_id, id, {sq("qv", "m")} AS distance FROM probes JOIN dec USING (c))'), 5)}")
def ivf_sq_search(spark, sf_dir):
    """Eight bits per component of the residuals."""
    rows = data(spark, sf_dir, "scaled")
    ix = ivf.build_sq(rows, centers=label_means(rows), max_train_points_per_cluster=1_000_000)
    return rounded(ix.search(queries(rows), K, PROBES), 5)


_PQ = f"""books AS (SELECT s, c AS code, cv[s * 8 + 1 : s * 8 + 8] AS b FROM centers, range(8) t(s)),
res AS (SELECT id, placed.c, s, list_transform(list_zip(v[s * 8 + 1 : s * 8 + 8], cv[s * 8 + 1 : s * 8 + 8]), lambda p: p[1] - p[2]) AS r FROM placed JOIN centers USING (c), range(8) t(s)),
coded AS (SELECT id, res.c, s, code, b FROM res JOIN books USING (s) QUALIFY row_number() OVER (PARTITION BY id, s ORDER BY {sq('r', 'b')}, code) = 1),
lut AS (SELECT query_id, probes.c, s, code, {sq('list_transform(list_zip(qv[s * 8 + 1 : s * 8 + 8], cv[s * 8 + 1 : s * 8 + 8]), lambda p: p[1] - p[2])', 'b')} AS d FROM probes JOIN centers USING (c), books)"""
_PQ_PAIRS = "(SELECT query_id, id, sum(d) AS distance FROM lut JOIN coded USING (c, s, code) GROUP BY query_id, id)"


def _pq(spark, sf_dir, **args):
    rows = data(spark, sf_dir, "scaled")
    means = label_means(rows)
    books = np.stack([means[:, s * 8 : s * 8 + 8] for s in range(8)])
    return rows, ivf.build_pq(rows, centers=means, codebooks=books, pq_dim=8, pq_bits=4, rotation=np.eye(64), **args)


@register("ivf_pq_precomputed", f"{_BASE}, {_PQ} {sql_rounded(topk(_PQ_PAIRS), 5)}")
def ivf_pq_precomputed(spark, sf_dir):
    """Given centres, codebooks and rotation: nothing is trained."""
    rows, ix = _pq(spark, sf_dir)
    return rounded(ix.search(queries(rows), K, PROBES), 5)


@register("ivf_pq_transform", f"{_BASE}, {_PQ} SELECT id, c AS list_id, CAST(s AS INT) AS s, code FROM coded")
def ivf_pq_transform(spark, sf_dir):
    rows, ix = _pq(spark, sf_dir)
    codes = ix.transform(rows)
    return codes.select("id", "list_id", F.explode(F.sequence(F.lit(0), F.lit(7))).alias("s"), "codes").select("id", "list_id", "s", F.conv(F.hex(F.substring("codes", F.col("s") + 1, F.lit(1))), 16, 10).cast("int").alias("code"))


@register("ivf_pq_reconstruct", f"{_BASE}, {_PQ} SELECT id, round(sum({sq('r', 'b')}), 5) AS loss FROM coded JOIN res USING (id, c, s) GROUP BY id")
def ivf_pq_reconstruct(spark, sf_dir):
    """Squared distance of every row to what its codes stand for."""
    rows, ix = _pq(spark, sf_dir)
    back = ix.reconstruct(ix.lists).withColumnRenamed("vector", "b")
    return vectors_of(rows).join(back, "id").select("id", F.round(F.aggregate(F.zip_with("vector", "b", lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda a, v: a + v), 5).alias("loss"))


@register("ivf_pq_list_codes", f"{_BASE} SELECT c AS list_id, count(*) + CASE WHEN c = 0 THEN (SELECT count(*) FROM placed WHERE c = 1) ELSE 0 END AS size FROM placed GROUP BY c")
def ivf_pq_list_codes(spark, sf_dir):
    """Codes of one list appended to another without classification."""
    _, ix = _pq(spark, sf_dir)
    return ix.extend_list_with_codes(0, ix.list_rows(1).select("id", "codes")).list_sizes()


#: what judged() gives for a search that is good enough
JUDGED = f"WITH {cte()} SELECT query_id, least({K}, (SELECT count(*) FROM data)) AS n, true AS ranked, true AS distances_hold, true AS recall_holds FROM q"


def judged(found, rows, allow=None, exact: bool = True, least: float = 0.9):
    """One row for every query of an approximate search, for which SQL can state what must hold.

    n: its results, ranked: ranks run from 1 and ids are distinct, distances_hold: with exact, distances are those
    of the vectors; recall_holds: the whole search finds at least the share least of the exact neighbours.
    """
    found = cut_lineage(found)
    truth = neighbors.knn(queries(rows), rows, K, allow=allow)
    recall = stats.recall(found, truth, K).first()[0]
    v = vectors_of(rows)
    met = found.join(v.select(F.col("id").alias("query_id"), F.col("vector").alias("x")), "query_id").join(v, "id")
    true = F.aggregate(F.zip_with("x", "vector", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda a, b: a + b)
    holds = F.abs(F.col("distance") - true) <= 1e-9 * (1 + true) if exact else F.col("distance").isNotNull()
    n = F.count(F.lit(1))
    return met.groupBy("query_id").agg(n.alias("n"), ((F.count_distinct("id") == n) & (F.min("rank") == 1) & (F.max("rank") == n)).alias("ranked"), F.every(holds).alias("distances_hold")).withColumn("recall_holds", F.lit(bool(recall >= least)))


@register("ivf_pq_search", JUDGED)
def ivf_pq_search(spark, sf_dir):
    """A trained index, its codes alone."""
    rows = data(spark, sf_dir)
    return judged(ivf.build_pq(rows, 16, pq_dim=64).search(queries(rows), K, 15), rows, exact=False)


@register("ivf_pq_refined", JUDGED)
def ivf_pq_refined(spark, sf_dir):
    """Quantised candidates in exact order."""
    rows = data(spark, sf_dir)
    found = ivf.build_pq(rows, 16, pq_dim=32).search(queries(rows), 8 * K, 14)
    return judged(neighbors.refine(rows, queries(rows), found, K), rows)


@register("ivf_pq_per_cluster", JUDGED)
def ivf_pq_per_cluster(spark, sf_dir):
    """Codebooks by list, distances in half precision, candidates in exact order."""
    rows = data(spark, sf_dir)
    found = ivf.build_pq(rows, 8, pq_dim=32, pq_bits=6, codebook_kind="cluster", lut_dtype="float16").search(queries(rows), 8 * K, 8)
    return judged(neighbors.refine(rows, queries(rows), found, K), rows)


@register("ivf_rabitq_search", JUDGED)
def ivf_rabitq_search(spark, sf_dir):
    rows = data(spark, sf_dir)
    return judged(ivf.build_rabitq(rows, 16, 7).search(queries(rows), K, 15), rows, exact=False)


@register("scann_build", f"WITH {cte()} SELECT id, true AS in_range, true AS coded FROM data")
def scann_build(spark, sf_dir):
    """Two assignments and codes of every row."""
    codes = ivf.build_scann(data(spark, sf_dir), 16, eta=2.0).codes
    inside = F.col("label").between(0, 15) & F.col("soar_label").between(0, 15)
    return codes.select("id", inside.alias("in_range"), (F.size("codes") == F.size("soar_codes")).alias("coded"))


# graphs

DEGREE = 8


def _graph(rows):
    found = neighbors.knn(rows, rows, DEGREE + 1).where("query_id <> id")
    ranked = neighbors.select_k(found.drop("rank"), DEGREE)
    return cut_lineage(ranked.select(F.col("query_id").alias("src"), "rank", F.col("id").alias("dst")))


_EDGES = f"e AS (SELECT a.id AS src, b.id AS dst, CAST(row_number() OVER (PARTITION BY a.id ORDER BY {sq('a.v', 'b.v')}, b.id) AS INT) AS rank FROM data a, data b WHERE a.id <> b.id QUALIFY row_number() OVER (PARTITION BY a.id ORDER BY {sq('a.v', 'b.v')}, b.id) <= {DEGREE})"
_DETOURS = "detours AS (SELECT x.src, x.dst, x.rank, CAST(count(y.dst) AS INT) AS detours FROM e x LEFT JOIN (SELECT d.src, d.rank, f.dst FROM e d JOIN e f ON f.src = d.dst) y ON y.src = x.src AND y.dst = x.dst AND y.rank < x.rank GROUP BY x.src, x.dst, x.rank)"


@register("cagra_detour_counts", f"WITH {cte('scaled')}, {_EDGES}, {_DETOURS} SELECT * FROM detours")
def cagra_detour_counts(spark, sf_dir):
    return graphs.detour_counts(_graph(data(spark, sf_dir, "scaled"))).select("src", "dst", "rank", "detours")


@register("cagra_optimize", f"WITH {cte('scaled')}, {_EDGES}, {_DETOURS} SELECT src, CAST(row_number() OVER (PARTITION BY src ORDER BY detours, rank) AS INT) AS rank, dst FROM detours QUALIFY row_number() OVER (PARTITION BY src ORDER BY detours, rank) <= 4")
def cagra_optimize(spark, sf_dir):
    return graphs.optimize(_graph(data(spark, sf_dir, "scaled")), 4)


@register("cagra_reverse_edges", f"""WITH {cte('scaled')}, {_EDGES},
both_ways AS (SELECT src, dst, CASE WHEN rank <= 4 THEN 0 ELSE 2 END AS c, rank FROM e UNION ALL SELECT dst, src, 1, rank FROM e),
best AS (SELECT src, dst, min({{'c': c, 'rank': rank}}) AS m FROM both_ways WHERE src <> dst GROUP BY src, dst)
SELECT src, CAST(row_number() OVER (PARTITION BY src ORDER BY m, dst) AS INT) AS rank, dst FROM best QUALIFY row_number() OVER (PARTITION BY src ORDER BY m, dst) <= {DEGREE}""")
def cagra_reverse_edges(spark, sf_dir):
    return graphs.with_reverse(_graph(data(spark, sf_dir, "scaled")), DEGREE)


def _search(name: str, build):
    @register(name, JUDGED)
    def query(spark, sf_dir):
        rows = data(spark, sf_dir)
        return judged(build(rows).search(queries(rows), K), rows)


_search("cagra_search", lambda rows: graphs.build_cagra(rows, intermediate_graph_degree=32, graph_degree=16))
_search("cagra_connected", lambda rows: graphs.build_cagra(rows, intermediate_graph_degree=32, graph_degree=16, guarantee_connectivity=True))
_search("cagra_sharded", lambda rows: graphs.build_cagra(rows, intermediate_graph_degree=32, graph_degree=16, shard_rows=300))
_search("cagra_extend", lambda rows: graphs.build_cagra(rows.where("label < 7"), intermediate_graph_degree=32, graph_degree=16).extend(rows.where("label >= 7")))
_search("cagra_merge", lambda rows: graphs.merge([graphs.build_cagra(rows.where(c), intermediate_graph_degree=32, graph_degree=16) for c in ("label < 5", "label >= 5")]))
_search("hnsw_search", lambda rows: graphs.build_hnsw(rows, M=12))
_search("vamana_search", lambda rows: graphs.build_vamana(rows, graph_degree=16, visited_size=32))


@register("cagra_filtered", JUDGED)
def cagra_filtered(spark, sf_dir):
    rows = data(spark, sf_dir)
    ix = graphs.build_cagra(rows, intermediate_graph_degree=32, graph_degree=16)
    allow = rows.where("label IN (1, 3, 5, 7)").select("id")
    return judged(ix.search(queries(rows), K, itopk_size=128, allow=allow).join(allow, "id", "left_semi"), rows, allow)


@register("cagra_filtered_by_function", JUDGED)
def cagra_filtered_by_function(spark, sf_dir):
    """A predicate over the ids of queries and rows within the search; it gives what a list of ids gives."""
    rows = data(spark, sf_dir)
    ix = graphs.build_cagra(rows, intermediate_graph_degree=32, graph_degree=16)
    allow = rows.where("id % 3 = 1").select("id")
    found = ix.search(queries(rows), K, itopk_size=128, mask=lambda q, i: (i % 3 == 1) & (q >= 0))
    return judged(found.join(allow, "id", "left_semi"), rows, allow)


@register("cagra_from_graph", JUDGED)
def cagra_from_graph(spark, sf_dir):
    rows = data(spark, sf_dir)
    return judged(graphs.from_graph(graphs.with_reverse(_graph(rows), DEGREE), rows).search(queries(rows), K, itopk_size=256), rows)


GRAPH = f"WITH {cte()} SELECT id AS src, 8::BIGINT AS n, true AS no_loops, true AS recall_holds FROM data"


def judged_graph(edges, rows):
    """One row for every row of an approximate graph (src, rank, dst) of 8 neighbours: recall_holds: at least 0.9 of the exact ones."""
    edges = cut_lineage(edges.select("src", "rank", "dst").where("rank <= 8"))
    want = neighbors.knn(rows, rows, 9).where("query_id <> id").withColumn("r", F.row_number().over(Window.partitionBy("query_id").orderBy("rank"))).where("r <= 8")
    met = edges.join(want.select(F.col("query_id").alias("src"), F.col("id").alias("dst")), ["src", "dst"], "left_semi").count()
    good = met >= 0.9 * max(1, 8 * vectors_of(rows).count())
    return edges.groupBy("src").agg(F.count_distinct("dst").alias("n"), F.every(F.col("src") != F.col("dst")).alias("no_loops")).withColumn("recall_holds", F.lit(bool(good)))


@register("cagra_knn_graph", GRAPH)
def cagra_knn_graph(spark, sf_dir):
    """A self-kNN graph by product codes and refinement."""
    rows = data(spark, sf_dir)
    return judged_graph(graphs.knn_graph_ivf_pq(rows, 8, 16, 14, 8, pq_dim=32), rows)


@register("cagra_store", JUDGED)
def cagra_store(spark, sf_dir):
    rows = data(spark, sf_dir)
    path = scratch(spark, "graph")
    graphs.build_cagra(rows, intermediate_graph_degree=32, graph_degree=16).save(path)
    return judged(graphs.GraphIndex.load(spark, path).search(queries(rows), K), rows)


@register("nn_descent", GRAPH)
def nn_descent(spark, sf_dir):
    """Neighbours of neighbours, joined until few edges change."""
    rows = data(spark, sf_dir)
    return judged_graph(graphs.nn_descent(rows, 8, 32, max_iterations=6, sample=16, exact_below=0), rows)


@register("cagra_compressed", JUDGED)
def cagra_compressed(spark, sf_dir):
    """A graph over product-quantised vectors, its candidates in exact order."""
    rows = data(spark, sf_dir)
    ix = graphs.build_cagra(rows, intermediate_graph_degree=32, graph_degree=16).compressed(quantizers.train_pq(rows, 8, 32, use_vq=True, n_iters=8))
    return judged(neighbors.refine(rows, queries(rows), ix.search(queries(rows), 8 * K, itopk_size=128), K), rows)


@register("cagra_renamed", JUDGED)
def cagra_renamed(spark, sf_dir):
    """Results under other ids."""
    rows = data(spark, sf_dir)
    ix = graphs.build_cagra(rows, intermediate_graph_degree=32, graph_degree=16).with_ids(rows.select("id", (F.col("id") + 1_000_000).alias("new_id")))
    return judged(ix.search(queries(rows), K).withColumn("id", F.col("id") - 1_000_000), rows)


@register("exact_index_store", EXACT)
def exact_index_store(spark, sf_dir):
    """An exact index built in two steps, saved and loaded."""
    rows = data(spark, sf_dir, "scaled")
    path = scratch(spark, "exact")
    exact.build_exact(rows.where("label < 4")).extend(rows.where("label >= 4")).save(path)
    return rounded(exact.ExactIndex.load(spark, path).search(queries(rows), K))


@register("composite_index", EXACT)
def composite_index(spark, sf_dir):
    """Two indexes searched as one."""
    rows = data(spark, sf_dir, "scaled")
    parts = [(ivf.build_flat(rows.where(c), 4), 0) for c in ("label < 5", "label >= 5")]
    return rounded(graphs.composite_search(parts, queries(rows), K, n_probes=4))


# tiers and streams


@register("tiered_search", EXACT)
def tiered_search(spark, sf_dir):
    """An approximate tier whose lists are all probed, and newer rows."""
    rows = data(spark, sf_dir, "scaled")
    ix = tiered.build_tiered(rows.where("label < 6"), lambda r: ivf.build_flat(r, 8), min_ann_rows=100)
    return rounded(ix.extend(rows.where("label >= 6")).search(queries(rows), K, n_probes=8))


@register("tiered_compact", EXACT)
def tiered_compact(spark, sf_dir):
    rows = data(spark, sf_dir, "scaled")
    ix = tiered.build_tiered(rows.where("label < 2"), lambda r: ivf.build_flat(r, 8), min_ann_rows=200, create_ann_index_on_extend=True)
    return rounded(ix.extend(rows.where("label >= 2")).search(queries(rows), K, n_probes=8))


@register("tiered_merge", EXACT)
def tiered_merge(spark, sf_dir):
    rows = data(spark, sf_dir, "scaled")
    parts = [tiered.build_tiered(rows.where(c), lambda r: ivf.build_flat(r, 8), min_ann_rows=400) for c in ("label < 5", "label >= 5")]
    return rounded(tiered.merge_tiered(parts).search(queries(rows), K, n_probes=8))


def _stream(spark, sf_dir, name):
    """A table as a stream of its files; the pattern matches a file as well as a folder."""
    path = f"{sf_dir.rstrip('/')}/{name}.parquet"
    return streams.stream_table(spark, f"{path[:-1]}[{path[-1]}]", spark.read.parquet(path).schema)


def _last(spark, result):
    """The last complete result of a streaming aggregation, written by the executors."""
    path = scratch(spark, "result")
    write = lambda batch, _: batch.write.mode("overwrite").parquet(path)
    result.writeStream.outputMode("complete").foreachBatch(write).option("checkpointLocation", scratch(spark, "offsets")).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(path)


@register("stream_extend", EXACT)
def stream_extend(spark, sf_dir):
    """Rows that arrive as a stream, appended and searched as a delta."""
    out, at = scratch(spark, "delta"), scratch(spark, "offsets")
    stream = _stream(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.transform(F.col("embedding").cast(D), lambda x: x * (1 + F.col("label"))).alias("vector"))
    streams.append_to(stream, out, at).awaitTermination()
    rows = data(spark, sf_dir, "scaled")
    return rounded(neighbors.knn(queries(rows), streams.delta(spark, out), K))


@register("stream_search", EXACT)
def stream_search(spark, sf_dir):
    """Queries that arrive as a stream, searched in batches."""
    rows = data(spark, sf_dir, "scaled")
    out, at = scratch(spark, "found"), scratch(spark, "offsets")
    stream = _stream(spark, sf_dir, "embeddings").where("vec_id % 20 = 0").select(F.col("vec_id").alias("id"), F.transform(F.col("embedding").cast(D), lambda x: x * (1 + F.col("label"))).alias("vector"))
    streams.search_stream(stream, lambda b: neighbors.knn(b, rows, K), out, at).awaitTermination()
    return rounded(streams.delta(spark, out))


@register("stream_running_centroids", f"WITH {cte()}, c AS (SELECT label, unnest(range(1, len(v) + 1)) AS i, unnest(v) AS x FROM data) SELECT CAST(label AS INT) AS label, CAST(i AS INT) AS i, max(n) AS size, round(avg(x), 6) + 0.0 AS x FROM c JOIN (SELECT label, count(*) AS n FROM data GROUP BY label) USING (label) GROUP BY label, i")
def stream_running_centroids(spark, sf_dir):
    """Means by label as streaming state."""
    stream = _stream(spark, sf_dir, "embeddings").select(F.col("label").cast("int").alias("label"), F.col("embedding").cast(D).alias("vector"))
    out = _last(spark, streams.running_centroids(stream, 64, "label"))
    return out.select("label", "size", F.posexplode("center").alias("i", "x")).select("label", (F.col("i") + 1).alias("i"), "size", (F.round("x", 6) + 0.0).alias("x"))


@register("stream_event_windows", "SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY date_trunc('hour', ts), event_type")
def stream_event_windows(spark, sf_dir):
    """Tumbling windows over event time."""
    out = _last(spark, streams.event_windows(_stream(spark, sf_dir, "events")))
    return out.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


# sources, sinks, harness


@register("vector_file_round_trip", f"WITH {cte()} SELECT CAST(row_number() OVER (ORDER BY id) - 1 AS BIGINT) AS id, round(list_sum(v), 6) + 0.0 AS total, round(list_sum(list_transform(v, lambda x: x * x)), 6) AS norm2 FROM data")
def vector_file_round_trip(spark, sf_dir):
    """Vectors written as part files with headers, and read again."""
    path = f"{scratch(spark, 'vectors')}.fbin"
    binary.write_vectors(data(spark, sf_dir), path, part_rows=200)
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda a, x: a + x)
    return binary.read_vectors(spark, path).select("id", (F.round(total("vector"), 6) + 0.0).alias("total"), F.round(total(F.transform("vector", lambda x: x * x)), 6).alias("norm2"))


@register("vector_file_subset", f"WITH {cte()} SELECT count(*) AS n, round(sum(list_sum(v)), 5) AS total FROM (SELECT v FROM data ORDER BY id LIMIT 100)")
def vector_file_subset(spark, sf_dir):
    """The first rows of a file: subset reads are a feature of the format."""
    path = f"{scratch(spark, 'vectors')}.fbin"
    binary.write_vectors(data(spark, sf_dir), path)
    return binary.read_vectors(spark, path, subset=100).agg(F.count("id").alias("n"), F.round(F.sum(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x)), 5).alias("total"))


@register("convert_int8", f"WITH {cte()} SELECT id, CAST(list_sum(list_transform(v, lambda x: round_even(x * 127, 0))) AS BIGINT) AS total FROM data")
def convert_int8(spark, sf_dir):
    rows = vectors_of(data(spark, sf_dir)).withColumn("vector", F.transform("vector", lambda x: x * 127))
    return binary.convert(rows, "int8").select("id", F.aggregate("vector", F.lit(0.0), lambda a, x: a + x).cast("long").alias("total"))


@register("convert_half", f"WITH {cte()} SELECT id, len(v) AS dim, true AS near FROM data")
def convert_half(spark, sf_dir):
    """Vectors in half precision: within half a unit of its eleven digits of the ones given."""
    rows = vectors_of(data(spark, sf_dir)).withColumnRenamed("vector", "x")
    met = binary.convert(data(spark, sf_dir), "float16").join(rows, "id")
    near = F.forall(F.zip_with("x", F.col("vector").cast("array<double>"), lambda a, b: F.abs(a - b) <= F.greatest(F.abs(a) * 2.0**-11, F.lit(2.0**-25))), lambda x: x)
    return met.select("id", F.size("x").cast("long").alias("dim"), near.alias("near"))


@register("split_groundtruth", f"WITH {cte('scaled')}, t AS ({topk(f'(SELECT query_id, id, {sq("qv", "v")} AS distance FROM q, data)')}) SELECT query_id, string_agg(id, ',' ORDER BY rank) AS neighbors FROM t GROUP BY query_id")
def split_groundtruth(spark, sf_dir):
    rows = data(spark, sf_dir, "scaled")
    ids, _ = binary.split_groundtruth(harness.ground_truth(queries(rows), rows, K))
    return ids.select("query_id", F.array_join(F.col("neighbors").cast("array<string>"), ",").alias("neighbors"))


@register("pareto_frontier", "WITH r AS (SELECT c_custkey, c_nationkey, c_acctbal AS qps, (c_custkey * 7919 % 1000) / 1000.0::DOUBLE AS recall FROM customer) SELECT c_custkey, c_nationkey, qps, recall FROM r QUALIFY recall > coalesce(max(recall) OVER (PARTITION BY c_nationkey ORDER BY qps DESC, recall DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1)")
def pareto_frontier(spark, sf_dir):
    """Frontiers of a table of points, one for every nation."""
    t = spark.read.parquet(f"{sf_dir.rstrip('/')}/customer.parquet")
    points = t.select("c_custkey", "c_nationkey", F.col("c_acctbal").alias("qps"), (F.pmod(F.col("c_custkey") * 7919, F.lit(1000)) / 1000.0).alias("recall"))
    return harness.pareto(points, "recall", "qps", by="c_nationkey")


@register("benchmark_sweep", "SELECT * FROM (VALUES ('ivf_flat', 1, true, true), ('ivf_flat', 2, true, true)) t(algo, probes, recall_rises, banded)")
def benchmark_sweep(spark, sf_dir):
    """A small grid: recall rises with the probes, to 1 where all lists are probed (times vary and are left out)."""
    rows = data(spark, sf_dir)
    truth = cut_lineage(harness.ground_truth(queries(rows), rows, K))
    found = harness.sweep("ivf_flat", rows, queries(rows), truth, K, {"n_lists": [8]}, {"n_probes": [2, 8]}, 64)
    t = harness.as_table(spark, found).select("algo", "search", "recall", harness.recall_band().alias("band")).collect()
    order = sorted(t, key=lambda r: int(re.search(r"n_probes\D+(\d+)", str(r["search"]))[1]))
    rises = all(a["recall"] <= b["recall"] + 1e-9 for a, b in zip(order, order[1:], strict=False)) and order[-1]["recall"] > 1 - 1e-9
    return spark.createDataFrame([(r["algo"], k, bool(rises), r["band"] is not None or r["recall"] < 0.8) for k, r in enumerate(order, 1)], "algo string, probes int, recall_rises boolean, banded boolean")


@register("benchmark_tune", "SELECT 'ivf_flat' AS algo, 8::BIGINT AS tried, true AS good_enough")
def benchmark_tune(spark, sf_dir):
    """The fastest of eight random configurations that reaches a recall of 0.9."""
    rows = data(spark, sf_dir)
    truth = cut_lineage(harness.ground_truth(queries(rows), rows, K))
    best, tried = harness.tune("ivf_flat", rows, queries(rows), truth, K, {"n_lists": [4, 8]}, {"n_probes": [1, 2, 3, 4, 6, 8]}, 64, trials=8)
    return spark.createDataFrame([("ivf_flat", len(tried), best is not None and best["recall"] >= 0.9)], "algo string, tried long, good_enough boolean")


@register("dataset_catalog", "SELECT * FROM (VALUES ('deep-image-96-angular', 10000000, 96, 'inner_product'), ('fashion-mnist-784-euclidean', 60000, 784, 'euclidean'), ('glove-50-angular', 1100000, 50, 'inner_product'), ('glove-100-angular', 1100000, 100, 'inner_product'), ('mnist-784-euclidean', 60000, 784, 'euclidean'), ('nytimes-256-angular', 290000, 256, 'inner_product'), ('sift-128-euclidean', 1000000, 128, 'euclidean'), ('bigann-100M', 100000000, 128, 'euclidean')) t(name, rows, dim, distance)")
def dataset_catalog(spark, sf_dir):
    """Known benchmark data sets."""
    return catalog.catalog(spark)


@register("blobs_kmeans", "SELECT CAST(b AS INT) AS blob, 200::BIGINT AS n, 1::BIGINT AS labels FROM range(3) t(b)")
def blobs_kmeans(spark, sf_dir):
    """Generated blobs, clustered: every blob is one cluster, and there are three."""
    rows = cut_lineage(binary.blobs(spark, 600, 16, 3, 0.3))
    got = kmeans.predict(rows, kmeans.fit(rows, 3, n_init=2).centroids)
    met = rows.select("id", F.col("label").cast("int").alias("blob")).join(got, "id")
    apart = met.select("label").distinct().count() == 3
    return met.groupBy("blob").agg(F.count(F.lit(1)).alias("n"), (F.count_distinct("label") if apart else F.lit(0).cast("long")).alias("labels"))
