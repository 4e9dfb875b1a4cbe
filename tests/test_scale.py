"""What bounds the work and memory of large tables: pieces that would hold, or fail, at any size."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from vectorloom.operators import blocks, graphs, linkage, neighbors, sparse, stats


def table(spark, m, first=0):
    return spark.createDataFrame([(first + i, v.tolist()) for i, v in enumerate(m)], "id long, vector array<double>")


def brute(q, m, k, root=False):
    d = ((q[:, None, :] - m[None, :, :]) ** 2).sum(2)
    c = np.argsort(d, axis=1, kind="stable")[:, :k]
    return c, np.take_along_axis(d, c, axis=1)


def test_best_sorts_only_the_lists_it_gets():
    best = blocks.Best(1000, 3)
    best.add(np.array([5, 5, 5, 5, 9]), np.array([4, 3, 2, 1, 8]), np.array([2.0, 1.0, 1.0, np.nan, 7.0]))
    assert best.worst(5, 6)[0] == 2.0 and np.isnan(best.worst(9, 10)[0])
    held = best.values[9].copy()
    best.add(np.array([5, 5]), np.array([7, 0]), np.array([1.0, 9.0]))
    row, id, d = best.all()
    assert row.tolist() == [5, 5, 5, 9] and id.tolist() == [2, 3, 7, 8] and d.tolist() == [1.0, 1.0, 1.0, 7.0]
    assert np.array_equal(best.values[9], held, equal_nan=True)


@pytest.mark.parametrize("shift,spread", [(0.0, 1.0), (1e4, 1.0), (1e6, 1e-3)])
def test_candidates_in_32_bits_lose_nothing(shift, spread):
    rng = np.random.default_rng(1)
    m, q = (rng.standard_normal((n, 16)) * spread + shift for n in (900, 40))
    m[:7] = q[0]
    measure, ids, best = blocks.Measure("sqeuclidean"), np.arange(900), blocks.Best(40, 5)
    for j in range(0, 900, 300):
        near = blocks.Near(m[j : j + 300])
        r, c, d = near.pick(measure, q, ids[j : j + 300], 5, None, best.worst(0, 40))
        best.add(r, ids[j : j + 300][c], d)
    want, far = brute(q, m, 5)
    assert best.names.tolist() == want.tolist() and best.values == pytest.approx(far)


def test_many_queries_meet_the_table_on_all_cores(spark):
    rows = spark.range(blocks.SPREAD_ROWS + 1).select("id", F.array(F.col("id") / 7.0, F.lit(1.0)).alias("vector")).coalesce(1)
    found = blocks.scan(rows, rows, 2, blocks.Measure("sqeuclidean"))
    assert found.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
    best = blocks.rank_rows(found, 1).collect()
    assert len(best) == blocks.SPREAD_ROWS + 1 and all(r["id"] == r["query_id"] for r in best)


def test_landmark_searches_skip_and_stay_exact(spark):
    """Clusters far apart: results are those of all pairs, and no pair of rows is made outside the tasks."""
    rng = np.random.default_rng(2)
    m = np.concatenate([rng.standard_normal((300, 6)) + 50 * i for i in range(4)])
    rows = table(spark, m).repartition(3)
    landmarks, members = neighbors.build_landmarks(rows)
    found = neighbors.landmark_knn(rows, landmarks, members, 4)
    assert "SortMergeJoin" not in found._jdf.queryExecution().toString() and "BroadcastHashJoin" not in found._jdf.queryExecution().toString()
    want, far = brute(m, m, 4)
    got = sorted((r["query_id"], r["rank"], r["id"], r["distance"]) for r in found.collect())
    assert [g[2] for g in got] == want.ravel().tolist() and [g[3] for g in got] == pytest.approx(np.sqrt(far).ravel().tolist())
    close = neighbors.landmark_eps(rows.where("id < 500"), landmarks, members, 1.5).collect()
    d = np.sqrt(((m[:500, None, :] - m[None, :, :]) ** 2).sum(2))
    assert sorted((r["xid"], r["yid"]) for r in close) == list(zip(*(x.tolist() for x in np.nonzero(d <= 1.5)), strict=True))
    few = spark.createDataFrame([(1, [0.0] * 6)], "id long, vector array<double>")
    assert neighbors.landmark_knn(rows.limit(5), *neighbors.build_landmarks(few), 4).count() == 5


def test_digests_return_a_row_for_each_query_and_task(spark):
    rng = np.random.default_rng(3)
    m = np.abs(rng.standard_normal((400, 8)))
    rows = table(spark, m / m.sum(1)[:, None])
    for metric in ("jensenshannon", "l1", "cosine"):
        got = {r["query_id"]: r for r in neighbors.digest(rows.where("id < 20"), rows, metric).collect()}
        pairs = neighbors.pairwise(rows.where("id < 20"), rows, metric).groupBy("xid").agg(F.count("yid"), F.avg("distance"), F.min("distance"), F.max("distance")).collect()
        assert len(got) == 20 and all(tuple(got[p[0]])[1:] == pytest.approx(tuple(p)[1:]) for p in pairs)


def test_sparse_digests_and_searches_return_no_pairs(spark):
    """Sums of pairs for every metric, by query and task; equal rows are at distance 0 and in the order of their ids."""
    rng = np.random.default_rng(4)
    m = np.where(rng.random((120, 12)) < 0.4, rng.random((120, 12)), 0.0)
    m[50] = m[70] = m[3]
    rows = sparse.from_dense(table(spark, m))
    for metric in sparse.METRICS:
        got = {r["query_id"]: r for r in sparse.digest(rows.where("id < 9"), rows, metric, 12, 3.0).collect()}
        pairs = sparse.pairwise(rows.where("id < 9"), rows, metric, 12, 3.0).groupBy("xid").agg(F.count("yid"), F.avg("distance"), F.min("distance"), F.max("distance")).collect()
        assert len(got) == 9 and all(tuple(got[p[0]])[1:] == pytest.approx(tuple(p)[1:], nan_ok=True) for p in pairs)
    for metric in ("jensenshannon", "l1", "canberra", "L2Unexpanded", "hamming"):
        near = sparse.knn(rows.where("id = 3"), rows, 3, metric, 12).orderBy("rank").collect()
        assert [r["id"] for r in near] == [3, 50, 70] and [r["distance"] for r in near] == [0.0, 0.0, 0.0]
    q = sparse.Rows(*(c for c in (np.arange(300), pa.array([[0]] * 300), pa.array([[1.0]] * 300))))
    assert [(i, len(t.ids)) for i, t in sparse._tiles(q)] == [(0, 256), (256, 44)]


def test_equal_rows_are_one_node_of_a_graph(spark):
    """Copies would fill each other's links: all of them are found, in the order of their ids, and filters act on each."""
    rng = np.random.default_rng(5)
    m = np.tile(rng.standard_normal((150, 16)), (20, 1))
    rows = table(spark, m)
    for ix in (graphs.build_cagra(rows, intermediate_graph_degree=16, graph_degree=8), graphs.build_hnsw(rows, M=6), graphs.build_vamana(rows, graph_degree=8, visited_size=16)):
        found = ix.search(rows.where("id < 40"), 20, itopk_size=48).collect()
        got = {(r["query_id"], r["rank"]): (r["id"], r["distance"]) for r in found}
        assert len(got) == 800 and sum(got[q, k + 1] == (q + 150 * k, 0.0) for q in range(40) for k in range(20)) >= 0.95 * 800
    ix = graphs.build_cagra(rows, intermediate_graph_degree=16, graph_degree=8)
    some = rows.where("id < 5")
    listed = ix.search(some, 3, itopk_size=48, allow=rows.where("id % 7 = 0").select("id")).collect()
    assert sorted(listed) == sorted(ix.search(some, 3, itopk_size=48, mask=lambda q, i: i % 7 == 0).collect()) and all(r["id"] % 7 == 0 for r in listed)


def test_components_are_joined_by_their_nearest_rows():
    """The nearest row of a component is looked for among all its rows, not among the first ones."""
    m = np.r_[np.arange(100.0), 300.0 - np.arange(100.0)][:, None]
    chain = [np.array([j for j in (i - 1, i + 1) if j // 100 == i // 100 and j >= 0]) for i in range(200)]
    graph = graphs.connect(m, chain, blocks.Measure("sqeuclidean"))
    assert 199 in graph[99] and 99 in graph[199] and sum(len(g) for g in graph) == 2 * 198 + 2


def test_distances_of_pairs_come_in_parts(monkeypatch):
    """However many pairs a beam offers, few vectors are gathered at a time."""
    most, measure = [], blocks.Measure("sqeuclidean")
    monkeypatch.setattr(measure, "pairs", lambda x, y: (most.append(len(x)), ((x - y) ** 2).sum(1))[1])
    m = np.random.default_rng(6).standard_normal((500, 4))
    i, j = np.repeat(np.arange(500), 100), np.tile(np.arange(100), 500)
    d = graphs.indexed_distance(m, m, i, j, measure)
    assert max(most) <= graphs.PAIRS and d == pytest.approx(((m[i] - m[j]) ** 2).sum(1))


def test_sums_of_l1_distances_need_no_pairs(spark):
    rng = np.random.default_rng(7)
    q, m = rng.integers(-3, 4, (30, 5)).astype(float), rng.integers(-3, 4, (80, 5)).astype(float)
    assert stats.sums_of_gaps(q, m) == pytest.approx(np.abs(q[:, None, :] - m[None, :, :]).sum((1, 2)))
    rows = table(spark, m).withColumn("label", F.col("id") % 3)
    got = {r["id"]: r["silhouette"] for r in stats.silhouette_samples(rows, metric="l1").collect()}
    d, lab = np.abs(m[:, None, :] - m[None, :, :]).sum(2), np.arange(80) % 3
    mean = np.stack([d[:, lab == v].sum(1) / np.where(lab == v, (lab == v).sum() - 1, (lab == v).sum()) for v in range(3)], axis=1)
    a, b = mean[np.arange(80), lab], np.where(np.arange(3) == lab[:, None], np.inf, mean).min(1)
    assert [got[i] for i in range(80)] == pytest.approx(((b - a) / np.maximum(a, b)).tolist())


def test_spanning_trees_of_ties_have_no_cycle(spark):
    """A lattice, where every edge has many equals: ties are ordered the same way from both ends."""
    m = np.array([(x, y) for x in range(5) for y in range(4)], dtype=float)
    tree = linkage.tree_of_points(table(spark, m)).collect()
    assert len(tree) == 19 and len({(r["src"], r["dst"]) for r in tree}) == 19 and sum(r["weight"] for r in tree) == 19.0


def test_trustworthiness_measures_a_pair_once(spark, monkeypatch):
    """The neighbours of a row share one pass over the table."""
    seen, whole = [], stats.meet
    monkeypatch.setattr(stats, "meet", lambda q, d, work, *args: (seen.append((q, work)), whole(q, d, work, *args))[1])
    rng = np.random.default_rng(8)
    m = rng.standard_normal((90, 6))
    m[10] = m[11]
    rows, head = table(spark, m), table(spark, m[:, :2])
    got = stats.trustworthiness(rows, head, 4).first()[0]
    order = lambda x: np.argsort(np.where(np.eye(90, dtype=bool), np.inf, ((x[:, None, :] - x[None, :, :]) ** 2).sum(2)), axis=1, kind="stable")
    near, rank = order(m[:, :2])[:, :4], order(m).argsort(1) + 1
    over = np.maximum(0, np.take_along_axis(rank, near, 1) - 4).sum()
    assert got == pytest.approx(1 - over * 2.0 / (90 * 4 * (180 - 13)))
    queries, work = seen[0]
    t = queries.toArrow().sort_by("id").combine_chunks()
    sides = [t["id"].to_numpy(), stats.matrix(t["vector"].combine_chunks()), t["nid"].to_numpy(), stats.matrix(t["nv"].combine_chunks())]
    assert len(sides[0]) == 360 and len(np.unique(sides[0])) == 90 and sum(b.num_rows for b in work(sides, rows.toArrow().to_batches())) == 360
