"""Golden values, naive versions and edge cases of the exact operators."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from vectorloom.functions.distances import METRICS, distance, resolve
from vectorloom.operators import blocks, kmeans, linkage, neighbors, pca, quantizers, sparse, stats
from vectorloom.plans import harness
from vectorloom.plans.components import connected_components
from vectorloom.sources import binary
from vectorloom.streaming import extend as streams


def table(spark, m, **more):
    return spark.createDataFrame([(i, [float(x) for x in v], *(c[i] for c in more.values())) for i, v in enumerate(np.asarray(m))], "id long, vector array<double>" + "".join(f", {k} long" for k in more))


@pytest.fixture(scope="module")
def m():
    return np.random.default_rng(0).random((60, 7))


@pytest.mark.parametrize("metric", sorted(METRICS))
def test_expression_equals_block(spark, m, metric):
    x = (m > 0.5).astype(float) if "Hamming" in metric or "Russel" in metric else m[:, :2] if metric == "Haversine" else m / m.sum(1, keepdims=True)
    rows = table(spark, x)
    pairs = rows.select(F.col("id").alias("i"), F.col("vector").alias("a")).crossJoin(rows.where("id < 9"))
    want = resolve(metric).block(x, x[:9], 3.0)
    for r in pairs.select("i", "id", distance(metric, "a", "vector", 3.0).alias("d")).collect():
        assert r.d == pytest.approx(want[r.i, r.id], abs=1e-7)


def test_unsupported_metrics():
    for name in ("braycurtis", "jaccard", "nonsense"):
        with pytest.raises(ValueError):
            resolve(name)


def test_blocks_of_queries(spark, m, monkeypatch):
    """A query set beyond a block's size is scanned in parts."""
    rows = table(spark, m)
    want = sorted(map(tuple, neighbors.knn(rows, rows, 4).collect()))
    monkeypatch.setattr(blocks, "MAX_BLOCK_FLOATS", 70)
    assert sorted(map(tuple, neighbors.knn(rows, rows, 4).collect())) == want
    order = np.lexsort((np.broadcast_to(np.arange(60), (60, 60)), ((m[:, None] - m[None]) ** 2).sum(2)), axis=1)[:, :4]
    assert [r[2] for r in want] == order.ravel().tolist()


def test_nulls_ties_and_few_rows(spark):
    rows = spark.createDataFrame([(1, [0.0, 1.0]), (2, [0.0, 1.0]), (3, None), (None, [0.0, 1.0]), (4, [5.0, 1.0])], "id long, vector array<double>")
    q = spark.createDataFrame([(9, [0.0, 1.0]), (8, None)], "id long, vector array<double>")
    assert [tuple(r) for r in neighbors.knn(q, rows, 10).collect()] == [(9, 1, 1, 0.0), (9, 2, 2, 0.0), (9, 3, 4, 25.0)]
    padded = neighbors.pad(neighbors.knn(q, rows, 4), q, 4).where("query_id = 9").orderBy("rank").collect()
    assert [r.id for r in padded] == [1, 2, 4, -1]
    empty = rows.where("false")
    assert neighbors.knn(q, empty, 3).collect() == [] and neighbors.knn(empty, rows, 3).collect() == []


def test_copies_are_ordered_by_id(spark):
    """Equal vectors in many batches and blocks have equal distances."""
    base = np.random.default_rng(1).random((3, 33)) * 10
    rows = table(spark, base[np.arange(300) % 3]).repartition(7)
    for metric in ("sqeuclidean", "cosine", "correlation", "inner_product"):
        got = neighbors.knn(rows.where("id < 3"), rows, 5, metric).where("query_id = 1").orderBy("rank").collect()
        if metric != "inner_product":
            assert [r.id for r in got] == [1, 4, 7, 10, 13]
        assert [r.id for r in got] == sorted(r.id for r in got)


def test_sparse_golden(spark):
    data = [(0, [0, 4], [0.0, 1.0]), (1, [0, 3], [5.0, 6.0]), (2, [0, 2], [5.0, 6.0]), (3, [0, 8], [5.0, 6.0])]
    rows = spark.createDataFrame(data, "id long, indices array<int>, values array<double>")
    got = sparse.knn(rows, rows, 2, "euclidean", 9).orderBy("query_id", "rank").collect()
    assert [round(r.distance, 5) for r in got][1] == pytest.approx(7.87401, abs=1e-5)
    assert all(r.distance == 0 for r in got if r.rank == 1)


@pytest.mark.parametrize("metric", sparse.METRICS)
def test_sparse_equals_dense(spark, metric):
    rng = np.random.default_rng(2)
    x = np.where(rng.random((30, 12)) < 0.3, rng.random((30, 12)), 0.0)
    x[5] = x[6] = 0
    x = (x > 0).astype(float) if metric in ("JaccardExpanded", "DiceExpanded") else x
    rows = sparse.from_dense(table(spark, x))
    got = {(r.xid, r.yid): r.distance for r in sparse.pairwise(rows, rows, metric, 12, 3.0).collect()}
    assert len(got) == 900
    nnz = (x != 0).sum(1)
    for i in range(30):
        for j in range(30):
            if metric in ("JaccardExpanded", "DiceExpanded"):
                dot, n = x[i] @ x[j], nnz[i] + nnz[j]
                want = 0.0 if n == 0 else 1 - (dot / (n - dot) if metric == "JaccardExpanded" else 2 * dot / n)
            elif metric == "CosineExpanded" and not (nnz[i] and nnz[j]):
                want = 0.0 if nnz[i] == nnz[j] else 1.0
            else:
                want = resolve(metric).block(x[i : i + 1], x[j : j + 1], 3.0)[0, 0]
            assert got[i, j] == pytest.approx(want, abs=1e-7, nan_ok=True)


def test_components(spark):
    rng = np.random.default_rng(4)
    edges = rng.integers(0, 200, (150, 2))
    root = list(range(200))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges.tolist():
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    got = {r.node: r.component for r in connected_components(spark.createDataFrame([(int(a), int(b)) for a, b in edges], "src long, dst long")).collect()}
    assert all(c == find(n) for n, c in got.items())
    assert set(got) == {int(x) for e in edges for x in e if e[0] != e[1]}


# clustering


def test_kmeans_on_blobs(spark):
    rows = binary.blobs(spark, 500, 16, 5, 0.2, seed=1).cache()
    for init in ("k-means++", "k-means||", "random"):
        model = kmeans.fit(rows, 5, init, n_init=4)
        got = kmeans.predict(rows, model.centroids).join(rows.select("id", F.col("label").alias("blob")), "id").groupBy("blob", "label").count().collect()
        assert len(got) == 5 or init == "random", init
        assert model.inertia == pytest.approx(kmeans.cluster_cost(rows, model.centroids))


def test_kmeans_against_numpy(spark, m):
    rows, c = table(spark, m), m[:4].copy()
    model = kmeans.fit(rows, 4, m[:4], max_iter=7, tol=0.0)
    for _ in range(model.n_iter):
        label = ((m[:, None] - c[None]) ** 2).sum(2).argmin(1)
        c = np.array([m[label == i].mean(0) for i in range(4)])
    assert np.allclose(model.centroids, c)


def test_kmeans_empty_cluster_stays(spark, m):
    start = np.vstack([m[:2], np.full((1, 7), 50.0)])
    model = kmeans.fit(table(spark, m), 3, start, max_iter=3)
    assert np.allclose(model.centroids[2], 50.0)
    with pytest.raises(ValueError):
        kmeans.fit(table(spark, m), 100)


def test_balanced_sizes(spark):
    rows = binary.blobs(spark, 3000, 8, 3, 2.0, seed=2)
    sizes = [r["count"] for r in kmeans.predict(rows, kmeans.balanced_fit(rows, 24)).groupBy("label").count().collect()]
    assert len(sizes) == 24 and max(sizes) < 8 * 3000 / 24


@pytest.mark.parametrize("k", [4, 7])
def test_find_k(spark, k):
    assert kmeans.find_k(binary.blobs(spark, 600, 8, k, 0.01, seed=k), 14, max_iter=20)[0] == k


def naive_tree(d):
    """Total weight and edges of the minimum spanning tree of a matrix (Prim)."""
    n, inside, edges = len(d), [0], []
    while len(inside) < n:
        rest = [j for j in range(n) if j not in inside]
        i, j = min(((i, j) for i in inside for j in rest), key=lambda e: (d[e], min(e), max(e)))
        edges.append((min(i, j), max(i, j)))
        inside.append(j)
    return edges


def cut(edges, d, n, k):
    keep = sorted(edges, key=lambda e: (d[e], e))[: n - k]
    lab = list(range(n))
    for a, b in keep:
        x, y = lab[a], lab[b]
        lab = [min(x, y) if v in (x, y) else v for v in lab]
    return lab


def same_partition(a, b):
    return len(set(zip(a, b, strict=True))) == len(set(a)) == len(set(b))


def test_linkage(spark, m):
    rows, d = table(spark, m), np.sqrt(((m[:, None] - m[None]) ** 2).sum(2))
    edges = naive_tree(d)
    tree = linkage.tree_of_points(rows)
    assert sum(r.weight for r in tree.collect()) == pytest.approx(sum(d[e] for e in edges))
    labels = [r.label for r in linkage.flat_clusters(tree, rows, 6).orderBy("id").collect()]
    assert same_partition(labels, cut(edges, d, 60, 6))
    knn_labels = [r.label for r in linkage.single_linkage(rows, 6, c=20).orderBy("id").collect()]
    assert same_partition(knn_labels, cut(edges, d, 60, 6))
    dendro = linkage.dendrogram(tree, rows)
    assert dendro.sizes[-1] == 60 and (np.diff(dendro.distances) >= 0).all() and len(dendro.children) == 59


def test_linkage_of_far_groups(spark):
    """A neighbour graph in pieces is connected before its tree is made."""
    rng = np.random.default_rng(8)
    x = np.concatenate([rng.random((20, 3)) + 100 * i for i in range(4)])
    labels = [r.label for r in linkage.single_linkage(table(spark, x), 4, c=0).orderBy("id").collect()]
    assert same_partition(labels, np.repeat(range(4), 20).tolist())


def test_mutual_reachability_tree(spark, m):
    d = np.sqrt(((m[:, None] - m[None]) ** 2).sum(2))
    core = np.sort(d, axis=1)[:, 4]
    r = np.maximum(np.maximum(core[:, None], core[None]), d)
    tree, cores = linkage.build_linkage(table(spark, m), min_samples=5, k=59)
    assert {x.id: round(x.core, 9) for x in cores.collect()} == {i: round(c, 9) for i, c in enumerate(core)}
    assert sum(x.weight for x in tree.collect()) == pytest.approx(sum(r[e] for e in naive_tree(r)))


def test_spectral(spark):
    x = np.concatenate([np.random.default_rng(1).random((25, 3)) + 8 * i for i in range(3)])
    rows = table(spark, x)
    graph = pca.connectivity_graph(rows, 6).unionByName(spark.createDataFrame([(0, 30, 0.01), (30, 0, 0.01), (30, 60, 0.01), (60, 30, 0.01)], "src long, dst long, weight double"))
    labels = [r.label for r in pca.spectral_clustering(graph, 3).orderBy("id").collect()]
    assert same_partition(labels, np.repeat(range(3), 25).tolist())


def test_spectral_by_iteration(spark, monkeypatch):
    """Both solvers span the same space."""
    x = np.random.default_rng(1).random((40, 2)) * [3, 1]
    graph = pca.connectivity_graph(table(spark, x), 10)
    small = np.array([r.vector for r in pca.spectral_embedding(graph, 1).orderBy("id").collect()])[:, 0]
    monkeypatch.setattr(pca, "SMALL_GRAPH", 0)
    large = np.array([r.vector for r in pca.spectral_embedding(graph, 1, rounds=10).orderBy("id").collect()])[:, 0]
    assert abs(np.corrcoef(small, large)[0, 1]) > 0.95


# preprocessing


def test_pca_golden(spark):
    x = np.array([[1.0, 4.0], [2.0, 2.0], [5.0, 1.0]])
    p = pca.fit_pca(table(spark, x), 2)
    want = np.linalg.eigvalsh(np.cov(x.T))[::-1]
    assert np.allclose(p.explained_variance, want) and np.allclose(p.components @ p.components.T, np.eye(2))
    assert np.allclose(p.explained_variance, [6.338, 0.3287], atol=1e-3)
    assert np.allclose(np.abs(p.components), [[0.8163, 0.5776], [0.5776, 0.8163]], atol=1e-3)


def test_pca_against_numpy(spark, m):
    p = pca.fit_pca(table(spark, m).repartition(5), 3)
    u, s, vt = np.linalg.svd(m - m.mean(0), full_matrices=False)
    assert np.allclose(p.singular_values, s[:3]) and np.allclose(np.abs(p.components), np.abs(vt[:3]))
    assert p.noise_variance == pytest.approx((s[3:] ** 2).mean() / 59)
    out = np.array([r.vector for r in p.transform(table(spark, m)).orderBy("id").collect()])
    assert np.allclose(np.abs(out), np.abs(u[:, :3] * s[:3]))


def test_scalar_quantizer(spark, m):
    rows = table(spark, m)
    for quantile in (1.0, 0.9, 0.5):
        q = quantizers.train_scalar(rows, quantile)
        v = np.sort(m.ravel())
        top = int(np.ceil((0.5 + 0.5 * quantile) * len(v))) - 1
        assert (q.low, q.high) == (v[len(v) - top - 1], v[top])
        codes = np.array([r.c for r in rows.orderBy("id").select(q.transform("vector").alias("c")).collect()])
        assert codes.min() == -128 and codes.max() == 127
        back = np.array([r.c for r in rows.orderBy("id").select(q.inverse(q.transform("vector")).alias("c")).collect()])
        assert np.abs(back - np.clip(m, q.low, q.high)).max() <= 0.51 / q.scale
    flat = quantizers.train_scalar(table(spark, np.full((3, 2), 5.0)), 1.0)
    assert flat.scale == 1.0
    with pytest.raises(ValueError):
        quantizers.train_scalar(rows, 0.0)


def test_binary_quantizer(spark, m):
    rows = table(spark, np.tile(m, (1, 2))[:, :11])
    for kind in ("zero", "mean", "sampling_median"):
        q = quantizers.train_binary(rows, kind, 1.0)
        got = np.array([r.c for r in rows.orderBy("id").select(q.transform("vector").alias("c")).collect()], dtype=np.uint8)
        assert (got == np.packbits(np.tile(m, (1, 2))[:, :11] > np.array(q.thresholds), axis=1, bitorder="little")).all()


@pytest.mark.parametrize("args", [{}, {"use_vq": True, "vq_n_centers": 4}, {"use_subspaces": False}, {"hierarchical": False}])
def test_product_quantizer(spark, args):
    rows = binary.blobs(spark, 800, 12, 6, 1.0, seed=4)
    q = quantizers.train_pq(rows, 6, 4, n_iters=10, **args)
    assert q.quantized_dim == 3 and q.bits == 6
    back = {r.id: np.array(r.vector) for r in q.inverse_transform(q.transform(rows)).collect()}
    m = {r.id: np.array(r.vector) for r in rows.collect()}
    loss = np.mean([((m[i] - back[i]) ** 2).sum() for i in m])
    assert loss < 0.3 * np.var(np.array(list(m.values())), axis=0).sum()


# scores


@pytest.mark.parametrize("n", [8, 40])
def test_silhouette(spark, n):
    rng = np.random.default_rng(n)
    x, label = rng.random((n, 4)), rng.integers(0, 3, n)
    label[0] = 7
    d = ((x[:, None] - x[None]) ** 2).sum(2)
    want = []
    for i in range(n):
        own = (label == label[i]) & (np.arange(n) != i)
        if not own.any():
            want.append(0.0)
            continue
        a, b = d[i, own].mean(), min(d[i, label == c].mean() for c in set(label.tolist()) - {label[i]})
        want.append((b - a) / max(a, b))
    got = stats.silhouette_samples(table(spark, x, label=label.tolist())).orderBy("id").collect()
    assert np.allclose([r.silhouette for r in got], want)


def test_trustworthiness(spark, m):
    rows, emb = table(spark, m), table(spark, m[:, :2])
    d, e = (((a[:, None] - a[None]) ** 2).sum(2) for a in (m, m[:, :2]))
    np.fill_diagonal(d, np.inf)
    np.fill_diagonal(e, np.inf)
    rank = d.argsort(1).argsort(1) + 1
    k, n = 5, 60
    total = sum(max(0, rank[i, j] - k) for i in range(n) for j in e[i].argsort()[:k])
    want = 1 - total * 2 / (n * k * (2 * n - 3 * k - 1))
    assert stats.trustworthiness(rows, emb, k).first()[0] == pytest.approx(want)


def test_kernel_volumes():
    """Kernels integrate to one over the volume that their norm states (radial sums)."""
    for d in (1, 2, 3, 5, 8):
        r = np.linspace(0, 60, 600_001)
        surface = np.log(2) + 0.5 * d * np.log(np.pi) - __import__("math").lgamma(0.5 * d)
        for kernel in stats.KERNELS:
            with np.errstate(divide="ignore"):
                f = np.exp(stats.log_kernel(kernel, r, 1.3)) * r ** (d - 1)
            total = np.log(np.trapezoid(f, r)) + surface
            assert total == pytest.approx(stats.log_norm(kernel, 1.3, d), abs=2e-3), (kernel, d)


def test_kde_degenerate(spark):
    rows = table(spark, [[0.0, 0.0], [1.0, 1.0]])
    got = {r.query_id: r.log_density for r in stats.kde(table(spark, [[9.0, 9.0], [0.0, 0.1]]), rows, 0.5, "tophat").collect()}
    assert got[0] is None and got[1] is not None
    assert stats.kde(rows, rows, 1.0, "gaussian", "cosine").count() == 2


# sources, streams, harness


@pytest.mark.parametrize("dtype", sorted(binary.SUFFIXES.values()))
def test_vector_files(spark, tmp_path, monkeypatch, dtype):
    x = np.random.default_rng(6).integers(0, 100, (137, 5)).astype(float)
    path = f"file://{tmp_path}/v.{binary.suffix_of(dtype)}"
    assert binary.write_vectors(table(spark, x), path, dtype, part_rows=50) >= 2
    read = lambda: np.array([r.vector for r in binary.read_vectors(spark, path).orderBy("id").collect()])
    assert (read() == x).all()
    monkeypatch.setattr(binary, "WHOLE_BYTES", 0)
    monkeypatch.setattr(binary, "RANGE_BYTES", 100)
    assert (read() == x).all()
    with pytest.raises(ValueError):
        binary.dtype_of("x.txt")


def test_stream_appends_once(spark, tmp_path):
    for i in range(3):
        table(spark, np.full((4, 2), float(i))).write.parquet(f"file://{tmp_path}/in/{i}")
    schema = table(spark, [[1.0]]).schema
    for _ in range(2):
        stream = streams.stream_table(spark, f"file://{tmp_path}/in/*", schema, max_files=1)
        streams.append_to(stream, f"file://{tmp_path}/out", f"file://{tmp_path}/at").awaitTermination()
    assert streams.delta(spark, f"file://{tmp_path}/out").count() == 12


def test_grid_and_frontier(spark):
    assert len(harness.grid({"a": [1, 2], "b": [3, 4, 5]})) == 6
    pairs = list(harness.configurations("ivf_flat", {"n_lists": [4, 16]}, {"n_probes": [2, 8]}, 10, 64))
    assert ({"n_lists": 4}, {"n_probes": 8}) not in pairs and len(pairs) == 3
    rows = spark.createDataFrame([("a", 0.5, 100.0), ("a", 0.7, 90.0), ("a", 0.6, 80.0), ("a", 0.9, 10.0)], "algo string, recall double, items_per_second double")
    assert sorted(r.recall for r in harness.pareto(rows).collect()) == [0.5, 0.7, 0.9]
    assert [r[0] for r in rows.orderBy("recall").select(harness.recall_band()).collect()] == ["below 80"] * 3 + ["90-94"]


def test_large_query_sets_meet_on_the_executors(spark, monkeypatch):
    """Query sets of several parts give what one part gives, for every operator that compares two tables."""
    from vectorloom.operators import blocks, neighbors, stats
    from vectorloom.sources.binary import blobs as made

    rows = made(spark, 300, 8, 4, 1.0, seed=5).cache()

    def results():
        exact = lambda df: sorted(map(tuple, df.collect()))
        return [
            exact(neighbors.knn(rows, rows, 4)),
            exact(neighbors.knn(rows, rows, 3, "inner_product", mask=lambda q, i: (q[:, None] + i[None, :]) % 3 == 0)),
            exact(neighbors.nearest(rows, rows, "sqeuclidean", ("label", "label"), different=True)),
            exact(neighbors.eps_neighborhood(rows, rows, 4.0)),
            exact(stats.silhouette_samples(rows)),
            exact(stats.trustworthiness(rows, rows.selectExpr("id", "slice(vector, 1, 3) AS vector"), 4)),
            exact(stats.kde(rows, rows, 2.0)),
        ]

    whole = results()
    monkeypatch.setattr(blocks, "MAX_BLOCK_FLOATS", 900)
    assert blocks.n_blocks(rows) == 3
    for a, b in zip(results(), whole, strict=True):
        assert len(a) == len(b)
        for x, y in zip(a, b, strict=True):
            assert x == pytest.approx(y, rel=1e-9, abs=1e-9)
