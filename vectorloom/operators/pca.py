"""Principal components from one pass of partial sums, and spectral embeddings of neighbour graphs."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vectorloom.functions.arrays import matrix, vectors
from vectorloom.operators.blocks import share, vectors_of
from vectorloom.runtime import cut_lineage

SMALL_GRAPH = 3000
#: Vectors that a subspace has beside the wanted ones, so that those converge sooner.
EXTRA = 6


def moments(data: DataFrame) -> tuple[int, np.ndarray, np.ndarray]:
    """Number of rows, mean and centred second moments (d x d); each task sends d + 1 rows."""
    rows = vectors_of(data)
    schema = pa.schema([("i", pa.int32()), ("v", pa.list_(pa.float64())), ("n", pa.int64())])
    shift = rows.limit(1).collect()
    at = np.array(shift[0]["vector"]) if shift else np.zeros(0)

    def run(batches):
        total, gram, n = np.zeros(len(at)), np.zeros((len(at), len(at))), 0
        for b in batches:
            if b.num_rows:
                m = matrix(b.column(1)) - at
                total, gram, n = total + m.sum(0), gram + m.T @ m, n + len(m)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, len(at), dtype=np.int32)), vectors(np.vstack([total, gram])), pa.array([n, *[0] * len(at)], type=pa.int64())], schema=schema)

    def add(t: pa.Table) -> pa.Table:
        return pa.table([t["i"][:1], vectors(matrix(t["v"].combine_chunks()).sum(0)[None, :]), [int(np.sum(t["n"].to_numpy()))]], schema=schema)

    got = {r["i"]: r for r in rows.mapInArrow(run, "i int, v array<double>, n long").groupBy("i").applyInArrow(add, "i int, v array<double>, n long").collect()}
    if not got:
        return 0, np.zeros(0), np.zeros((0, 0))
    n, total = got[-1]["n"], np.array(got[-1]["v"])
    gram = np.array([got[i]["v"] for i in range(len(at))])
    return n, at + total / n, gram - np.outer(total, total) / n


@dataclass(frozen=True)
class PCA:
    """components: one row per component, the entry of greatest magnitude positive."""

    components: np.ndarray
    explained_variance: np.ndarray
    explained_variance_ratio: np.ndarray
    singular_values: np.ndarray
    mean: np.ndarray
    noise_variance: float
    whiten: bool = False

    def _apply(self, data: DataFrame, f) -> DataFrame:
        sent = share(data.sparkSession, self)
        schema = pa.schema([("id", pa.int64()), ("vector", pa.list_(pa.float64()))])

        def run(batches):
            for b in batches:
                if b.num_rows:
                    yield pa.RecordBatch.from_arrays([b.column(0), vectors(f(sent.value, matrix(b.column(1))))], schema=schema)

        return vectors_of(data).mapInArrow(run, "id long, vector array<double>")

    def transform(self, data: DataFrame) -> DataFrame:
        """(id, vector) in the space of the components."""
        return self._apply(data, lambda p, m: (m - p.mean) @ p.components.T / (np.sqrt(p.explained_variance) if p.whiten else 1.0))

    def inverse_transform(self, data: DataFrame) -> DataFrame:
        """(id, vector) in the original space."""
        return self._apply(data, lambda p, m: (m * (np.sqrt(p.explained_variance) if p.whiten else 1.0)) @ p.components + p.mean)


def fit_pca(data: DataFrame, n_components: int, whiten: bool = False, flip_signs: bool = True) -> PCA:
    n, mean, scatter = moments(data)
    value, vector = np.linalg.eigh(scatter / max(1, n - 1))
    value, vector = np.maximum(value[::-1], 0.0), vector[:, ::-1].T
    if flip_signs:
        vector = vector * np.where(vector[np.arange(len(vector)), np.abs(vector).argmax(1)] < 0, -1.0, 1.0)[:, None]
    rest = value[n_components:]
    return PCA(vector[:n_components], value[:n_components], value[:n_components] / max(value.sum(), 1e-300), np.sqrt(value[:n_components] * max(1, n - 1)), mean, float(rest.mean()) if len(rest) else 0.0, whiten)


# spectral embedding


def _small(edges: DataFrame, n: int, nodes: DataFrame, want: int, normalized: bool) -> tuple[np.ndarray, np.ndarray]:
    t, ids = edges.toArrow(), np.sort(nodes.toArrow()["id"].to_numpy())
    w = np.zeros((n, n))
    np.add.at(w, (np.searchsorted(ids, t["src"].to_numpy()), np.searchsorted(ids, t["dst"].to_numpy())), t["weight"].to_numpy())
    degree = w.sum(1)
    scale = np.where(degree > 0, np.sqrt(degree), 1.0) if normalized else np.ones(n)
    lap = (np.diag(degree) - w) / scale[:, None] / scale[None, :]
    _, vector = np.linalg.eigh(lap)
    return ids, vector[:, :want] / scale[:, None]


def _large(edges: DataFrame, nodes: DataFrame, want: int, normalized: bool, rounds: int, seed: int) -> DataFrame:
    """Subspace iteration on a shifted Laplacian: each round is one join with the edges; small Gram matrices go to the driver."""
    degree = cut_lineage(nodes.join(edges.groupBy(F.col("src").alias("id")).agg(F.sum("weight").alias("d")), "id", "left").select("id", F.coalesce("d", F.lit(0.0)).alias("d")))
    top = degree.agg(F.max("d")).first()[0] or 1.0
    scale = F.when(F.col("d") > 0, F.sqrt("d")).otherwise(1.0) if normalized else F.lit(1.0)
    shift = 2.0 if normalized else 2.0 * top
    own = F.when(F.col("d") > 0, 1.0).otherwise(0.0) if normalized else F.col("d")
    factor = degree.select("id", scale.alias("s"), own.alias("l"))
    scaled = edges.join(factor.select(F.col("id").alias("src"), F.col("s").alias("a")), "src").join(factor.select(F.col("id").alias("dst"), F.col("s").alias("b")), "dst")
    scaled = cut_lineage(scaled.select("src", "dst", (F.col("weight") / F.col("a") / F.col("b")).alias("weight")))
    size = want + EXTRA
    cols, moved_cols = [f"x{i}" for i in range(size)], [f"y{i}" for i in range(size)]

    def multiplied(x: DataFrame) -> DataFrame:
        """x beside its product with the shifted matrix."""
        sums = scaled.join(x.withColumnRenamed("id", "dst"), "dst").groupBy(F.col("src").alias("id")).agg(*(F.sum(F.col(c) * F.col("weight")).alias(f"z{i}") for i, c in enumerate(cols)))
        out = x.join(factor, "id").join(sums, "id", "left")
        return cut_lineage(out.select("id", *cols, *((F.col(c) * (shift - F.col("l")) + F.coalesce(f"z{i}", F.lit(0.0))).alias(f"y{i}") for i, c in enumerate(cols))))

    def products(t: DataFrame, left: list[str], right: list[str]) -> np.ndarray:
        sums = t.agg(*(F.sum(F.col(a) * F.col(b)).alias(f"g{i}_{j}") for i, a in enumerate(left) for j, b in enumerate(right))).first()
        return np.array([[sums[f"g{i}_{j}"] for j in range(len(right))] for i in range(len(left))])

    def rotated(t: DataFrame, names: list[str], r: np.ndarray) -> DataFrame:
        return t.select("id", *(sum((F.col(a) * float(r[i, j]) for i, a in enumerate(names)), F.lit(0.0)).alias(f"x{j}") for j in range(r.shape[1])))

    x = cut_lineage(nodes.select("id", *((F.xxhash64("id", F.lit(seed + i)) / F.lit(float(1 << 63)) if i else F.lit(1.0)).alias(c) for i, c in enumerate(cols))))
    for _ in range(rounds):
        y = multiplied(x)
        g = products(y, moved_cols, moved_cols)
        x = cut_lineage(rotated(y, moved_cols, np.linalg.inv(np.linalg.cholesky(g + 1e-13 * np.trace(g) * np.eye(size))).T))
    y = multiplied(x)
    h = products(y, cols, moved_cols)
    _, r = np.linalg.eigh((h + h.T) / 2)
    out = rotated(y, cols, r[:, ::-1][:, :want])
    return out.join(factor, "id").select("id", F.array(*(F.col(f"x{i}") / F.col("s") for i in range(want))).alias("vector"))


def spectral_embedding(edges: DataFrame, n_components: int, normalized: bool = True, drop_first: bool = True, rounds: int = 60, seed: int = 0) -> DataFrame:
    """(id, vector): eigenvectors of the graph's Laplacian with the smallest eigenvalues, by rising eigenvalue.

    edges: symmetric (src, dst, weight). Up to SMALL_GRAPH nodes are solved on the driver, more by subspace iteration.
    """
    edges = cut_lineage(edges.select(F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst"), F.col("weight").cast("double").alias("weight")))
    nodes = cut_lineage(edges.select(F.col("src").alias("id")).union(edges.select("dst")).distinct())
    n, want = nodes.count(), n_components + drop_first
    if n <= SMALL_GRAPH:
        ids, m = _small(edges, n, nodes, want, normalized)
        m = m * np.where(m[np.abs(m).argmax(0), np.arange(m.shape[1])] < 0, -1.0, 1.0)[None, :]
        spark = edges.sparkSession
        return spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, m[:, int(drop_first) :], strict=True)], "id long, vector array<double>")
    out = _large(edges, nodes, want, normalized, rounds, seed)
    return out.select("id", F.slice("vector", 1 + int(drop_first), n_components).alias("vector"))


def connectivity_graph(data: DataFrame, n_neighbors: int, metric: str = "sqeuclidean") -> DataFrame:
    """Symmetric weights (a + b) / 2 of the 0-1 graph of nearest neighbours, loops left out."""
    from vectorloom.operators.neighbors import knn

    found = knn(data, data, n_neighbors, metric).where("query_id <> id").select(F.col("query_id").alias("src"), F.col("id").alias("dst"), F.lit(0.5).alias("weight"))
    both = found.unionByName(found.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight"))
    return both.groupBy("src", "dst").agg(F.sum("weight").alias("weight"))


def spectral_clustering(graph: DataFrame, n_clusters: int, n_components: int | None = None, seed: int = 0) -> DataFrame:
    """(id, label): k-means of the spectral embedding of a graph."""
    from vectorloom.operators import kmeans

    emb = spectral_embedding(graph, n_components or n_clusters, drop_first=False)
    emb = cut_lineage(emb)
    model = kmeans.fit(emb, n_clusters, n_init=5, seed=seed)
    return kmeans.predict(emb, model.centroids).select("id", "label")
