"""k-means: Lloyd iterations over a distributed table, balanced training on a bounded sample, choice of k.

Tables are (id, vector) with an optional weight. Centroids are a matrix of k rows on the driver; every iteration is
one pass in which each task sends at most k partial sums, added up by label before k rows reach the driver.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vectorloom.functions.arrays import matrix, vectors
from vectorloom.functions.distances import resolve
from vectorloom.operators.blocks import coarse, gather, share, smallest, vectors_of

METRICS = ("L2Expanded", "L2SqrtExpanded")
INIT_ROWS = 20_000


@dataclass
class KMeans:
    """Fitted centroids, the inertia under them and the number of iterations."""

    centroids: np.ndarray
    inertia: float
    n_iter: int

    def table(self, spark) -> DataFrame:
        """(label, vector) of the centroids."""
        return spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(self.centroids)], "label int, vector array<double>")


def _rows(data: DataFrame, weight: str | None) -> DataFrame:
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    return vectors_of(data, "id", "vector", w.alias("weight"))


def sample(data: DataFrame, most: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Ids and matrix of about min(most, n) rows of (id, vector), chosen by a hash of id."""
    n = data.count()
    share_of = min(1.0, most / max(1, n))
    part = data if share_of >= 1 else data.where(F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(1_000_003)) < int(1_000_003 * share_of))
    return gather(part.select("id", "vector"))


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return resolve("L2Expanded").block(x, c)


def init_random(m: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    return m[rng.choice(len(m), k, replace=len(m) < k)]


def init_plus_plus(m: np.ndarray, k: int, rng: np.random.Generator, weight: np.ndarray | None = None) -> np.ndarray:
    """Greedy k-means++: of 2 + ceil(ln k) candidates drawn by squared distance, the one that lowers the cost most."""
    w = np.ones(len(m)) if weight is None else weight
    trials = 2 + int(np.ceil(np.log(max(k, 1))))
    centers = [m[rng.choice(len(m), p=w / w.sum())]]
    d = squared(m, centers[0][None, :])[:, 0]
    for _ in range(1, k):
        p = d * w
        c = rng.choice(len(m), trials, p=p / p.sum()) if p.sum() > 0 else rng.choice(len(m), trials)
        options = np.minimum(d[:, None], squared(m, m[c]))
        best = int((options * w[:, None]).sum(0).argmin())
        centers.append(m[c[best]])
        d = options[:, best]
    return np.array(centers)


def init_scalable(rows: DataFrame, k: int, rng: np.random.Generator, oversampling: float = 2.0, rounds: int = 5) -> np.ndarray:
    """k-means||: rounds of rows drawn in proportion to their cost, then greedy k-means++ among them by weight."""
    _, first = sample(rows.select("id", "vector"), 1000, int(rng.integers(1 << 30)))
    centers = first[rng.choice(len(first), 1)]
    for step in range(rounds):
        scored = _scored(rows, centers)
        total = scored.agg(F.sum(F.col("distance") * F.col("weight"))).first()[0] or 0.0
        if total <= 0:
            break
        draw = F.pmod(F.xxhash64("id", F.lit(int(rng.integers(1 << 30)) + step)), F.lit(1 << 30)) / F.lit(float(1 << 30))
        chosen = scored.where(draw < F.col("distance") * F.col("weight") * (oversampling * k / total)).select("id")
        _, more = gather(rows.join(chosen, "id", "left_semi").select("id", "vector").limit(int(20 * oversampling * k) + 100))
        if len(more):
            centers = np.unique(np.concatenate([centers, more]), axis=0)
    sizes = {r[0]: r[1] for r in _scored(rows, centers).groupBy("label").agg(F.sum("weight")).collect()}
    w = np.array([sizes.get(i, 0.0) for i in range(len(centers))])
    if len(centers) < k:
        centers = np.concatenate([centers, init_random(first, k - len(centers), rng)])
        w = np.r_[w, np.ones(len(centers) - len(w))]
    return init_plus_plus(centers, k, rng, np.maximum(w, 1e-12))


def _scored(rows: DataFrame, centroids: np.ndarray) -> DataFrame:
    """(id, label, distance, weight): nearest centroid (ties: the first) and squared distance of every row."""
    sent = share(rows.sparkSession, centroids)
    schema = pa.schema([("id", pa.int64()), ("label", pa.int32()), ("distance", pa.float64()), ("weight", pa.float64())])

    def run(batches):
        for b in batches:
            if b.num_rows:
                m = matrix(b.column(1))
                label = coarse(squared(m, sent.value)).argmin(axis=1)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(label.astype(np.int32)), pa.array(((m - sent.value[label]) ** 2).sum(1)), b.column(2)], schema=schema)

    return rows.select("id", "vector", "weight").mapInArrow(run, "id long, label int, distance double, weight double")


def _step(rows: DataFrame, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Weighted sums and weights by label, and the cost, of one assignment of all rows."""
    sent, (k, dim) = share(rows.sparkSession, centroids), centroids.shape
    schema = pa.schema([("label", pa.int32()), ("total", pa.list_(pa.float64())), ("weight", pa.float64()), ("cost", pa.float64())])

    def partial(batches):
        total, weight, cost = np.zeros((k, dim)), np.zeros(k), np.zeros(k)
        for b in batches:
            if b.num_rows:
                m, w = matrix(b.column(1)), b.column(2).to_numpy()
                label = coarse(squared(m, sent.value)).argmin(axis=1)
                np.add.at(total, label, m * w[:, None])
                weight += np.bincount(label, w, k)
                cost += np.bincount(label, w * ((m - sent.value[label]) ** 2).sum(1), k)
        at = np.flatnonzero(weight)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), vectors(total[at]), pa.array(weight[at]), pa.array(cost[at])], schema=schema)

    def add(t: pa.Table) -> pa.Table:
        total = matrix(t["total"].combine_chunks()).sum(0)
        return pa.table([t["label"][:1], vectors(total[None, :]), [float(np.sum(t["weight"].to_numpy()))], [float(np.sum(t["cost"].to_numpy()))]], schema=schema)

    parts = rows.select("id", "vector", "weight").mapInArrow(partial, "label int, total array<double>, weight double, cost double")
    total, weight, cost = np.zeros((k, dim)), np.zeros(k), 0.0
    for r in parts.groupBy("label").applyInArrow(add, "label int, total array<double>, weight double, cost double").collect():
        total[r["label"]], weight[r["label"]] = r["total"], r["weight"]
        cost += r["cost"]
    return total, weight, cost


def lloyd(rows: DataFrame, centroids: np.ndarray, max_iter: int, tol: float) -> KMeans:
    """Iterations from given centroids. The cost compared is that before the update; an empty cluster keeps its centroid."""
    before, n_iter = None, 0
    for n_iter in range(1, max_iter + 1):
        total, weight, cost = _step(rows, centroids)
        new = np.where(weight[:, None] > 0, total / np.where(weight > 0, weight, 1.0)[:, None], centroids)
        shift = float(((new - centroids) ** 2).sum())
        centroids = new
        if (before is not None and before > 0 and cost / before > 1 - tol) or shift < tol:
            break
        before = cost
    return KMeans(centroids, _step(rows, centroids)[2], n_iter)


def fit(data: DataFrame, n_clusters: int = 8, init: str | np.ndarray = "k-means++", max_iter: int = 300, tol: float = 1e-4, n_init: int = 1, seed: int = 0, weight: str | None = None, oversampling_factor: float = 2.0, init_size: int = INIT_ROWS) -> KMeans:
    """The best of n_init runs. init: "k-means++" (on a sample of init_size rows, or k-means|| beyond it), "random", or a matrix. Weights are scaled to sum to the number of rows."""
    rows = _rows(data, weight).cache()
    n, total = rows.agg(F.count(F.lit(1)), F.sum("weight")).first()
    if n < n_clusters:
        raise ValueError(f"{n} rows for {n_clusters} clusters")
    scaled = rows.withColumn("weight", F.col("weight") * (n / total)) if weight else rows
    best = None
    for run in range(n_init):
        rng = np.random.default_rng(seed + run)
        if not isinstance(init, str):
            start = np.asarray(init, dtype=np.float64)
        elif init == "random":
            start = init_random(sample(rows, init_size, seed + run)[1], n_clusters, rng)
        elif init in ("k-means++", "k-means||"):
            start = init_plus_plus(sample(rows, init_size, seed + run)[1], n_clusters, rng) if oversampling_factor == 0 or (init == "k-means++" and n <= init_size) else init_scalable(scaled, n_clusters, rng, oversampling_factor or 2.0)
        else:
            raise ValueError(f"init {init!r}")
        got = lloyd(scaled, start, max_iter, tol)
        best = got if best is None or got.inertia < best.inertia else best
    rows.unpersist()
    return best


def predict(data: DataFrame, centroids: np.ndarray, weight: str | None = None) -> DataFrame:
    """(id, label, distance): nearest centroid and squared distance to it."""
    return _scored(_rows(data, weight), centroids).select("id", "label", "distance")


def transform(data: DataFrame, centroids: np.ndarray, metric: str = "euclidean") -> DataFrame:
    """(id, distances): the distance of every row to each centroid."""
    sent, block = share(data.sparkSession, centroids), resolve(metric).block
    schema = pa.schema([("id", pa.int64()), ("distances", pa.list_(pa.float64()))])

    def run(batches):
        for b in batches:
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([b.column(0), vectors(block(matrix(b.column(1)), sent.value))], schema=schema)

    return vectors_of(data).mapInArrow(run, "id long, distances array<double>")


def cluster_cost(data: DataFrame, centroids: np.ndarray, weight: str | None = None) -> float:
    """Weighted sum of the squared distances to the nearest centroids."""
    return _step(_rows(data, weight), centroids)[2]


def assign_top(rows: DataFrame, centers: np.ndarray, n: int, metric: str = "sqeuclidean") -> DataFrame:
    """(id, label, position): the n nearest centres of every row, position from 0."""
    m = resolve(metric)
    sent = share(rows.sparkSession, centers)
    schema = pa.schema([("id", pa.int64()), ("label", pa.int32()), ("position", pa.int32())])

    def run(batches):
        for b in batches:
            if b.num_rows:
                d = coarse(m.block(matrix(b.column(1)), sent.value))
                r, c = smallest(-d if m.larger else d, np.arange(len(sent.value)), n)
                first = np.searchsorted(r, np.arange(b.num_rows))
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(r)), pa.array(c.astype(np.int32)), pa.array((np.arange(len(r)) - first[r]).astype(np.int32))], schema=schema)

    return rows.select("id", "vector").mapInArrow(run, "id long, label int, position int")


# balanced training


def balanced(m: np.ndarray, k: int, n_iters: int = 20, seed: int = 0, metric: str = "sqeuclidean") -> np.ndarray:
    """Hierarchical balanced k-means of a matrix: about sqrt(k) coarse clusters, then fine ones in proportion to their sizes.

    After each iteration, clusters below a quarter of the mean size move next to a row of a large cluster.
    """
    rng = np.random.default_rng(seed)
    m = _unit(m) if metric in ("cosine", "inner_product") else m
    if len(m) <= k:
        return np.concatenate([m, init_random(m, k - len(m), rng)]) if len(m) else np.zeros((k, 0))
    coarse_k = min(k, max(1, int(np.sqrt(k) + 0.5)))
    if k <= 16 or coarse_k < 2:
        return _balance(m, init_random(m, k, rng), n_iters, rng, metric)
    top = _balance(m, init_random(m, coarse_k, rng), n_iters, rng, metric)
    label = squared(m, top).argmin(1)
    size = np.bincount(label, minlength=coarse_k)
    want = np.minimum(np.maximum(1, np.floor(k * size / len(m)).astype(int)), size)
    while want.sum() != k:
        gap = size / np.maximum(want, 1)
        at = int(np.where(want < size, gap, -1).argmax()) if want.sum() < k else int(np.where(want > 1, gap, np.inf).argmin())
        want[at] += 1 if want.sum() < k else -1
    fine = [_balance(m[label == i], init_random(m[label == i], want[i], rng), n_iters, rng, metric) for i in range(coarse_k) if size[i]]
    return _balance(m, np.concatenate(fine)[:k], 2, rng, metric)


def _unit(m: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(m, axis=1, keepdims=True)
    return m / np.where(n == 0, 1.0, n)


def _balance(m: np.ndarray, centers: np.ndarray, n_iters: int, rng: np.random.Generator, metric: str) -> np.ndarray:
    k = len(centers)
    for step in range(n_iters):
        label = squared(m, centers).argmin(1)
        size = np.bincount(label, minlength=k)
        total = np.zeros_like(centers)
        np.add.at(total, label, m)
        centers = np.where(size[:, None] > 0, total / np.maximum(size, 1)[:, None], centers)
        small = np.flatnonzero(size < 0.25 * len(m) / k)
        if len(small) and step < n_iters - 1:
            rows = rng.choice(len(m), len(small), p=(size[label] / size[label].sum()))
            w = np.minimum(size[small], 7)[:, None]
            centers[small] = (centers[small] * w + m[rows]) / (w + 1)
        centers = _unit(centers) if metric in ("cosine", "inner_product") else centers
    return centers


def balanced_fit(data: DataFrame, n_clusters: int, n_iters: int = 20, fraction: float = 0.5, max_rows: int = 100_000, seed: int = 0, metric: str = "sqeuclidean") -> np.ndarray:
    """Balanced centres from a sample: a fraction of the rows, at least 32 per cluster if there are as many, at most max_rows."""
    rows = vectors_of(data)
    n = rows.count()
    _, m = sample(rows, min(max_rows, max(int(n * fraction), 32 * n_clusters)), seed)
    return balanced(m, n_clusters, n_iters, seed, metric)


# choice of k


def dispersion(sizes: np.ndarray, centroids: np.ndarray) -> float:
    """Square root of the sum of size-weighted squared distances of the centroids to their mean."""
    mean = (centroids * sizes[:, None]).sum(0) / sizes.sum()
    return float(np.sqrt((sizes * ((centroids - mean) ** 2).sum(1)).sum()))


def calinski_harabasz(data: DataFrame, centroids: np.ndarray) -> float:
    """((n - k) / (k - 1), an integer division) times the dispersion over the inertia."""
    _, weight, cost = _step(_rows(data, None), centroids)
    n, k = weight.sum(), len(centroids)
    return float((int(n) - k) // (k - 1) * dispersion(weight, centroids) / cost) if k > 1 and cost > 0 else 0.0


def find_k(data: DataFrame, kmax: int, kmin: int = 1, max_iter: int = 100, tol: float = 1e-3, seed: int = 0) -> tuple[int, float]:
    """(k, inertia): a binary search for the number of clusters at which the score stops rising."""
    rows = vectors_of(data).cache()
    known: dict[int, tuple[float, float]] = {}

    def at(k: int) -> tuple[float, float]:
        if k not in known:
            m = fit(rows, k, max_iter=max_iter, tol=tol, seed=seed, n_init=2)
            known[k] = (calinski_harabasz(rows, m.centroids), m.inertia)
        return known[k]

    low, high = max(2, kmin), max(2, kmin, kmax)
    mid = (low + high) // 2
    while high - low > 1:
        left, right = (low + mid) // 2, (mid + high + 1) // 2
        best = max({low, left, mid, right, high}, key=lambda k: (at(k)[0], -k))
        order = sorted({low, left, mid, right, high})
        i = order.index(best)
        narrowed = order[max(0, i - 1)], order[min(len(order) - 1, i + 1)]
        if narrowed == (low, high):
            break
        (low, high), mid = narrowed, best
    best = max({low, mid, high}, key=lambda k: (at(k)[0], -k))
    rows.unpersist()
    return best, at(best)[1]
