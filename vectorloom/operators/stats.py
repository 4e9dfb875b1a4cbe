"""Quality scores of clusterings, embeddings and searches, and kernel density estimates, without all pairs in memory."""

from __future__ import annotations

from math import lgamma, log, pi

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vectorloom.functions.arrays import matrix
from vectorloom.functions.distances import ALIASES, resolve
from vectorloom.operators.blocks import coarse, meet, vectors_of
from vectorloom.operators.neighbors import knn


def silhouette_samples(data: DataFrame, label: str = "label", metric: str = "L2Unexpanded") -> DataFrame:
    """(id, label, silhouette) of every row; 0 for the only member of a cluster and where both distances are equal."""
    rows = vectors_of(data, "id", "vector", F.col(label).cast("long").alias("label")).where("label IS NOT NULL")
    measure = resolve(metric).block
    schema = pa.schema([("id", pa.int64()), ("other", pa.int64()), ("total", pa.float64())])

    def by_order(block, batches):
        qid, q = block
        got = [(matrix(b.column(1)), b.column(2).to_numpy()) for b in batches if b.num_rows]
        if not got or not len(qid):
            return
        m, lab = (np.concatenate(x) for x in zip(*got, strict=True))
        for v in np.unique(lab):
            yield pa.RecordBatch.from_arrays([pa.array(qid), pa.array(np.full(len(qid), v)), pa.array(sums_of_gaps(q, m[lab == v]))], schema=schema)

    def work(block, batches):
        qid, q = block
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            if not b.num_rows or not len(qid):
                continue
            m, lab = matrix(b.column(1)), b.column(2).to_numpy()
            step = max(1, 1_000_000 // len(m))
            for i in range(0, len(qid), step):
                d = measure(q[i : i + step], m)
                for v in np.unique(lab):
                    sums.setdefault(int(v), np.zeros(len(qid)))[i : i + step] += d[:, lab == v].sum(1)
        for v, total in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array(qid), pa.array(np.full(len(qid), v)), pa.array(total)], schema=schema)

    totals = meet(rows.select("id", "vector"), rows, by_order if ALIASES.get(metric, metric) == "L1" else work, "id long, other long, total double").groupBy("id", "other").agg(F.sum("total").alias("total"))
    sizes = rows.groupBy(F.col("label").alias("other")).agg(F.count(F.lit(1)).alias("size"))
    met = totals.join(sizes, "other").join(rows.select("id", "label"), "id")
    inner = F.max(F.when(F.col("other") == F.col("label"), F.when(F.col("size") > 1, F.col("total") / (F.col("size") - 1)).otherwise(-1.0)))
    outer = F.min(F.when(F.col("other") != F.col("label"), F.col("total") / F.col("size")))
    ab = met.groupBy("id", "label").agg(inner.alias("a"), outer.alias("b"))
    score = F.when((F.col("a") < 0) | (F.col("a") == F.col("b")), 0.0).otherwise((F.col("b") - F.col("a")) / F.greatest("a", "b"))
    return ab.select("id", "label", score.alias("silhouette"))


def sums_of_gaps(q: np.ndarray, m: np.ndarray) -> np.ndarray:
    """The sum of L1 distances of every row of q to all rows of m: by sorted components and their sums, without pairs."""
    total, size = np.zeros(len(q)), np.zeros(len(q))
    for c in range(m.shape[1]):
        y, x = np.sort(m[:, c]), q[:, c]
        below = np.searchsorted(y, x)
        sums = np.r_[0.0, np.cumsum(y)]
        total += x * (2 * below - len(y)) + sums[-1] - 2 * sums[below]
        size += np.abs(x) * len(y) + np.abs(y).sum()
    return np.where(total < 1e-12 * size, 0.0, total)


def silhouette_score(data: DataFrame, label: str = "label", metric: str = "L2Unexpanded") -> DataFrame:
    """One row: the mean silhouette."""
    return silhouette_samples(data, label, metric).agg(F.avg("silhouette").alias("silhouette"))


def trustworthiness(data: DataFrame, embedded: DataFrame, n_neighbors: int = 5, metric: str = "L2SqrtUnexpanded") -> DataFrame:
    """One row: 1 - 2 / (n k (2n - 3k - 1)) times the sum of how far neighbours in the embedding exceed rank k in the data."""
    rows = vectors_of(data)
    near = knn(embedded, embedded, n_neighbors + 1, metric).where("query_id <> id")
    near = near.withColumn("r", F.row_number().over(Window.partitionBy("query_id").orderBy("rank"))).where(F.col("r") <= n_neighbors)
    measure = resolve(metric).block
    schema = pa.schema([("query_id", pa.int64()), ("id", pa.int64()), ("closer", pa.int64())])
    pairs = near.select("query_id", "id").join(rows.select("id", F.col("vector").alias("nv")), "id").join(rows.select(F.col("id").alias("query_id"), "vector"), "query_id")
    n = rows.count()

    def work(block, batches):
        qid, q, nid, nv = block
        if not len(qid):
            return
        limit = np.concatenate([coarse(np.diagonal(measure(q[i : i + 256], nv[i : i + 256]))) for i in range(0, len(q), 256)])
        count = np.zeros(len(qid), dtype=np.int64)
        own, first, many = np.unique(qid, return_index=True, return_counts=True)  # a row's neighbours share its distances
        for b in batches:
            if not b.num_rows:
                continue
            ids, m = b.column(0).to_numpy(), matrix(b.column(1))
            step = max(1, 1_000_000 // len(ids))
            for i in range(0, len(own), step):
                d = coarse(measure(q[first[i : i + step]], m))
                d[own[i : i + step, None] == ids[None, :]] = np.inf
                for t in range(int(many[i : i + step].max())):
                    has = np.flatnonzero(many[i : i + step] > t)
                    at, some = first[i + has] + t, d if len(has) == len(d) else d[has]
                    lim = limit[at, None]
                    count[at] += np.count_nonzero(some <= lim, axis=1)
                    r, c = np.divmod(np.flatnonzero(some == lim), len(ids))
                    beyond = ids[c] >= nid[at[r]]
                    np.subtract.at(count, at[r[beyond]], 1)
        yield pa.RecordBatch.from_arrays([pa.array(qid), pa.array(nid), pa.array(count)], schema=schema)

    named = pairs.select(F.col("query_id").alias("id"), "vector", F.col("id").alias("nid"), "nv")
    ranks = meet(named, rows, work, "query_id long, id long, closer long").groupBy("query_id", "id").agg((F.sum("closer") + 1).alias("rank"))
    k = n_neighbors
    over = F.sum(F.greatest(F.lit(0), F.col("rank") - k))
    return ranks.agg((1 - F.coalesce(over, F.lit(0)) * (2.0 / (n * k * (2.0 * n - 3.0 * k - 1.0)))).alias("trustworthiness"))


def recall(found: DataFrame, truth: DataFrame, k: int) -> DataFrame:
    """One row: the share of the true top-k pairs (query_id, rank, id) that were found."""
    t = truth.where(F.col("rank") <= k).select("query_id", "id").distinct()
    f = found.where(F.col("rank") <= k).select("query_id", "id", F.lit(1).alias("hit")).distinct()
    return t.join(f, ["query_id", "id"], "left").agg((F.count("hit") / F.count(F.lit(1))).alias("recall"))


def tolerant_recall(found: DataFrame, truth: DataFrame, k: int, eps: float = 1e-3) -> DataFrame:
    """Recall that also counts a found row whose distance equals, up to eps, that of the true row of its rank."""
    t = truth.where(F.col("rank") <= k)
    f = found.where(F.col("rank") <= k).select("query_id", "rank", F.col("id").alias("fid"), F.col("distance").alias("fd"))
    ids = t.select("query_id", F.col("id").alias("fid"), F.lit(1).alias("hit")).distinct()
    met = f.join(ids, ["query_id", "fid"], "left").join(t.select("query_id", "rank", "distance"), ["query_id", "rank"], "left")
    good = F.sum(F.when(F.col("hit").isNotNull() | (F.abs(F.col("fd") - F.col("distance")) <= eps), 1).otherwise(0))
    total = t.agg(F.count(F.lit(1)).alias("n"))
    return met.agg(good.alias("g")).crossJoin(F.broadcast(total)).select((F.col("g") / F.col("n")).alias("recall"))


# kernel density

KERNELS = ("gaussian", "tophat", "epanechnikov", "exponential", "linear", "cosine")


def log_norm(kernel: str, h: float, d: int) -> float:
    """Logarithm of the kernel's volume in d dimensions at bandwidth h."""
    unit = 0.5 * d * log(pi) - lgamma(0.5 * d + 1)
    if kernel == "gaussian":
        v = 0.5 * d * log(2 * pi)
    elif kernel == "tophat":
        v = unit
    elif kernel == "epanechnikov":
        v = unit + log(2.0 / (d + 2))
    elif kernel == "exponential":
        v = unit + lgamma(d + 1)
    elif kernel == "linear":
        v = unit - log(d + 1)
    elif kernel == "cosine":
        # the radial integral of cos(pi t / 2) t ** (d - 1) from 0 to 1, by the cosine's power series
        term, total = 1.0, 1.0 / d
        for i in range(1, 30):
            term *= -((0.5 * pi) ** 2) / ((2 * i - 1) * (2 * i))
            total += term / (d + 2 * i)
        v = log(total) + log(d) + unit
    else:
        raise ValueError(f"kernel {kernel!r} is not one of {KERNELS}")
    return v + d * log(h)


def log_kernel(kernel: str, x: np.ndarray, h: float) -> np.ndarray:
    with np.errstate(divide="ignore", invalid="ignore"):
        u = x / h
        inside = x < h
        if kernel == "gaussian":
            return -0.5 * u * u
        if kernel == "tophat":
            return np.where(inside, 0.0, -np.inf)
        if kernel == "epanechnikov":
            return np.where(inside, np.log(np.maximum(1 - u * u, 1e-300)), -np.inf)
        if kernel == "exponential":
            return -u
        if kernel == "linear":
            return np.where(inside, np.log(np.maximum(1 - u, 1e-300)), -np.inf)
        if kernel == "cosine":
            return np.where(inside, np.log(np.maximum(np.cos(0.5 * pi * u), 1e-300)), -np.inf)
    raise ValueError(f"kernel {kernel!r} is not one of {KERNELS}")


def _kde_block(metric: str, p: float):
    """Block distances as density estimation defines them: no half in KL, terms only where both are positive; 0 for degenerate angles."""
    name = ALIASES.get(metric, metric)
    if name in ("CosineExpanded", "CorrelationExpanded"):
        base = resolve(name).block
        return lambda x, y: np.nan_to_num(base(x, y), nan=0.0, posinf=0.0, neginf=0.0)
    if name == "KLDivergence":

        def kl(x, y):
            out = np.empty((len(x), len(y)))
            for i, a in enumerate(x):
                both = (a[None, :] > 0) & (y > 0)
                out[i] = np.where(both, a[None, :] * (np.log(np.where(both, a[None, :], 1.0)) - np.log(np.where(both, y, 1.0))), 0.0).sum(1)
            return out

        return kl
    m = resolve(name)
    return lambda x, y: m.block(x, y, p)


def kde(queries: DataFrame, train: DataFrame, bandwidth: float, kernel: str = "gaussian", metric: str = "euclidean", p: float = 2.0, weight: str | None = None) -> DataFrame:
    """(query_id, log_density): log of the weighted mean of kernel values, by merged log-sum-exp; null where it is zero."""
    queries = vectors_of(queries)
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    rows = vectors_of(train, "id", "vector", w.alias("weight"))
    n, dim, total = rows.agg(F.count(F.lit(1)), F.max(F.size("vector")), F.sum("weight")).first()
    measure = _kde_block(metric, p)
    norm = log_norm(kernel, bandwidth, dim or 1)
    schema = pa.schema([("query_id", pa.int64()), ("m", pa.float64()), ("s", pa.float64())])

    def work(block, batches):
        qid, q = block
        top, total = np.full(len(qid), -np.inf), np.zeros(len(qid))
        for b in batches:
            if not b.num_rows or not len(qid):
                continue
            m, lw = matrix(b.column(1)), np.log(np.maximum(b.column(2).to_numpy(), 1e-300))
            step = max(1, 1_000_000 // len(m))
            for i in range(0, len(qid), step):
                v = log_kernel(kernel, measure(q[i : i + step], m), bandwidth) + lw[None, :]
                new = np.maximum(top[i : i + step], v.max(1))
                safe = np.where(np.isfinite(new), new, 0.0)
                total[i : i + step] = total[i : i + step] * np.exp(np.where(np.isfinite(top[i : i + step]), top[i : i + step] - safe, -np.inf)) + np.exp(v - safe[:, None]).sum(1)
                top[i : i + step] = new
        ok = np.isfinite(top)
        yield pa.RecordBatch.from_arrays([pa.array(qid[ok]), pa.array(top[ok]), pa.array(total[ok])], schema=schema)

    parts = meet(queries, rows, work, "query_id long, m double, s double")
    peak = parts.groupBy("query_id").agg(F.collect_list(F.struct("m", "s")).alias("x"), F.max("m").alias("top"))
    summed = F.aggregate("x", F.lit(0.0), lambda a, v: a + v["s"] * F.exp(v["m"] - F.col("top")))
    dens: Column = F.col("top") + F.ln(summed) - log(total or 1.0) - norm
    return queries.select(F.col("id").alias("query_id")).distinct().join(peak.select("query_id", dens.alias("log_density")), "query_id", "left")
