"""Benchmark harness: parameter grids with constraints, sweeps of build and search, recall and Pareto frontiers."""

from __future__ import annotations

import random
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import product

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vectorloom.operators.neighbors import knn
from vectorloom.operators.stats import recall


def grid(space: dict[str, list]) -> list[dict]:
    """All combinations of the values of a parameter space."""
    return [dict(zip(space, values, strict=True)) for values in product(*space.values())]


#: name: a condition on (build parameters, search parameters, k, dimension)
CONSTRAINTS: dict[str, Callable[[dict, dict, int, int], bool]] = {
    "ivf_flat": lambda b, s, k, dim: s.get("n_probes", 1) <= b.get("n_lists", 1024),
    "ivf_sq": lambda b, s, k, dim: s.get("n_probes", 1) <= b.get("n_lists", 1024),
    "ivf_rabitq": lambda b, s, k, dim: s.get("n_probes", 1) <= b.get("n_lists", 1024),
    "ivf_pq": lambda b, s, k, dim: s.get("n_probes", 1) <= b.get("n_lists", 1024) and b.get("pq_dim", 0) <= dim and b.get("pq_dim", 0) * b.get("pq_bits", 8) % 8 == 0,
    "cagra": lambda b, s, k, dim: s.get("itopk_size", 64) >= k and b.get("graph_degree", 64) <= b.get("intermediate_graph_degree", 128),
    "hnsw": lambda b, s, k, dim: s.get("itopk_size", 64) >= k,
    "vamana": lambda b, s, k, dim: s.get("itopk_size", 64) >= k and b.get("visited_size", 64) >= b.get("graph_degree", 32),
    "brute_force": lambda b, s, k, dim: True,
}


@dataclass(frozen=True)
class Backend:
    """build(data, **params) gives an index with search(queries, k, **params)."""

    name: str
    build: Callable


REGISTERED: dict[str, Backend] = {}


def register_backend(name: str, build: Callable, constraint: Callable[[dict, dict, int, int], bool] | None = None) -> None:
    """Adds a back end of one's own to sweeps; build(data, **params) gives something with search(queries, k, **params)."""
    REGISTERED[name] = Backend(name, build)
    if constraint:
        CONSTRAINTS[name] = constraint


def backends() -> dict[str, Backend]:
    from vectorloom.operators import exact, graphs, ivf

    known = {"brute_force": exact.build_exact, "ivf_flat": ivf.build_flat, "ivf_sq": ivf.build_sq, "ivf_pq": ivf.build_pq, "ivf_rabitq": ivf.build_rabitq, "cagra": graphs.build_cagra, "hnsw": graphs.build_hnsw, "vamana": graphs.build_vamana}
    return {n: Backend(n, f) for n, f in known.items()} | REGISTERED


def ground_truth(queries: DataFrame, data: DataFrame, k: int, metric: str = "sqeuclidean") -> DataFrame:
    """(query_id, rank, id, distance) of the exact neighbours."""
    return knn(queries, data, k, metric)


def random_choice_queries(data: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """n rows of data as queries, chosen by a hash of id."""
    return data.orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(n)


def random_queries(data: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """n normal vectors with the mean and the spread of every component of data, made where they are used."""
    dim = data.select(F.max(F.size("vector"))).first()[0] or 0
    moments = data.agg(*(f(F.get("vector", F.lit(i))) for f in (F.avg, F.stddev_pop) for i in range(dim))).first()
    parts = [F.lit(moments[i]) + F.lit(moments[dim + i]) * F.randn(seed + i) for i in range(dim)]
    return data.sparkSession.range(0, n, 1, 1).select("id", F.array(*parts).alias("vector"))


def tune(backend: str, data: DataFrame, queries: DataFrame, truth: DataFrame, k: int, build: dict[str, list], search: dict[str, list], dim: int, least: float = 0.9, trials: int = 10, seed: int = 0) -> tuple[dict | None, list[dict]]:
    """The fastest of some random configurations whose recall is at least `least`, and all that were tried."""
    known = list(configurations(backend, build, search, k, dim))
    chosen = random.Random(seed).sample(known, min(trials, len(known)))
    tried = []
    for b, s in chosen:
        tried += sweep(backend, data, queries, truth, k, {name: [v] for name, v in b.items()}, {name: [v] for name, v in s.items()}, dim)
    good = [r for r in tried if r["recall"] >= least]
    return max(good, key=lambda r: r["items_per_second"], default=None), tried


def configurations(backend: str, build: dict[str, list], search: dict[str, list], k: int, dim: int) -> Iterator[tuple[dict, dict]]:
    """Pairs of build and search parameters that the backend's constraints admit."""
    ok = CONSTRAINTS.get(backend, lambda *_: True)
    yield from ((b, s) for b in grid(build) for s in grid(search) if ok(b, s, k, dim))


def sweep(backend: str, data: DataFrame, queries: DataFrame, truth: DataFrame, k: int, build: dict[str, list], search: dict[str, list], dim: int, batch_size: int | None = None) -> list[dict]:
    """Build time, queries a second, latency and recall of every configuration."""
    b, out = backends()[backend], []
    n = queries.count()
    for params in grid(build):
        chosen = [s for p, s in configurations(backend, {k: [v] for k, v in params.items()}, search, k, dim)]
        if not chosen:
            continue
        began = time.perf_counter()
        ix = b.build(data, **params)
        rows = getattr(ix, "lists", None) if getattr(ix, "lists", None) is not None else getattr(ix, "nodes", None)
        if rows is not None:
            rows.cache().count()
        built = time.perf_counter() - began
        for s in chosen:
            began = time.perf_counter()
            found = ix.search(queries, k, **s).cache()
            found.count()
            took = time.perf_counter() - began
            out.append({"algo": backend, "build": params, "search": s, "k": k, "build_s": built, "end_to_end": took, "items_per_second": n / took, "latency": took / max(1, -(-n // (batch_size or n))), "recall": recall(found, truth, k).first()[0]})
            found.unpersist()
        if rows is not None:
            rows.unpersist()
    return out


def as_table(spark: SparkSession, results: list[dict]) -> DataFrame:
    rows = [(r["algo"], str(r["build"]), str(r["search"]), r["k"], float(r["build_s"]), float(r["items_per_second"]), float(r["latency"]), float(r["recall"])) for r in results]
    return spark.createDataFrame(rows, "algo string, build string, search string, k int, build_s double, items_per_second double, latency double, recall double")


def pareto(results: DataFrame, recall_col: str = "recall", speed: str = "items_per_second", larger: bool = True, by: str | None = None) -> DataFrame:
    """Rows that are faster than all rows of at least their recall: by speed, those whose recall exceeds all before."""
    w = Window.partitionBy(*([by] if by else [F.lit(0)])).orderBy(F.desc(speed) if larger else F.asc(speed), F.desc(recall_col)).rowsBetween(Window.unboundedPreceding, -1)
    before = F.max(recall_col).over(w)
    return results.withColumn("__before", before).where(F.col("__before").isNull() | (F.col(recall_col) > F.col("__before"))).drop("__before")


def recall_band(recall_col: str = "recall") -> Column:
    """Reporting band of a recall."""
    r = F.col(recall_col)
    return F.when(r >= 0.99, "99+").when(r >= 0.95, "95-98").when(r >= 0.9, "90-94").when(r >= 0.8, "80-89").otherwise("below 80")


def export(results: DataFrame, path: str) -> None:
    """CSV files of results and of their frontier."""
    results.coalesce(1).write.mode("overwrite").option("header", True).csv(f"{path}/results")
    pareto(results, by="algo").coalesce(1).write.mode("overwrite").option("header", True).csv(f"{path}/pareto")
