"""Single linkage: minimum spanning trees by Boruvka rounds, dendrograms and flat cuts."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vectorloom.operators.blocks import vectors_of
from vectorloom.operators.neighbors import core_distances, cross_component_nn, knn, knn_graph, mutual_reachability, nearest, symmetric
from vectorloom.plans.components import connected_components
from vectorloom.runtime import cut_lineage

MAX_MERGES = 5_000_000


def _components(nodes: DataFrame, tree: DataFrame) -> DataFrame:
    found = connected_components(tree)
    return cut_lineage(nodes.join(found.withColumnRenamed("node", "id"), "id", "left").select("id", F.coalesce("component", "id").alias("component")))


def _ordered(src: str, dst: str, weight: str) -> Column:
    """A total order of undirected edges."""
    return F.struct(F.col(weight).alias("w"), F.least(src, dst).alias("a"), F.greatest(src, dst).alias("b"))


def spanning_tree(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """(src, dst, weight) of a minimum spanning forest of an undirected edge table; ties by (src, dst), src < dst.

    Each round, every component takes its least outgoing edge; O(log n) rounds.
    """
    e = edges.where("src <> dst").select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"), F.col("weight").cast("double").alias("weight"))
    e = cut_lineage(e.groupBy("src", "dst").agg(F.min("weight").alias("weight")))
    nodes = cut_lineage((nodes.select(F.col("id").cast("long").alias("id")) if nodes is not None else e.select(F.col("src").alias("id")).union(e.select("dst"))).distinct())
    tree = e.where(F.lit(False))
    while True:
        comp = _components(nodes, tree)
        out = e.join(comp.select(F.col("id").alias("src"), F.col("component").alias("c")), "src").join(comp.select(F.col("id").alias("dst"), F.col("component").alias("d")), "dst").where("c <> d")
        both = out.select("c", _ordered("src", "dst", "weight").alias("x")).union(out.select("d", _ordered("src", "dst", "weight").alias("x")))
        chosen = cut_lineage(both.groupBy("c").agg(F.min("x").alias("x")).select("x.a", "x.b", "x.w").distinct().toDF("src", "dst", "weight"))
        if not chosen.limit(1).count():
            return tree
        tree = cut_lineage(tree.unionByName(chosen))


def tree_of_points(data: DataFrame, metric: str = "euclidean") -> DataFrame:
    """The minimum spanning tree of the complete graph of a table (id, vector), without building that graph."""
    rows = vectors_of(data)
    nodes = cut_lineage(rows.select("id"))
    tree = nodes.select(F.col("id").alias("src"), F.col("id").alias("dst"), F.lit(0.0).alias("weight")).where(F.lit(False))
    while True:
        comp = _components(nodes, tree)
        largest = comp.groupBy("component").count().orderBy(F.desc("count"), "component").first()
        if largest is None:
            return tree
        # the least edges of all components but one are enough; the largest would cost most
        placed, small = rows.join(comp, "id"), F.col("component") != largest["component"]
        found = nearest(placed.where(small), placed, metric, ("component", "component"), different=True)
        mine = found.join(comp.where(small).withColumnRenamed("id", "query_id"), "query_id")
        near = mine.groupBy("component").agg(F.min(_ordered("query_id", "id", "distance")).alias("x"))
        chosen = cut_lineage(near.select("x.a", "x.b", "x.w").distinct().toDF("src", "dst", "weight"))
        if not chosen.limit(1).count():
            return tree
        tree = cut_lineage(tree.unionByName(chosen))


def connect_graph(graph: DataFrame, data: DataFrame, metric: str = "euclidean", rounds: int = 10) -> DataFrame:
    """A neighbour graph with edges that join its components, each to the nearest row of another one."""
    rows = vectors_of(data)
    nodes = cut_lineage(rows.select("id"))
    for _ in range(rounds):
        comp = _components(nodes, graph)
        if comp.select("component").distinct().limit(2).count() < 2:
            return graph
        near = cross_component_nn(rows.join(comp, "id"), "component", metric).select("src", "dst", F.col("distance").alias("weight"))
        graph = cut_lineage(symmetric(graph.unionByName(near)))
    raise RuntimeError(f"the graph is not connected after {rounds} rounds")


def sorted_tree(tree: DataFrame) -> DataFrame:
    """The tree's edges by weight, with their order."""
    return tree.orderBy("weight", "src", "dst")


@dataclass
class Dendrogram:
    """children: the two clusters merged in each step (rows are 0 .. n - 1, step s makes n + s), their distances and sizes."""

    ids: np.ndarray
    children: np.ndarray
    distances: np.ndarray
    sizes: np.ndarray


def dendrogram(tree: DataFrame, nodes: DataFrame) -> Dendrogram:
    """Merges in the order of the tree's edges, on the driver, for at most MAX_MERGES rows; flat_clusters() has no such bound."""
    n = nodes.count()
    if n > MAX_MERGES:
        raise ValueError(f"a dendrogram of {n} rows; at most {MAX_MERGES} are merged on the driver")
    ids = np.sort(nodes.select(F.col("id").cast("long")).toArrow()["id"].to_numpy())
    t = sorted_tree(tree).toArrow()
    a, b = np.searchsorted(ids, t["src"].to_numpy()), np.searchsorted(ids, t["dst"].to_numpy())
    parent, label, size = list(range(n)), list(range(n)), [1] * n
    children, sizes = np.zeros((len(a), 2), dtype=np.int64), np.zeros(len(a), dtype=np.int64)

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for s, (x, y) in enumerate(zip(a.tolist(), b.tolist(), strict=True)):
        x, y = root(x), root(y)
        children[s] = label[x], label[y]
        if size[x] < size[y]:
            x, y = y, x
        parent[y], size[x], label[x] = x, size[x] + size[y], n + s
        sizes[s] = size[x]
    return Dendrogram(ids, children, t["weight"].to_numpy(), sizes)


def flat_clusters(tree: DataFrame, nodes: DataFrame, n_clusters: int) -> DataFrame:
    """(id, label): components left when the n_clusters - 1 heaviest edges of a spanning tree go; labels by smallest id."""
    heavy = tree.orderBy(F.desc("weight"), F.desc("src"), F.desc("dst")).limit(n_clusters - 1)
    kept = tree.join(heavy, ["src", "dst"], "left_anti")
    comp = _components(cut_lineage(nodes.select(F.col("id").cast("long").alias("id")).distinct()), kept)
    names = comp.select("component").distinct().withColumn("label", (F.row_number().over(Window.orderBy("component")) - 1).cast("int"))
    return comp.join(names, "component").select("id", "label")


def single_linkage(data: DataFrame, n_clusters: int, metric: str = "euclidean", connectivity: str = "knn", c: int = 15) -> DataFrame:
    """(id, label) by single linkage over the complete graph ("pairwise") or a connected neighbour graph ("knn")."""
    tree = tree_of_points(data, metric) if connectivity == "pairwise" else spanning_tree(connect_graph(cut_lineage(knn_graph(data, c, metric)), data, metric), vectors_of(data))
    return flat_clusters(tree, vectors_of(data), n_clusters)


def build_linkage(data: DataFrame, metric: str = "euclidean", min_samples: int | None = None, alpha: float = 1.0, k: int | None = None) -> tuple[DataFrame, DataFrame | None]:
    """(spanning tree, core distances): by distance, or by mutual reachability over min_samples neighbours."""
    if min_samples is None:
        return tree_of_points(data, metric), None
    rows = vectors_of(data)
    found = cut_lineage(knn(rows, rows, k or max(2 * min_samples, 16), metric))
    cores = cut_lineage(core_distances(found, min_samples))
    graph = symmetric(found.where("query_id <> id").select(F.col("query_id").alias("src"), F.col("id").alias("dst"), F.col("distance").alias("weight")))
    graph = connect_graph(cut_lineage(graph), rows, metric)
    return spanning_tree(mutual_reachability(graph, cores, alpha), rows), cores
