"""Graph indexes: pruned neighbour graphs, built and searched shard by shard.

Rows are dealt to shards of about SHARD_ROWS rows by a hash of id; every shard has a graph of its own and is kept as one
row of arrays (ids, levels, vectors or product codes, links as positions). A search reads these rows where they lie, without
a shuffle of the index: best-first beams run for the broadcast queries, shard by shard in bounded memory, and the
shards' lists are merged. More queries than a broadcast takes meet the shards part by part on the executors. The number of shards grows with the table. Pruning a whole kNN graph is also given as a
DataFrame program.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vectorloom.functions.arrays import matrix, vectors
from vectorloom.functions.distances import ALIASES, distance, resolve
from vectorloom.operators.blocks import NEIGHBOR_SCHEMA, NEIGHBORS, Best, Measure, coarse, meet, rank_rows, share, smallest, union, vectors_of
from vectorloom.operators.kmeans import balanced, sample, squared
from vectorloom.operators.neighbors import knn
from vectorloom.operators.quantizers import ProductQuantizer
from vectorloom.runtime import cut_lineage
from vectorloom.sources import store

SHARD_ROWS = 20_000
MAX_CELLS = 1024
MAX_PART_FLOATS = 8_000_000
PAIRS = 8192
#: Rows of a shard from which a search's buffer grows with the shard.
BUFFER_ROWS = 8192
GRAPH = "shard int, id long, level int, vector array<double>, neighbors array<long>"
PACKED = "shard int, dim int, ids binary, levels binary, labels binary, vectors binary, degrees binary, links binary"
PACKED_SCHEMA = pa.schema([("shard", pa.int32()), ("dim", pa.int32()), *((c, pa.binary()) for c in ("ids", "levels", "labels", "vectors", "degrees", "links"))])


# pruning as a DataFrame program


def detour_counts(graph: DataFrame) -> DataFrame:
    """(src, dst, rank, detours) of every edge of a ranked graph (src, rank, dst): paths src - d - dst over a closer d."""
    adj = graph.groupBy("src").agg(F.collect_list("dst").alias("next"))
    mid = graph.join(adj.withColumnRenamed("src", "dst"), "dst", "left").select("src", "rank", "dst", F.coalesce("next", F.array().cast("array<bigint>")).alias("next"))
    rows = mid.groupBy("src").agg(F.array_sort(F.collect_list(F.struct("rank", "dst", "next"))).alias("e"))
    count = F.transform("e", lambda b: F.struct(b["dst"].alias("dst"), b["rank"].alias("rank"), F.size(F.filter("e", lambda d: (d["rank"] < b["rank"]) & F.array_contains(d["next"], b["dst"]))).alias("detours")))
    return rows.select("src", F.explode(count).alias("x")).select("src", "x.dst", "x.rank", "x.detours")


def optimize(graph: DataFrame, degree: int) -> DataFrame:
    """(src, rank, dst): the degree edges of every node with the fewest detours (ties: the closer), self loops last."""
    order = [(F.col("src") == F.col("dst")).cast("int"), "detours", "rank"]
    w = Window.partitionBy("src").orderBy(*order)
    kept = detour_counts(graph).withColumn("r", F.row_number().over(w)).where(F.col("r") <= degree)
    return kept.select("src", F.col("r").alias("rank"), "dst")


def with_reverse(pruned: DataFrame, degree: int) -> DataFrame:
    """A pruned graph merged with its reversal: the first half of the edges stays, reversed edges by rank fill up, then the rest."""
    own = pruned.withColumn("c", F.when(F.col("rank") <= degree // 2, 0).otherwise(2))
    back = pruned.select(F.col("dst").alias("src"), "rank", F.col("src").alias("dst"), F.lit(1).alias("c"))
    best = own.select("src", "rank", "dst", "c").unionByName(back).where("src <> dst").groupBy("src", "dst").agg(F.min(F.struct("c", "rank")).alias("m"))
    w = Window.partitionBy("src").orderBy("m", "dst")
    return best.withColumn("r", F.row_number().over(w)).where(F.col("r") <= degree).select("src", F.col("r").alias("rank"), "dst")


def nn_descent(data: DataFrame, graph_degree: int = 64, intermediate_degree: int | None = None, metric: str = "sqeuclidean", max_iterations: int = 20, threshold: float = 1e-4, sample: int = 12, exact_below: int = 5000, seed: int = 0) -> DataFrame:
    """(src, rank, dst, distance) without loops: exact for small tables, else neighbours of neighbours, joined until few edges change.

    Each round looks at the best and a hashed choice of every node's edges in both directions (sample of each).
    """
    rows = vectors_of(data)
    n = rows.count()
    larger = resolve(metric).larger
    key = -F.col("distance") if larger else F.col("distance")
    if n <= exact_below:
        found = knn(rows, rows, graph_degree + 1, metric).where("query_id <> id")
        w = Window.partitionBy("query_id").orderBy("rank")
        return found.withColumn("r", F.row_number().over(w)).where(F.col("r") <= graph_degree).select(F.col("query_id").alias("src"), F.col("r").alias("rank"), F.col("id").alias("dst"), "distance")
    degree = intermediate_degree or max(graph_degree, 2 * sample)
    # a connected start: every row meets the rows of its bucket in several dealings
    dealings = F.array(*(F.struct(F.lit(i).alias("i"), F.pmod(F.xxhash64("id", F.lit(seed + i)), F.lit(max(1, n // 24))).alias("b")) for i in range(3)))
    dealt = rows.select("id", F.explode(dealings).alias("b"))
    pairs = dealt.select("b", F.col("id").alias("src")).join(dealt.select("b", F.col("id").alias("dst")), "b").where("src <> dst").select("src", "dst").distinct()

    def scored(pairs: DataFrame) -> DataFrame:
        met = pairs.join(rows.select(F.col("id").alias("src"), F.col("vector").alias("x")), "src").join(rows.select(F.col("id").alias("dst"), F.col("vector").alias("y")), "dst")
        return met.select("src", "dst", distance(metric, "x", "y").alias("distance"))

    def best(edges: DataFrame, k: int) -> DataFrame:
        w = Window.partitionBy("src").orderBy(key, "dst")
        return edges.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)

    edges = cut_lineage(best(scored(pairs), degree))
    for step in range(max_iterations):
        both = edges.select("src", "dst", "rank").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "rank"))
        w = Window.partitionBy("src").orderBy(F.when(F.col("rank") <= sample // 2, F.col("rank")).otherwise(1000 + F.pmod(F.xxhash64("src", "dst", F.lit(step)), F.lit(1000))), "dst")
        hubs = cut_lineage(both.dropDuplicates(["src", "dst"]).withColumn("r", F.row_number().over(w)).where(F.col("r") <= 2 * sample).select(F.col("src").alias("mid"), "dst"))
        met = hubs.select("mid", F.col("dst").alias("src")).join(hubs, "mid").where("src <> dst").select("src", "dst").distinct()
        fresh = met.join(edges.select("src", "dst"), ["src", "dst"], "left_anti")
        after = cut_lineage(best(edges.select("src", "dst", "distance", F.lit(0).alias("new")).unionByName(scored(fresh).withColumn("new", F.lit(1))), degree))
        changed = after.agg(F.sum("new")).first()[0] or 0
        edges = after.drop("new")
        if changed < threshold * n * graph_degree:
            break
    return edges.where(F.col("rank") <= graph_degree).select("src", "rank", "dst", "distance")


# shards in memory


def exact_graph(m: np.ndarray, degree: int, measure) -> np.ndarray:
    """Ranked neighbours (row numbers) of every row, itself left out; short rows repeat their last neighbour."""
    n, k = len(m), min(degree, len(m) - 1)
    out = np.zeros((n, max(k, 0)), dtype=np.int64)
    ids = np.arange(n)
    for i in range(0, n if k > 0 else 0, 256):
        d = coarse(measure(m[i : i + 256], m))
        d[np.arange(len(d)), ids[i : i + 256]] = np.inf
        _, c = smallest(d, ids, k)
        out[i : i + 256] = c.reshape(len(d), k)
    return out


def first_equal(m: np.ndarray) -> np.ndarray:
    """For every row the first one with the same values."""
    if not m.size:
        return np.arange(len(m))
    rows = np.ascontiguousarray(m + 0.0)
    _, first, at = np.unique(rows.view(np.dtype((np.void, rows.itemsize * rows.shape[1]))).ravel(), return_index=True, return_inverse=True)
    return first[at.ravel()]


def joined(links: list[np.ndarray], first: np.ndarray, kept: np.ndarray) -> np.ndarray:
    """The graph of the rows kept, numbered anew, as padded() gives it: equal rows count as the first of them."""
    number = np.zeros(len(first), dtype=np.int64)
    number[kept] = np.arange(len(kept))
    a = number[first[np.repeat(np.arange(len(links)), [len(g) for g in links])]]
    b = number[first[np.concatenate(links)]] if len(a) else a
    pairs = np.unique(a[a != b] * len(kept) + b[a != b])
    a, b = pairs // len(kept), pairs % len(kept)
    size = np.bincount(a, minlength=len(kept))
    out = np.full((len(kept), max(int(size.max(initial=0)), 1)), -1, dtype=np.int64)
    out[a, np.arange(len(a)) - (np.cumsum(size) - size)[a]] = b
    return out


def prune_detours(graph: np.ndarray, degree: int) -> np.ndarray:
    """The degree edges with the fewest detours per node."""
    n, k = graph.shape
    if k <= degree:
        return graph
    out = np.zeros((n, degree), dtype=np.int64)
    for i in range(0, n, 128):
        near = graph[i : i + 128]
        two = np.sort(graph[near], axis=2)
        count = np.zeros(near.shape, dtype=np.int32)
        for d in range(k - 1):
            row = two[:, d, :]
            at = np.array([np.searchsorted(row[j], near[j]) for j in range(len(near))])
            hit = np.take_along_axis(row, np.minimum(at, k - 1), axis=1) == near
            hit[:, : d + 1] = False
            count += hit
        order = np.argsort(count, axis=1, kind="stable")[:, :degree]
        out[i : i + 128] = np.take_along_axis(near, order, axis=1)
    return out


def reverse_merge(graph: np.ndarray) -> list[np.ndarray]:
    """Half of each node's own edges, then reversed ones, then its other own edges, up to the same degree."""
    n, k = graph.shape
    dst, rank, src = graph.ravel(), np.tile(np.arange(k), n), np.repeat(np.arange(n), k)
    order = np.lexsort((src, rank, dst))
    cut = np.searchsorted(dst[order], np.arange(n + 1))
    src = src[order]
    out = []
    for i in range(n):
        seen = dict.fromkeys([*graph[i, : (k + 1) // 2].tolist(), *src[cut[i] : cut[i + 1]].tolist()][: max(k, 1)])
        for j in graph[i].tolist():
            if len(seen) >= k:
                break
            seen.setdefault(j)
        seen.pop(i, None)
        out.append(np.fromiter(seen, dtype=np.int64))
    return out


def connect(m: np.ndarray, graph: list[np.ndarray], measure) -> list[np.ndarray]:
    """The graph with edges that join its weak components, each by its row nearest to the first component."""
    from vectorloom.plans.components import label_components

    while True:
        a = np.repeat(np.arange(len(graph)), [len(g) for g in graph])
        lab = label_components(len(graph), a, np.concatenate(graph) if len(a) else a)
        others = np.unique(lab[lab != 0])
        if not len(others):
            return graph
        inside, rows = np.flatnonzero(lab == 0), np.flatnonzero(lab != 0)
        near, at = np.empty(len(rows)), np.empty(len(rows), dtype=np.int64)
        for i in range(0, len(rows), 256):
            d = coarse(measure(m[rows[i : i + 256]], m[inside]))
            at[i : i + 256] = inside[d.argmin(1)]
            near[i : i + 256] = d.min(1)
        order = np.lexsort((rows, near, lab[rows]))
        for i in order[np.unique(lab[rows][order], return_index=True)[1]].tolist():
            x, y = int(rows[i]), int(at[i])
            graph[x], graph[y] = np.r_[graph[x], y], np.r_[graph[y], x]


def padded(graph: list[np.ndarray]) -> np.ndarray:
    """Adjacency as a matrix; missing entries are -1."""
    top = max((len(g) for g in graph), default=0)
    out = np.full((len(graph), max(top, 1)), -1, dtype=np.int64)
    for i, g in enumerate(graph):
        out[i, : len(g)] = g
    return out


def beam(q: np.ndarray, m: np.ndarray, graph: np.ndarray, seeds: np.ndarray, itopk: int, width: int, max_iterations: int, measure) -> tuple[np.ndarray, np.ndarray]:
    """Best-first search for all rows of q at once: (row numbers, distances), sorted, -1 and inf where there are fewer than itopk.

    Every round expands the width best unexpanded nodes of each query's buffer of itopk.
    """
    nq, n = len(q), len(m)
    seen = np.zeros((nq, n), dtype=bool)
    who, d = np.full((nq, itopk), -1, dtype=np.int64), np.full((nq, itopk), np.inf)
    done = np.ones((nq, itopk), dtype=bool)

    def offer(rows: np.ndarray, nodes: np.ndarray) -> None:
        """nodes: candidates of the queries rows, -1 where there is none."""
        ok = nodes >= 0
        ok[ok] = ~seen[np.broadcast_to(rows[:, None], nodes.shape)[ok], nodes[ok]]
        by = np.sort(np.where(ok, nodes, n), axis=1)
        by[:, 1:][by[:, 1:] == by[:, :-1]] = n
        r, c = np.nonzero(by < n)
        cand = by[r, c]
        seen[rows[r], cand] = True
        new = np.full(nodes.shape, np.inf)
        new[r, c] = indexed_distance(q, m, rows[r], cand, measure)
        ids = np.where(by < n, by, -1)
        better = (new <= d[rows, -1:]) & (ids >= 0)
        some = better.any(axis=1)  # the buffers of the others stay
        rows, new, ids = rows[some], new[some], ids[some]
        all_d, all_w = np.concatenate([d[rows], new], axis=1), np.concatenate([who[rows], ids], axis=1)
        all_done = np.concatenate([done[rows], ~np.isfinite(new)], axis=1)
        order = np.lexsort((all_w, all_d), axis=1)[:, :itopk]
        d[rows], who[rows], done[rows] = (np.take_along_axis(x, order, axis=1) for x in (all_d, all_w, all_done))

    offer(np.arange(nq), seeds)
    for _ in range(max_iterations):
        live = np.flatnonzero((~done).any(axis=1))
        if not len(live):
            break
        parents = done[live].argmin(axis=1)[:, None] if width == 1 else np.argsort(done[live], axis=1, kind="stable")[:, :width]
        open_ = ~np.take_along_axis(done[live], parents, axis=1)
        nodes = np.take_along_axis(who[live], parents, axis=1)
        mark = done[live]
        np.put_along_axis(mark, parents, True, axis=1)
        done[live] = mark
        offer(live, np.where(open_[:, :, None], graph[np.maximum(nodes, 0)], -1).reshape(len(live), -1))
    return who, d


def indexed_distance(q: np.ndarray, m: np.ndarray, i: np.ndarray, j: np.ndarray, measure) -> np.ndarray:
    """measure of q[i] and m[j], pair by pair; only some thousands of pairs are in memory at a time."""
    of = measure.pairs if measure.rowwise else lambda x, y: pair_distance(x, y, measure)
    return np.concatenate([of(q[i[a : a + PAIRS]], m[j[a : a + PAIRS]]) for a in range(0, len(i), PAIRS)]) if len(i) else np.zeros(0)


def pair_distance(x: np.ndarray, y: np.ndarray, measure) -> np.ndarray:
    """measure of x[i] and y[i]."""
    out = np.empty(len(x))
    for i in range(0, len(x), 64):
        out[i : i + 64] = np.diagonal(measure(x[i : i + 64], y[i : i + 64]))
    return out


def medoid(m: np.ndarray) -> int:
    return int(((m - m.mean(0)) ** 2).sum(1).argmin())


def robust_prune(node: int, cand: np.ndarray, m: np.ndarray, degree: int, alpha: float) -> np.ndarray:
    """Neighbours chosen from candidates by distance, unless one chosen before is closer to them by the factor alpha.

    alpha rises from 1 in steps of 1.2 until degree are chosen.
    """
    cand = np.unique(cand[(cand >= 0) & (cand != node)])
    if not len(cand):
        return cand
    d = np.sqrt(((m[cand] - m[node]) ** 2).sum(1))
    order = np.lexsort((cand, d))
    cand, d = cand[order], d[order]
    between = np.sqrt(np.maximum(((m[cand][:, None, :] - m[cand][None, :, :]) ** 2).sum(2), 1e-30))
    occlusion, chosen, taken, now = np.zeros(len(cand)), [], np.zeros(len(cand), dtype=bool), 1.0
    while now <= alpha * (1 + 1e-9) and len(chosen) < degree:
        for i in range(len(cand)):
            if len(chosen) >= degree:
                break
            if taken[i] or occlusion[i] > now:
                continue
            chosen.append(i)
            taken[i] = True
            later = np.arange(i + 1, len(cand))
            occlusion[later] = np.maximum(occlusion[later], d[later] / between[i, later])
        now *= 1.2
    return cand[chosen]


def vamana_graph(m: np.ndarray, degree: int, visited: int, alpha: float, iters: int, max_fraction: float, rng: np.random.Generator) -> list[np.ndarray]:
    """Batches of growing size are searched from the medoid, pruned, linked back and pruned again."""
    n, measure, start = len(m), Measure("sqeuclidean"), medoid(m)
    graph: list[np.ndarray] = [np.zeros(0, np.int64) for _ in range(n)]
    for _ in range(max(1, iters)):
        order, at, size = rng.permutation(n), 0, 1
        while at < n:
            batch = order[at : at + size]
            at, size = at + size, min(size * 2, max(1, int(max_fraction * n)))
            who, _ = beam(m[batch], m, padded(graph), np.full((len(batch), 1), start), visited, 4, 4 * visited, measure)
            back: dict[int, list[int]] = {}
            for x, found in zip(batch.tolist(), who, strict=True):
                graph[x] = robust_prune(x, np.r_[found, graph[x]], m, degree, alpha)
                for y in graph[x].tolist():
                    back.setdefault(y, []).append(x)
            for y, xs in back.items():
                joined = np.unique(np.r_[graph[y], xs])
                graph[y] = joined if len(joined) <= degree else robust_prune(y, joined, m, degree, alpha)
    return graph


def packed_row(shard: int, ids: np.ndarray, level: np.ndarray, m: np.ndarray, degrees: np.ndarray, links: np.ndarray, labels: np.ndarray | None = None) -> pa.RecordBatch:
    """One shard as a row; vectors are kept in 32 bits where that loses nothing, codes in as few bytes as hold them."""
    if labels is None:
        small = m.astype("<f4")
        values = small if (small == m).all() else m.astype("<f8")
    else:
        values = m.astype("<u1" if m.max(initial=0) < 256 else "<u2")
    cells = [ids.astype("<i8"), level.astype("<i4"), (labels if labels is not None else ids[:0]).astype("<i4"), values, degrees.astype("<i4"), links.astype("<i4")]
    return pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([m.shape[1]], pa.int32()), *(pa.array([c.tobytes()], pa.binary()) for c in cells)], schema=PACKED_SCHEMA)


class Shard:
    """The arrays of a packed row, by ascending id; under a quantiser its vectors are decoded."""

    def __init__(self, batch: pa.RecordBatch, i: int, quantizer: ProductQuantizer | None = None):
        row = {c: batch.column(c)[i].as_py() for c in batch.schema.names}
        self.number, self.ids = row["shard"], np.frombuffer(row["ids"], "<i8")
        self.level, self.degrees, self.links = (np.frombuffer(row[c], "<i4") for c in ("levels", "degrees", "links"))
        n, size = len(self.ids), len(row["vectors"]) // max(1, len(self.ids) * row["dim"])
        kind = {1: "<u1", 2: "<u2"}[size] if quantizer else {4: "<f4", 8: "<f8"}[size]
        m = np.frombuffer(row["vectors"], kind).reshape(n, row["dim"])
        self.m = quantizer.decode(m.astype(int), np.frombuffer(row["labels"], "<i4")) if quantizer else m.astype(np.float64)

    def graph(self) -> list[np.ndarray]:
        """Positions of the neighbours of every row."""
        return np.split(self.links, np.cumsum(self.degrees)[:-1])


def _grouped(t: pa.Table) -> tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(shard, ids, levels, vectors, degrees, links) of the rows (GRAPH) of a shard; edges that leave it are left out."""
    t = t.sort_by("id")
    ids, lists = t["id"].to_numpy(), t["neighbors"].combine_chunks()
    flat, row = lists.flatten().to_numpy(), np.repeat(np.arange(len(ids)), np.diff(lists.offsets.to_numpy()))
    at = np.minimum(np.searchsorted(ids, flat), len(ids) - 1)
    inside = ids[at] == flat
    return t["shard"][0].as_py(), ids, t["level"].to_numpy(), matrix(t["vector"].combine_chunks()), np.bincount(row[inside], minlength=len(ids)), at[inside]


def _pack(nodes: DataFrame) -> DataFrame:
    """A row for each shard from a row for each vector (GRAPH)."""
    return nodes.groupBy("shard").applyInArrow(lambda t: pa.Table.from_batches([packed_row(*_grouped(t))]), PACKED)


@dataclass
class GraphIndex:
    """Shards of vectors with their neighbours (PACKED); a row's level is the highest layer that holds it (0: the base alone)."""

    spark: SparkSession
    packed: DataFrame
    metric: str
    params: dict = field(default_factory=dict)
    quantizer: ProductQuantizer | None = None

    @property
    def nodes(self) -> DataFrame:
        """(shard, id, level, vector, neighbors) of every row."""
        sent = share(self.spark, self.quantizer)

        def run(batches):
            for b in batches:
                for j in range(b.num_rows):
                    s = Shard(b, j, sent.value)
                    graph = s.graph()
                    for i in range(0, len(s.ids), 4096):
                        part = slice(i, i + 4096)
                        links = pa.array([s.ids[g].tolist() for g in graph[part]], type=pa.list_(pa.int64()))
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(links), s.number, np.int32)), pa.array(s.ids[part]), pa.array(s.level[part]), vectors(s.m[part]), links], names=["shard", "id", "level", "vector", "neighbors"])

        return self.packed.mapInArrow(run, GRAPH)

    def _places(self) -> DataFrame:
        """(shard, id) of every row, without reading vectors or links."""

        def run(batches):
            for b in batches:
                for number, ids in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                    at = np.frombuffer(ids, "<i8")
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), number, np.int32)), pa.array(at)], names=["shard", "id"])

        return self.packed.select("shard", "ids").mapInArrow(run, "shard int, id long")

    def _of(self, nodes: DataFrame):
        """This index with other rows (GRAPH), coded again if it is compressed."""
        out = replace(self, packed=_pack(nodes), quantizer=None)
        return out.compressed(self.quantizer) if self.quantizer else out

    def search(self, queries: DataFrame, k: int, itopk_size: int = 64, search_width: int = 1, max_iterations: int = 0, num_random_samplings: int = 1, seed: int = 0x128394, allow: DataFrame | None = None, mask: Callable | None = None) -> DataFrame:
        """(query_id, rank, id, distance) of beam searches in all shards.

        allow: ids that may be returned; mask: a NumPy predicate over (query ids, ids), each pair of a matrix of them;
        rows that are ruled out are still walked over.
        """
        itopk = max(itopk_size, k)
        packed = self.packed.withColumn("allowed", F.lit(None).cast("array<bigint>"))
        if allow is not None:
            ids = allow.select(F.col("id").cast("long").alias("id")).distinct()
            mine = self._places().join(ids, "id", "left_semi").groupBy("shard").agg(F.collect_list("id").alias("allowed"))  # at most a shard's rows
            packed = self.packed.join(mine, "shard")
        measure = Measure(self.metric)

        coder = share(self.spark, self.quantizer)

        def shard(s: Shard, ok: np.ndarray, qid: np.ndarray, q: np.ndarray) -> Iterator[pa.RecordBatch]:
            # equal rows are one node, whose results are all of them
            first = first_equal(s.m)
            kept = np.unique(first)
            m, graph, n_nodes = s.m[kept], joined(s.graph(), first, kept), len(kept)
            order = np.lexsort((s.ids, first))
            order = order[ok[order]]
            start = np.searchsorted(first[order], kept)
            count = np.searchsorted(first[order], kept, "right") - start
            rng = np.random.default_rng(seed)
            upper = np.searchsorted(kept, np.unique(first[s.level > 0]))
            # a buffer that is enough for a small shard finds a smaller share of the neighbours in a larger one
            size = max(itopk if ok.all() and mask is None else itopk * 4, int(itopk * n_nodes / BUFFER_ROWS))
            rounds = max_iterations or 4 * size // max(1, search_width) + 16
            step = max(1, min(20_000_000 // n_nodes, 500_000 // size))
            for i in range(0, len(qid), step):
                part = q[i : i + step]
                if len(upper):
                    _, c = smallest(coarse(measure(part, m[upper])), upper, min(len(upper), 4))
                    seeds = upper[c].reshape(len(part), -1)
                else:
                    n = min(n_nodes, num_random_samplings * max(32, int(4 * np.sqrt(n_nodes))))
                    seeds = np.tile(rng.choice(n_nodes, n, replace=False), (len(part), 1))
                who, d = beam(part, m, graph, seeds, size, search_width, rounds, measure)
                r, c = np.nonzero(who >= 0)
                node, near = who[r, c], d[r, c]
                many = count[node] if mask is not None else np.minimum(count[node], k)
                at = np.repeat(np.arange(len(node)), many)
                row, id = r[at], s.ids[order[start[node[at]] + np.arange(len(at)) - np.repeat(np.cumsum(many) - many, many)]]
                best = Best(len(part), k)
                if mask is not None:
                    may = np.asarray(mask(qid[i : i + step][row][:, None], id[:, None]), dtype=bool)[:, 0]
                    row, id, at = row[may], id[may], at[may]
                best.add(row, id, near[at])
                row, id, d = best.all()
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (qid[i : i + step][row], id, d)], schema=NEIGHBOR_SCHEMA)

        def work(block: list[np.ndarray], batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for j in range(b.num_rows):
                    s, may = Shard(b, j, coder.value), b.column("allowed")[j]
                    yield from shard(s, np.isin(s.ids, may.values.to_numpy()) if may.is_valid else np.ones(len(s.ids), dtype=bool), *block)

        def parts() -> int:
            n, most = packed.agg(F.count(F.lit(1)), F.max(F.octet_length("ids") / 8 * F.col("dim"))).first()
            return int(-(-n * (most or 0) // MAX_PART_FLOATS))

        found = rank_rows(meet(vectors_of(queries), packed, work, NEIGHBORS, "shard", parts), k)
        return found.select("query_id", "rank", "id", (-F.col("distance") if measure.negated else F.col("distance")).alias("distance"))

    def edges(self) -> DataFrame:
        """(src, rank, dst) of all shards."""
        return self.nodes.select(F.col("id").alias("src"), F.posexplode("neighbors").alias("rank", "dst")).select("src", (F.col("rank") + 1).alias("rank"), "dst")

    def dataset(self) -> DataFrame:
        return self.nodes.select("id", "vector")

    def extend(self, data: DataFrame):
        """More rows as shards of their own; compact() merges them."""
        top = self.packed.agg(F.max("shard")).first()[0]
        more = _build(data, self.metric, self.params)
        if self.quantizer:
            more = more.compressed(self.quantizer)
        moved = more.packed.withColumn("shard", (F.col("shard") + ((top if top is not None else -1) + 1)).cast("int"))
        return replace(self, packed=self.packed.unionByName(moved))

    def compact(self):
        """The index built again over all its rows."""
        return _build(self.dataset(), self.metric, self.params)

    def with_dataset(self, data: DataFrame):
        """The same graph over other vectors."""
        return replace(self, packed=_pack(self.nodes.drop("vector").join(vectors_of(data), "id").select("shard", "id", "level", "vector", "neighbors")), quantizer=None)

    def with_graph(self, graph: DataFrame):
        """Other edges (src, rank, dst) over the same vectors; those that leave a shard are left out."""
        links = graph.groupBy(F.col("src").alias("id")).agg(F.array_sort(F.collect_list(F.struct("rank", "dst"))).alias("e")).select("id", F.col("e.dst").alias("neighbors"))
        nodes = self.nodes.drop("neighbors").join(links, "id", "left")
        return self._of(nodes.select("shard", "id", "level", "vector", F.coalesce("neighbors", F.array().cast("array<bigint>")).alias("neighbors")))

    def with_ids(self, names: DataFrame):
        """Rows renamed by a table (id, new_id)."""
        names = cut_lineage(names.select(F.col("id").cast("long").alias("id"), F.col("new_id").cast("long").alias("new_id")))
        links = self.nodes.select("id", F.posexplode_outer("neighbors").alias("rank", "dst")).join(names.select(F.col("id").alias("dst"), F.col("new_id").alias("to")), "dst", "left").groupBy("id").agg(F.array_sort(F.collect_list(F.when(F.col("to").isNotNull(), F.struct("rank", "to")))).alias("e"))
        nodes = self.nodes.drop("neighbors").join(links, "id").join(names, "id")
        return self._of(nodes.select("shard", F.col("new_id").alias("id"), "level", "vector", F.col("e.to").alias("neighbors")))

    def compressed(self, quantizer: ProductQuantizer):
        """The index with product codes in place of its vectors; searches rank by decoded distances, refine() restores order."""
        if self.metric not in ("sqeuclidean", "L2Expanded"):
            raise ValueError("only squared L2 is supported")
        sent = share(self.spark, (self.quantizer, quantizer))

        def run(batches):
            old, new = sent.value
            for b in batches:
                for j in range(b.num_rows):
                    s = Shard(b, j, old)
                    labels = new.labels(s.m)
                    yield packed_row(s.number, s.ids, s.level, new.encode(s.m, labels), s.degrees, s.links, labels)

        return replace(self, packed=self.packed.mapInArrow(run, PACKED), quantizer=quantizer)

    def save(self, path: str) -> None:
        tables, params, q = {"packed": self.packed}, {"metric": self.metric, "build": self.params}, self.quantizer
        if q:
            params["codes"] = {"dim": q.dim, "codebooks": list(q.codebooks.shape), "centers": list(q.centers.shape) if q.centers is not None else None}
            tables |= {"codebooks": store.matrix_table(self.spark, q.codebooks)}
            tables |= {"centers": store.matrix_table(self.spark, q.centers)} if q.centers is not None else {}
        store.save(self.spark, path, "packed graph", params, tables)

    @classmethod
    def load(cls, spark: SparkSession, path: str):
        p, q = store.load_params(spark, path, "packed graph"), None
        if c := p.get("codes"):
            centers = store.load_matrix(spark, f"{path}/centers", c["centers"]) if c["centers"] else None
            q = ProductQuantizer(store.load_matrix(spark, f"{path}/codebooks", c["codebooks"]), centers, c["dim"])
        return cls(spark, spark.read.parquet(f"{path}/packed").select(*PACKED_SCHEMA.names), p["metric"], p["build"], q)


def _build(data: DataFrame, metric: str, params: dict) -> GraphIndex:
    rows = vectors_of(data)
    n = rows.count()
    shards = max(1, -(-n // params["shard_rows"]))
    measure, kind = Measure(metric), params["kind"]

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by("id")
        ids, m, shard = t["id"].to_numpy(), matrix(t["vector"].combine_chunks()), t["shard"][0].as_py()
        rng = np.random.default_rng(params["seed"])
        first = first_equal(m)  # the graph is one of distinct rows; equal ones have the links of the first of them
        kept, every, m = np.unique(first), m, m[np.unique(first)]
        level = np.zeros(len(m), dtype=np.int32)
        if kind == "vamana":
            graph = vamana_graph(m, params["graph_degree"], params["visited_size"], params["alpha"], params["vamana_iters"], params["max_fraction"], rng)
            level[medoid(m)] = 1
        else:
            near = exact_graph(m, params["intermediate_graph_degree"], measure)
            graph = reverse_merge(prune_detours(near, params["graph_degree"])) if near.shape[1] else [np.zeros(0, np.int64) for _ in m]
            if params["guarantee_connectivity"]:
                graph = connect(m, graph, measure)
            if kind == "hnsw":
                level = np.floor(-np.log(np.maximum(rng.random(len(m)), 1e-12)) / np.log(max(2, params["graph_degree"] // 2))).astype(np.int32)
                level[medoid(m)] = max(1, int(level.max()))
        of = np.searchsorted(kept, first)
        graph = [kept[graph[i]] for i in of.tolist()]
        return pa.Table.from_batches([packed_row(shard, ids, np.where(kept[of] == np.arange(len(ids)), level[of], 0), every, np.array([len(g) for g in graph]), np.concatenate(graph))])

    dealt = rows.withColumn("shard", F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int"))
    return GraphIndex(data.sparkSession, dealt.groupBy("shard").applyInArrow(run, PACKED), metric, params)


def build_cagra(data: DataFrame, metric: str = "sqeuclidean", intermediate_graph_degree: int = 128, graph_degree: int = 64, guarantee_connectivity: bool = False, shard_rows: int = SHARD_ROWS, seed: int = 0) -> GraphIndex:
    """Exact kNN graphs per shard, pruned by detours and merged with their reversals; degrees are cut to n - 1."""
    return _build(data, metric, {"kind": "cagra", "intermediate_graph_degree": max(intermediate_graph_degree, graph_degree), "graph_degree": graph_degree, "guarantee_connectivity": guarantee_connectivity, "shard_rows": shard_rows, "seed": seed})


def build_hnsw(data: DataFrame, metric: str = "sqeuclidean", M: int = 32, ef_construction: int = 200, shard_rows: int = SHARD_ROWS, seed: int = 0) -> GraphIndex:
    """The base layer is a pruned graph of degree 2 M; searches enter through the rows of the layers above."""
    if ALIASES.get(metric, metric) not in ("L2Expanded", "InnerProduct"):
        raise ValueError("L2Expanded and InnerProduct are supported")
    return _build(data, metric, {"kind": "hnsw", "intermediate_graph_degree": min(ef_construction, 4 * M), "graph_degree": 2 * M, "guarantee_connectivity": True, "shard_rows": shard_rows, "seed": seed})


def hnsw_params(M: int, ef_construction: int, same_footprint: bool = True) -> dict:
    """Degrees of a pruned graph of the size (or the search quality) that M and ef_construction stand for."""
    degree = 2 * M if same_footprint else 2 * M + M // 2
    return {"graph_degree": degree, "intermediate_graph_degree": max(degree, min(ef_construction, 3 * M))}


def build_vamana(data: DataFrame, graph_degree: int = 32, visited_size: int = 64, alpha: float = 1.2, vamana_iters: int = 1, max_fraction: float = 0.06, shard_rows: int = SHARD_ROWS, seed: int = 0) -> GraphIndex:
    """Graphs by incremental insertion with robust pruning; squared L2 only."""
    return _build(data, "sqeuclidean", {"kind": "vamana", "graph_degree": graph_degree, "visited_size": visited_size, "alpha": alpha, "vamana_iters": vamana_iters, "max_fraction": max_fraction, "shard_rows": shard_rows, "seed": seed})


def _near_shards(rows: DataFrame, n: int, shard_rows: int) -> DataFrame:
    """Rows with a shard: those of a cell lie together, cells of more than shard_rows rows are split by a hash of id."""
    _, m = sample(rows, 50_000, 0)
    sent = share(rows.sparkSession, balanced(m, min(MAX_CELLS, -(-2 * n // shard_rows), len(m)), 10, 0))

    def run(batches):
        for b in batches:
            if b.num_rows:
                cell = coarse(squared(matrix(b.column(1)), sent.value)).argmin(1)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell.astype(np.int32))], names=["id", "vector", "cell"])

    placed = rows.mapInArrow(run, "id long, vector array<double>, cell int")
    sizes = {r["cell"]: r["count"] for r in placed.groupBy("cell").count().collect()}  # at most MAX_CELLS rows
    parts = np.array([-(-sizes.get(c, 0) // shard_rows) for c in range(len(sent.value))])
    first = np.cumsum(parts) - parts
    start, width = (F.element_at(F.lit(x.tolist()), F.col("cell") + 1) for x in (first, np.maximum(parts, 1)))
    return placed.select("id", "vector", (start + F.pmod(F.xxhash64("id"), width)).cast("int").alias("shard"))


def memory_estimate(n: int, dim: int, graph_degree: int = 64, intermediate_graph_degree: int = 128, shard_rows: int = SHARD_ROWS, value_bytes: int = 4) -> dict[str, int]:
    """Bytes of an index of n rows, of one of its shards, and of what a task holds at most while it builds or searches one.

    value_bytes: 4 for vectors that 32 bits hold, else 8. A task's vectors have 64 bits, and blocks of distances come on top.
    """
    shards = max(1, -(-n // shard_rows))
    rows = -(-n // shards)
    row = dim * value_bytes + 4 * graph_degree + 16  # vector, links, id, level, degree
    held = rows * (8 * dim + 8 * (intermediate_graph_degree + 2 * graph_degree)) + 3 * 8 * 256 * rows
    return {"shards": shards, "index": n * row, "shard": rows * row, "task": held + rows * row}


def from_graph(graph: DataFrame, data: DataFrame, metric: str = "sqeuclidean", shard_rows: int = SHARD_ROWS) -> GraphIndex:
    """An index from a ranked graph (src, rank, dst) and its vectors.

    Up to shard_rows rows are one shard with the graph as it is. More rows are dealt to shards of rows that lie close to
    each other: edges within a shard are kept, in their order, those that leave it are replaced by the nearest rows of the shard.
    """
    rows = vectors_of(data)
    n, measure = rows.count(), Measure(metric)
    dealt = rows.withColumn("shard", F.lit(0)) if n <= shard_rows else _near_shards(rows, n, shard_rows)
    links = graph.groupBy(F.col("src").cast("long").alias("id")).agg(F.array_sort(F.collect_list(F.struct("rank", F.col("dst").cast("long").alias("dst")))).alias("e")).select("id", F.col("e.dst").alias("neighbors"))
    nodes = dealt.join(links, "id", "left").select("shard", "id", F.lit(0).alias("level"), "vector", F.coalesce("neighbors", F.array().cast("array<bigint>")).alias("neighbors"))

    def repaired(t: pa.Table) -> pa.Table:
        want = t.sort_by("id")["neighbors"].combine_chunks().value_lengths().to_numpy()
        shard, ids, level, m, degrees, links = _grouped(t)
        if (degrees < want).any():
            near, kept = exact_graph(m, int(want.max()), measure), np.split(links, np.cumsum(degrees)[:-1])
            out = [np.r_[g, near[i][~np.isin(near[i], g)]][:w] if len(g) < w else g for i, (g, w) in enumerate(zip(kept, want, strict=True))]
            degrees, links = np.array([len(g) for g in out]), np.concatenate(out)
        return pa.Table.from_batches([packed_row(shard, ids, level, m, degrees, links)])

    packed = _pack(nodes) if n <= shard_rows else nodes.groupBy("shard").applyInArrow(repaired, PACKED)
    return GraphIndex(data.sparkSession, packed, metric, {"kind": "cagra", "intermediate_graph_degree": 128, "graph_degree": 64, "guarantee_connectivity": False, "shard_rows": shard_rows, "seed": 0})


def merge(parts: list[GraphIndex], allow: DataFrame | None = None) -> GraphIndex:
    """One index built over the rows of several, or over those of them that allow names."""
    data = union([p.dataset() for p in parts])
    if allow is not None:
        data = data.join(allow.select(F.col("id").cast("long").alias("id")).distinct(), "id", "left_semi")
    return _build(data, parts[0].metric, parts[0].params)


def composite_search(parts: list[tuple], queries: DataFrame, k: int, larger: bool = False, **args) -> DataFrame:
    """One list per query from several indexes, (index, offset) each: ids are moved by the offset."""
    found = [ix.search(queries, k, **args).select("query_id", (F.col("id") + offset).alias("id"), "distance") for ix, offset in parts]
    return rank_rows(union(found), k, larger).select("query_id", "rank", "id", "distance")


def knn_graph_ivf_pq(data: DataFrame, k: int, n_lists: int, n_probes: int = 20, refine_ratio: int = 2, metric: str = "sqeuclidean", **args) -> DataFrame:
    """(src, rank, dst): an approximate self-kNN graph by product codes and exact refinement, loops left out."""
    from vectorloom.operators.ivf import build_pq
    from vectorloom.operators.neighbors import refine

    ix = build_pq(data, n_lists, metric, **args)
    found = ix.search(data, (k + 1) * refine_ratio, n_probes).where("query_id <> id")
    best = refine(data, data, found, k, metric)
    return best.select(F.col("query_id").alias("src"), "rank", F.col("id").alias("dst"))
