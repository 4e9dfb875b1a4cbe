"""Exact neighbours: top-k selection, k-nearest and range joins, graphs made of them, landmark pruning.

Tables are (id, vector); results are (query_id, rank, id, distance). Null ids and vectors take no part. A query
with fewer than k candidates has fewer rows. Equal distances are ordered by id.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vectorloom.functions.arrays import matrix
from vectorloom.functions.distances import distance, resolve
from vectorloom.operators.blocks import NEIGHBOR_SCHEMA, NEIGHBORS, Best, Measure, Near, gather, meet, pick, rank_rows, scan, share, union, vectors_of
from vectorloom.plans.components import connected_components
from vectorloom.runtime import cut_lineage


def select_k(values: DataFrame, k: int, select_min: bool = True, query_id: str = "query_id", id: str = "id", value: str = "distance") -> DataFrame:
    """The k smallest (or largest) values of every query, with their rank; ties by id, null values last."""
    order = F.col(value).asc_nulls_last() if select_min else F.col(value).desc_nulls_last()
    w = Window.partitionBy(query_id).orderBy(order, id)
    return values.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def merge_parts(parts: list[tuple[DataFrame, int]], k: int, select_min: bool = True) -> DataFrame:
    """One top-k list per query from lists over parts of the data, whose ids are moved by an offset each."""
    moved = [df.select("query_id", (F.col("id") + offset).alias("id"), "distance") for df, offset in parts]
    return select_k(union(moved), k, select_min)


def knn(
    queries: DataFrame,
    data: DataFrame,
    k: int,
    metric: str | Callable = "sqeuclidean",
    p: float = 2.0,
    allow: DataFrame | None = None,
    allow_pairs: DataFrame | None = None,
    mask: Callable | None = None,
) -> DataFrame:
    """The k nearest rows of data for every query.

    allow: ids that may be returned (a bitset); allow_pairs: (query_id, id) pairs that may (a bitmap);
    mask: a NumPy predicate over (query ids, ids). Filters act before distances are ranked. metric: a name or
    a function of two matrices whose small values are close.
    """
    queries, data = vectors_of(queries), vectors_of(data)
    if allow is not None:
        data = data.join(allow.select(F.col("id").cast("long").alias("id")).distinct(), "id", "left_semi")
    if allow_pairs is not None:
        if callable(metric):
            raise ValueError("a bitmap goes with a named metric")
        pairs = allow_pairs.select(F.col("query_id").cast("long").alias("query_id"), F.col("id").cast("long").alias("id")).distinct()
        met = pairs.join(queries.select(F.col("id").alias("query_id"), F.col("vector").alias("__q")), "query_id").join(data, "id")
        scored = met.select("query_id", "id", distance(metric, "__q", "vector", p).alias("distance"))
        return rank_rows(scored, k, resolve(metric).larger).select("query_id", "rank", "id", "distance")
    measure = Measure(metric, p)
    ruled = (lambda q, rows: mask(q[0], rows[0])) if mask else None
    return signed(rank_rows(scan(queries, data, k, measure, ruled), k), measure.negated)


def pad(found: DataFrame, queries: DataFrame, k: int, worst: float = float("inf")) -> DataFrame:
    """Every query with exactly k rows: missing ones have id -1 and the worst distance."""
    ranks = queries.select(F.col("id").cast("long").alias("query_id"), F.explode(F.sequence(F.lit(1), F.lit(k))).alias("rank"))
    out = ranks.join(found, ["query_id", "rank"], "left")
    return out.select("query_id", "rank", F.coalesce("id", F.lit(-1)).alias("id"), F.coalesce("distance", F.lit(worst)).alias("distance"))


def nearest(x: DataFrame, y: DataFrame, metric: str = "sqeuclidean", group: tuple[str, str] | None = None, different: bool = False) -> DataFrame:
    """(query_id, id, distance): the nearest row of y for every row of x.

    group: a column of x and one of y; only rows of equal groups meet (or of unequal ones, if different).
    """
    if group is None:
        return knn(x, y, 1, metric).drop("rank")
    measure = Measure(metric)
    if not different:
        xs = vectors_of(x, "id", "vector", F.col(group[0]).alias("g"))
        ys = vectors_of(y, "id", "vector", F.col(group[1]).alias("g"))
        met = xs.select(F.col("id").alias("query_id"), F.col("vector").alias("__q"), "g").join(ys, "g")
        scored = met.select("query_id", "id", distance(metric, "__q", "vector").alias("distance"))
        key = F.struct((-F.col("distance") if measure.negated else F.col("distance")).alias("d"), F.col("id").alias("i"))
        best = scored.groupBy("query_id").agg(F.min(key).alias("m"))
        return best.select("query_id", F.col("m.i").alias("id"), (-F.col("m.d") if measure.negated else F.col("m.d")).alias("distance"))
    xs, ys = (vectors_of(t, "id", "vector", F.col(g).cast("long").alias("g")) for t, g in zip((x, y), group, strict=True))
    found = scan(xs, ys, 1, measure, lambda q, rows: q[1][:, None] != rows[1][None, :])
    return signed(rank_rows(found, 1), measure.negated).drop("rank")


def signed(found: DataFrame, negated: bool) -> DataFrame:
    """Distances from what was ranked."""
    return found.select("query_id", "rank", "id", (-F.col("distance") if negated else F.col("distance")).alias("distance"))


def refine(data: DataFrame, queries: DataFrame, candidates: DataFrame, k: int, metric: str = "sqeuclidean") -> DataFrame:
    """Exact order of candidate pairs (query_id, id): the k best of every query. Unknown ids drop out; repeated pairs count once."""
    pairs = candidates.select(F.col("query_id").cast("long").alias("query_id"), F.col("id").cast("long").alias("id")).distinct()
    met = pairs.join(vectors_of(data), "id").join(vectors_of(queries).select(F.col("id").alias("query_id"), F.col("vector").alias("__q")), "query_id")
    scored = met.select("query_id", "id", distance(metric, "__q", "vector").alias("distance"))
    return rank_rows(scored, k, resolve(metric).larger).select("query_id", "rank", "id", "distance")


def pairwise(x: DataFrame, y: DataFrame, metric: str | Callable = "euclidean", p: float = 2.0) -> DataFrame:
    """(xid, yid, distance) of all pairs; x meets y block by block."""
    measure = metric if callable(metric) else (lambda a, b: resolve(metric).block(a, b, p))
    return _pairs(x, y, measure, None)


def _pairs(x: DataFrame, y: DataFrame, measure: Callable, limit: float | None) -> DataFrame:
    x, y = vectors_of(x), vectors_of(y)
    schema = pa.schema([("xid", pa.int64()), ("yid", pa.int64()), ("distance", pa.float64())])

    def work(block, batches):
        qid, q = block
        for batch in batches:
            if not batch.num_rows or not len(qid):
                continue
            ids, m = batch.column(0).to_numpy(), matrix(batch.column(1))
            step = max(1, 500_000 // len(ids))
            for i in range(0, len(qid), step):
                d = measure(q[i : i + step], m)
                r, c = np.nonzero(d <= limit) if limit is not None else (v.ravel() for v in np.indices(d.shape))
                yield pa.RecordBatch.from_arrays([pa.array(qid[i : i + step][r]), pa.array(ids[c]), pa.array(d[r, c])], schema=schema)

    return meet(x, y, work, "xid long, yid long, distance double")


def digest(x: DataFrame, y: DataFrame, metric: str | Callable = "euclidean", p: float = 2.0) -> DataFrame:
    """(query_id, n, mean, low, high) of the distances of every row of x to all rows of y; tasks return sums, not pairs."""
    measure = metric if callable(metric) else (lambda a, b: resolve(metric).block(a, b, p))

    def work(block, batches):
        qid, q = block[:2]
        sums = Digest(qid)
        for b in batches:
            m = matrix(b.column(1))
            for j in range(0, len(m) if len(qid) else 0, 4096):
                for i in range(0, len(qid), 128):
                    sums.add(i, measure(q[i : i + 128], m[j : j + 4096]))
        if len(qid) and sums.n[0]:
            yield sums.batch()

    return digested(meet(vectors_of(x), vectors_of(y), work, DIGESTS))


DIGESTS = "query_id long, n long, total double, low double, high double"
DIGEST_SCHEMA = pa.schema([("query_id", pa.int64()), ("n", pa.int64()), *((c, pa.float64()) for c in ("total", "low", "high"))])


class Digest:
    """Count, sum, least and greatest distance of every query of a block."""

    def __init__(self, qid: np.ndarray):
        self.qid, self.n = qid, np.zeros(len(qid), np.int64)
        self.total, self.low, self.high = np.zeros(len(qid)), np.full(len(qid), np.nan), np.full(len(qid), -np.inf)

    def add(self, i: int, d: np.ndarray) -> None:
        """Distances of the queries from i on."""
        part = slice(i, i + len(d))
        self.n[part] += d.shape[1]
        self.total[part] += d.sum(1)
        self.low[part] = np.fmin(self.low[part], np.fmin.reduce(d, axis=1))
        self.high[part] = np.maximum(self.high[part], d.max(1))

    def batch(self) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (self.qid, self.n, self.total, self.low, self.high)], schema=DIGEST_SCHEMA)


def digested(parts: DataFrame) -> DataFrame:
    """The digests of all tasks by query."""
    return parts.groupBy("query_id").agg(F.sum("n").alias("n"), (F.sum("total") / F.sum("n")).alias("mean"), F.min("low").alias("low"), F.max("high").alias("high"))


def eps_neighborhood(x: DataFrame, y: DataFrame, eps: float, metric: str = "sqeuclidean") -> DataFrame:
    """(xid, yid, distance) of all pairs within eps; for the default metric eps is a squared radius."""
    return _pairs(x, y, lambda a, b: resolve(metric).block(a, b, 2.0), eps)


def eps_degrees(pairs: DataFrame) -> DataFrame:
    """(xid, degree) of the pairs of eps_neighborhood() and, with a null xid, their total."""
    return pairs.groupBy("xid").agg(F.count(F.lit(1)).alias("degree")).unionByName(pairs.agg(F.count(F.lit(1)).alias("degree")).select(F.lit(None).cast("long").alias("xid"), "degree"))


def all_neighbors(data: DataFrame, k: int, metric: str = "sqeuclidean", n_clusters: int = 1, overlap_factor: int = 2, max_group: int = 4096, seed: int = 0) -> DataFrame:
    """The k nearest rows of every row, itself included.

    n_clusters = 1 is exact. Otherwise rows are copied to their overlap_factor nearest of n_clusters centres and
    compared within clusters only, those with more than max_group rows in blocks; the lists are merged.
    """
    if n_clusters <= 1:
        return knn(data, data, k, metric)
    from vectorloom.operators.kmeans import assign_top, balanced_fit

    rows = vectors_of(data)
    centers = balanced_fit(rows, n_clusters, seed=seed)
    dealt = cut_lineage(assign_top(rows, centers, min(overlap_factor, n_clusters)).join(rows, "id"))
    measure = Measure(metric)
    sizes = dealt.groupBy("label").agg(F.count(F.lit(1)).alias("n")).withColumn("cuts", F.ceil(F.col("n") / max_group).cast("int"))
    placed = dealt.join(F.broadcast(sizes.select("label", "cuts")), "label").withColumn("part", F.pmod(F.xxhash64("id"), F.col("cuts")).cast("int"))
    queries = placed.select("label", F.col("part").alias("qpart"), F.explode(F.sequence(F.lit(0), F.col("cuts") - 1)).alias("part"), F.col("id").alias("qid"), F.col("vector").alias("qvector"))

    def run(key, left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return NEIGHBOR_SCHEMA.empty_table()
        qid, ids = left["qid"].to_numpy(), right["id"].to_numpy()
        q, m = matrix(left["qvector"].combine_chunks()), matrix(right["vector"].combine_chunks())
        out = []
        for i in range(0, len(qid), 512):
            r, c, d = pick(measure, q[i : i + 512], m, ids, k)
            out.append(pa.table([qid[i : i + 512][r], ids[c], d], schema=NEIGHBOR_SCHEMA))
        return pa.concat_tables(out)

    keys = ["label", "part", "qpart"]
    data_side = placed.select("label", "part", F.explode(F.sequence(F.lit(0), F.col("cuts") - 1)).alias("qpart"), "id", "vector")
    queries = queries.toDF("qlabel", "qcell", "cell", "qid", "qvector")
    found = queries.groupBy("qlabel", "cell", "qcell").cogroup(data_side.groupBy(*keys)).applyInArrow(run, NEIGHBORS)
    once = found.groupBy("query_id", "id").agg(F.min("distance").alias("distance"))
    return signed(rank_rows(once, k), measure.negated)


def core_distances(neighbors: DataFrame, min_samples: int) -> DataFrame:
    """(id, core): the distance to the min_samples-th neighbour, the point itself being the first."""
    return neighbors.where(F.col("rank") == min_samples).select(F.col("query_id").alias("id"), F.col("distance").alias("core"))


def mutual_reachability(edges: DataFrame, cores: DataFrame, alpha: float = 1.0) -> DataFrame:
    """edges (src, dst, weight) reweighted to the greatest of both core distances and alpha times the weight."""
    a, b = cores.select(F.col("id").alias("src"), F.col("core").alias("__a")), cores.select(F.col("id").alias("dst"), F.col("core").alias("__b"))
    return edges.join(a, "src").join(b, "dst").select("src", "dst", F.greatest("__a", "__b", F.col("weight") * alpha).alias("weight"))


def knn_graph(data: DataFrame, c: int = 15, metric: str = "euclidean", k: int | None = None) -> DataFrame:
    """Symmetric graph (src, dst, weight) of the k nearest neighbours, without loops; k is floor(log2 n) + c, at most n and at least 2."""
    rows = vectors_of(data)
    n = rows.count()
    k = min(n, max(2, int(np.log2(max(n, 1))) + c)) if k is None else k
    found = knn(rows, rows, k, metric).where("query_id <> id").select(F.col("query_id").alias("src"), F.col("id").alias("dst"), F.col("distance").alias("weight"))
    return symmetric(found)


def symmetric(edges: DataFrame) -> DataFrame:
    """Both directions of every edge, with the greatest of their weights."""
    both = edges.unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight"))
    return both.groupBy("src", "dst").agg(F.max("weight").alias("weight"))


def cross_component_nn(data: DataFrame, component: str, metric: str = "sqeuclidean") -> DataFrame:
    """(component, src, dst, distance): for every component the nearest pair of rows with another one."""
    found = nearest(data, data, metric, (component, component), different=True)
    of = data.select(F.col("id").cast("long").alias("query_id"), F.col(component).cast("long").alias("component"))
    best = found.join(of, "query_id").groupBy("component").agg(F.min(F.struct("distance", "query_id", "id")).alias("m"))
    return best.select("component", F.col("m.query_id").alias("src"), F.col("m.id").alias("dst"), F.col("m.distance").alias("distance"))


def graph_components(edges: DataFrame) -> DataFrame:
    """(id, component) of the nodes of an edge table (src, dst, ...)."""
    return connected_components(edges).select(F.col("node").alias("id"), "component")


# landmarks


def build_landmarks(data: DataFrame, n_landmarks: int | None = None, seed: int = 12345, metric: str = "euclidean") -> tuple[DataFrame, DataFrame]:
    """Landmarks (lid, vector, radius) and members (id, vector, lid, reach): about sqrt(n) rows by a hash of id.

    reach is the distance of a row to its landmark, radius the greatest of a landmark's members.
    """
    rows = vectors_of(data)
    n = rows.count()
    m = n_landmarks or max(1, int(np.sqrt(max(n, 1))))
    picked = rows.orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(m)
    measure, sent = Measure(metric), share(data.sparkSession, gather(picked))

    def place(batches):
        lids, marks = sent.value
        for batch in batches:
            for i in range(0, batch.num_rows, 2048):
                part = batch.slice(i, 2048)
                _, c, d = pick(measure, matrix(part.column(1)), marks, lids, 1)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(lids[c]), pa.array(d)], names=["id", "vector", "lid", "reach"])

    members = cut_lineage(rows.mapInArrow(place, "id long, vector array<double>, lid long, reach double"))
    radius = members.groupBy("lid").agg(F.max("reach").alias("radius"))
    landmarks = cut_lineage(picked.select(F.col("id").alias("lid"), "vector").join(radius, "lid"))
    return landmarks, members


def _marks(landmarks: DataFrame, members: DataFrame):
    """Landmarks (ids, vectors, radii, members), which are few, to be sent."""
    sizes = members.groupBy("lid").agg(F.count(F.lit(1)).alias("n"))
    t = landmarks.join(sizes, "lid").select("lid", "vector", "radius", "n").toArrow().sort_by("lid")
    m = matrix(t["vector"].combine_chunks()) if t.num_rows else np.zeros((0, 0))
    return share(landmarks.sparkSession, (t["lid"].to_numpy(), m, t["radius"].to_numpy(), t["n"].to_numpy()))


def _tiles(block: list[np.ndarray], batches, lids: np.ndarray, alive: Callable):
    """(first query, queries, rows, their places among the landmarks, ids, vectors) where a landmark is alive for a query.

    alive(queries) rules landmarks out, a row for each query. Where few are left, each meets its own queries alone.
    """
    qid, q = block[:2]
    for batch in batches:
        if not batch.num_rows or not len(qid):
            continue
        ids, m, lid = batch.column(0).to_numpy(), matrix(batch.column(1)), np.searchsorted(lids, batch.column(2).to_numpy())
        order = np.argsort(lid, kind="stable")
        ids, m, lid = ids[order], m[order], lid[order]
        for j in range(0, len(ids), 8192):
            some, near = slice(j, j + 8192), lid[j : j + 8192]
            first, at, size = np.unique(near, return_index=True, return_counts=True)
            for i in range(0, len(qid), 256):
                may = alive(np.arange(i, min(i + 256, len(qid))))[:, first]
                if (may * size).sum() * 4 > len(may) * len(near):
                    yield np.arange(i, i + len(may)), ids[some], m[some], near
                    continue
                for x in np.flatnonzero(may.any(0)).tolist():
                    own = slice(j + at[x], j + at[x] + size[x])
                    yield i + np.flatnonzero(may[:, x]), ids[own], m[own], lid[own]


def landmark_knn(queries: DataFrame, landmarks: DataFrame, members: DataFrame, k: int, metric: str = "euclidean", weight: float = 1.0) -> DataFrame:
    """k nearest members of every query. With weight 1 the result is exact; a smaller one looks at fewer landmarks.

    A landmark's members count towards an upper bound of the k-th distance (d(q, l) + radius); landmarks whose
    lower bound d(q, l) - radius is beyond it, or beyond the k-th distance found so far, are skipped.
    """
    measure, sent = Measure(metric), _marks(landmarks, members)

    def work(block, batches):
        lids, marks, radius, sizes = sent.value
        qid, q = block
        if not len(lids) or not len(qid):
            return
        best, bound = Best(len(qid), k), np.full(len(qid), np.inf)
        for i in range(0, len(qid), 1024):
            high = resolve(metric).block(q[i : i + 1024], marks, 2.0) + radius
            order = np.argsort(high, axis=1, kind="stable")
            upto = np.cumsum(sizes[order], axis=1)
            enough = (upto >= k).argmax(1)[:, None]
            bound[i : i + 1024] = np.where(upto[:, -1] >= k, np.take_along_axis(np.take_along_axis(high, order, 1), enough, 1)[:, 0], np.inf)

        def alive(some):
            limit = bound[some] * weight
            if weight >= 1:
                limit = np.fmin(limit, best.values[some, -1])
            return resolve(metric).block(q[some], marks, 2.0) - radius <= (limit * (1 + 1e-9))[:, None] + 1e-9

        for some, ids, m, lid in _tiles(block, batches, lids, alive):
            ok = alive(some)[:, lid] if weight < 1 else None
            worst = best.values[some, -1]
            if Near.fits(measure, q[some], m):
                r, c, d = Near(m).pick(measure, q[some], ids, k, ok, worst)
            else:
                r, c, d = pick(measure, q[some], m, ids, k, ok, worst)
            best.add(some[r], ids[c], d)
        row, id, d = best.all()
        yield pa.RecordBatch.from_arrays([pa.array(qid[row]), pa.array(id), pa.array(d)], schema=NEIGHBOR_SCHEMA)

    found = meet(vectors_of(queries), members.select("id", "vector", "lid"), work, NEIGHBORS)
    return rank_rows(found, k).select("query_id", "rank", "id", "distance")


def landmark_eps(queries: DataFrame, landmarks: DataFrame, members: DataFrame, eps: float, metric: str = "euclidean") -> DataFrame:
    """(xid, yid, distance) of all members within eps (a radius, not squared) of a query; exact."""
    sent, slack, measure = _marks(landmarks, members), eps * (1 + 1e-9) + 1e-9, resolve(metric).block
    schema = pa.schema([("xid", pa.int64()), ("yid", pa.int64()), ("distance", pa.float64())])

    def work(block, batches):
        lids, marks, radius, _ = sent.value
        qid, q = block
        for some, ids, m, _ in _tiles(block, batches, lids, lambda some: measure(q[some], marks, 2.0) - radius <= slack):
            d = measure(q[some], m, 2.0)
            r, c = np.nonzero(d <= eps)
            yield pa.RecordBatch.from_arrays([pa.array(qid[some[r]]), pa.array(ids[c]), pa.array(d[r, c])], schema=schema)

    return meet(vectors_of(queries), members.select("id", "vector", "lid"), work, "xid long, yid long, distance double")


def udf_metric(element: Callable[[Column, Column, Column], Column], start: float = 0.0) -> Callable[[Column, Column], Column]:
    """A metric as a Column function, from its step (accumulator, x, y) over the components; ascending order."""

    def expression(x: Column, y: Column) -> Column:
        pairs = F.arrays_zip(x.cast("array<double>").alias("x"), y.cast("array<double>").alias("y"))
        return F.aggregate(pairs, F.lit(float(start)), lambda acc, v: element(acc, v["x"], v["y"]))

    return expression
