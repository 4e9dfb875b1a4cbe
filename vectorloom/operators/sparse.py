"""Sparse vectors: rows (id, indices ARRAY<INT>, values ARRAY<DOUBLE>), or cells (id, col, value) gathered to them.

A block of queries is broadcast; the components that a block of rows shares with it become dense, and what the
rows hold beside them counts through sums of the rows alone, so unions of components need no join.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vectorloom.functions.distances import ALIASES
from vectorloom.operators.blocks import NEIGHBOR_SCHEMA, NEIGHBORS, SPREAD_ROWS, Best, coarse, pick, rank_rows, share, union
from vectorloom.operators.neighbors import DIGESTS, Digest, digested

MAX_BLOCK_CELLS = 4_000_000
TILE, TILE_CELLS = 256, 100_000
LARGER = ("InnerProduct",)


def from_cells(cells: DataFrame, id: str = "id", col: str = "col", value: str = "value") -> DataFrame:
    """Rows from a table of cells; repeated cells add up, zeros go."""
    summed = cells.groupBy(F.col(id).cast("long").alias("id"), F.col(col).cast("int").alias("col")).agg(F.sum(F.col(value).cast("double")).alias("value")).where("value <> 0")
    rows = summed.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("col", "value"))).alias("c"))
    return rows.select("id", F.col("c.col").alias("indices"), F.col("c.value").alias("values"))


def from_dense(df: DataFrame, id: str = "id", vector: str = "vector") -> DataFrame:
    """Rows of the non-zero components, numbered from 0."""
    cells = F.filter(F.transform(F.col(vector).cast("array<double>"), lambda v, i: F.struct(i.alias("col"), v.alias("value"))), lambda c: c["value"] != 0)
    return df.select(F.col(id).cast("long").alias("id"), cells.alias("c")).select("id", F.col("c.col").alias("indices"), F.col("c.value").alias("values"))


class Rows:
    """A block of sparse rows, from list columns."""

    def __init__(self, ids: np.ndarray, indices: pa.Array, values: pa.Array):
        self.ids = ids
        self.row = np.repeat(np.arange(len(ids)), indices.value_lengths().to_numpy(zero_copy_only=False))
        self.col = indices.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        self.value = values.flatten().to_numpy(zero_copy_only=False).astype(np.float64)

    def sums(self, f: Callable[[np.ndarray], np.ndarray], keep: np.ndarray | None = None) -> np.ndarray:
        at = slice(None) if keep is None else keep
        return np.bincount(self.row[at], f(self.value[at]), len(self.ids))

    def part(self, a: int, b: int) -> Rows:
        out = object.__new__(Rows)
        lo, hi = np.searchsorted(self.row, [a, b])
        out.ids, out.row, out.col, out.value = self.ids[a:b], self.row[lo:hi] - a, self.col[lo:hi], self.value[lo:hi]
        return out


def _log(v):
    return np.where(v == 0, 0.0, np.log(np.where(v == 0, 1.0, np.abs(v))))


def _joint(x: np.ndarray, y: np.ndarray, alone: np.ndarray, pair: Callable) -> np.ndarray:
    """Sums of pair(x, y) over all components: what each side has alone, and the pairs of two non-zero components."""
    own, other = pair(x, 0.0).sum(1), pair(0.0, y).sum(1) + alone
    total, size = own[:, None] + other[None, :], np.abs(own)[:, None] + np.abs(other)[None, :]
    for c in range(x.shape[1]):
        r, j = np.flatnonzero(x[:, c]), np.flatnonzero(y[:, c])
        if len(r) and len(j):
            a, b = x[r, c][:, None], y[j, c][None, :]
            total[r[:, None], j[None, :]] += pair(a, b) - pair(a, 0.0) - pair(0.0, b)
    total[np.abs(total) < 1e-12 * size] = 0.0  # equal rows
    return total


#: name: (term of a pair of components, term of a row's component alone, p) for metrics that are sums over components
SUMS = {
    "L1": (lambda x, y, p: np.abs(x - y), lambda y, p: np.abs(y)),
    "Canberra": (lambda x, y, p: np.abs(x - y) / np.where(np.abs(x) + np.abs(y) == 0, 1.0, np.abs(x) + np.abs(y)), lambda y, p: (y != 0).astype(float)),
    "LpUnexpanded": (lambda x, y, p: np.abs(x - y) ** p, lambda y, p: np.abs(y) ** p),
    "HammingUnexpanded": (lambda x, y, p: (x != y).astype(float), lambda y, p: (y != 0).astype(float)),
    "JensenShannon": (lambda x, y, p: -x * (_log((x + y) / 2) - _log(x)) - y * (_log((x + y) / 2) - _log(y)), lambda y, p: -y * (_log(y / 2) - _log(y))),
}
EXPANDED = ("L2Expanded", "L2SqrtExpanded", "L2Unexpanded", "L2SqrtUnexpanded", "KLDivergence", "InnerProduct", "CosineExpanded", "CorrelationExpanded", "HellingerExpanded", "JaccardExpanded", "DiceExpanded", "RusselRaoExpanded")
METRICS = (*EXPANDED, *SUMS, "Linf")


def block(q: Rows, d: Rows, metric: str, n_cols: int, p: float = 2.0) -> np.ndarray:
    """Distances of all pairs of two blocks."""
    used, at = np.unique(q.col, return_inverse=True)
    x = np.zeros((len(q.ids), len(used)))
    x[q.row, at] = q.value
    where = np.minimum(np.searchsorted(used, d.col), max(len(used) - 1, 0))
    shared = used[where] == d.col if len(used) else np.zeros(len(d.col), dtype=bool)
    y = np.zeros((len(d.ids), len(used)))
    y[d.row[shared], where[shared]] = d.value[shared]
    if metric in SUMS:
        pair, alone = SUMS[metric]
        total = _joint(x, y, d.sums(lambda v: alone(v, p), ~shared), lambda a, b: pair(a, b, p))
        if metric == "LpUnexpanded":
            return total ** (1 / p)
        if metric == "HammingUnexpanded":
            return total / n_cols
        if metric == "JensenShannon":
            return np.sqrt(np.maximum(0.0, 0.5 * total))
        return total
    if metric == "Linf":
        rest = np.zeros(len(d.ids))
        np.maximum.at(rest, d.row[~shared], np.abs(d.value[~shared]))
        out, gap = np.repeat(rest[None, :], len(x), axis=0), np.empty((len(x), len(y)))
        for c in range(len(used)):
            np.abs(np.subtract.outer(x[:, c], y[:, c], out=gap), out=gap)
            np.maximum(out, gap, out=out)
        return out
    if metric == "KLDivergence":
        return 0.5 * ((x * _log(x)).sum(1)[:, None] - x @ _log(y).T)
    if metric == "HellingerExpanded":
        return np.sqrt(np.maximum(0.0, 1 - np.sqrt(np.abs(x)) @ np.sqrt(np.abs(y)).T))
    if metric == "CosineExpanded":
        nx, ny = np.sqrt(q.sums(np.square)), np.sqrt(d.sums(np.square))
        dot = (x / np.where(nx == 0, 1.0, nx)[:, None]) @ (y / np.where(ny == 0, 1.0, ny)[:, None]).T
        out = np.subtract(1, dot, out=dot)
        out[np.ix_(nx == 0, ny == 0)] = 0.0
        return out
    dot = x @ y.T
    if metric == "InnerProduct":
        return dot
    if metric == "RusselRaoExpanded":
        return (n_cols - dot) / n_cols
    if metric in ("JaccardExpanded", "DiceExpanded"):
        n = q.sums(lambda v: (v != 0).astype(float))[:, None] + d.sums(lambda v: (v != 0).astype(float))[None, :]
        low, high = (n - dot, dot) if metric == "JaccardExpanded" else (n, 2 * dot)
        return np.where(low == 0, 0.0, 1 - high / np.where(low == 0, 1.0, low))
    if metric == "CorrelationExpanded":
        sx, sy = q.sums(lambda v: v)[:, None], d.sums(lambda v: v)[None, :]
        vx, vy = n_cols * q.sums(np.square)[:, None] - sx * sx, n_cols * d.sums(np.square)[None, :] - sy * sy
        with np.errstate(divide="ignore", invalid="ignore"):
            return 1 - (n_cols * dot - sx * sy) / np.sqrt(vx * vy)
    nx, ny = q.sums(np.square)[:, None], d.sums(np.square)[None, :]
    out = np.maximum(0.0, nx + ny - 2 * dot)
    # the product cancels for near rows; those few are computed again
    r, c = np.nonzero(out < 1e-6 * (nx + ny))
    out[r, c] = ((x[r] - y[c]) ** 2).sum(1) + d.sums(np.square, ~shared)[c]
    return np.sqrt(out) if "Sqrt" in metric else out


def resolve(metric: str) -> str:
    name = ALIASES.get(metric, metric)
    if name not in METRICS:
        raise ValueError(f"metric {metric!r} is not supported for sparse vectors")
    return name


def _parts(queries: DataFrame) -> list[DataFrame]:
    cells = queries.agg(F.sum(F.size("indices") + 1)).first()[0] or 1
    n = max(1, -(-cells // MAX_BLOCK_CELLS))
    return [queries] if n == 1 else [queries.where(F.pmod(F.xxhash64("id"), F.lit(n)) == b) for b in range(n)]


def _valid(df: DataFrame) -> DataFrame:
    return df.select(F.col("id").cast("long").alias("id"), F.col("indices").cast("array<int>").alias("indices"), F.col("values").cast("array<double>").alias("values")).where("id IS NOT NULL AND indices IS NOT NULL AND values IS NOT NULL")


def _tiles(q: Rows) -> list[tuple[int, Rows]]:
    """A block of queries in tiles of up to TILE rows and a bounded number of cells, with the first row of each."""
    out, at = [], np.searchsorted(q.row, np.arange(len(q.ids) + 1))
    i = 0
    while i < len(q.ids):
        j = max(i + 1, min(i + TILE, int(np.searchsorted(at, at[i] + TILE_CELLS, "right")) - 1))
        out.append((i, q.part(i, j)))
        i = j
    return out


def _blocks(sent, batches, metric: str, n_cols: int, p: float):
    """(ids of queries, first query, ids of rows, distances) of every pair of blocks."""
    q = Rows(*sent.value)
    tiles = _tiles(q)
    for b in batches:
        if not b.num_rows or not len(q.ids):
            continue
        d = Rows(b.column(0).to_numpy(), b.column(1), b.column(2))
        for j in range(0, len(d.ids), 1024):
            part = d.part(j, min(j + 1024, len(d.ids)))
            for i, some in tiles:
                yield q.ids, i, part.ids, block(some, part, metric, n_cols, p)


def _sent(df: DataFrame, part: DataFrame):
    """The queries, to be sent, and the table, on all cores where they are many."""
    t = part.toArrow().combine_chunks()
    ids, indices, values = (c.chunk(0) if c.num_chunks else pa.array([], c.type) for c in t.columns)
    cores = df.sparkSession.sparkContext.defaultParallelism
    return share(df.sparkSession, (ids.to_numpy(), indices, values)), df.repartition(4 * cores) if len(ids) > SPREAD_ROWS else df


def pairwise(x: DataFrame, y: DataFrame, metric: str, n_cols: int, p: float = 2.0) -> DataFrame:
    """(xid, yid, distance) of all pairs of rows."""
    name, x, y = resolve(metric), _valid(x), _valid(y)
    schema = pa.schema([("xid", pa.int64()), ("yid", pa.int64()), ("distance", pa.float64())])

    def one(part: DataFrame) -> DataFrame:
        sent, rows = _sent(y, part)

        def run(batches):
            for qid, i, ids, d in _blocks(sent, batches, name, n_cols, p):
                r, c = (v.ravel() for v in np.indices(d.shape))
                yield pa.RecordBatch.from_arrays([pa.array(qid[i + r]), pa.array(ids[c]), pa.array(d[r, c])], schema=schema)

        return rows.mapInArrow(run, "xid long, yid long, distance double")

    return union([one(b) for b in _parts(x)])


def digest(x: DataFrame, y: DataFrame, metric: str, n_cols: int, p: float = 2.0) -> DataFrame:
    """(query_id, n, mean, low, high) of the distances of every row of x to all rows of y; tasks return sums, not pairs."""
    name, x, y = resolve(metric), _valid(x), _valid(y)

    def one(part: DataFrame) -> DataFrame:
        sent, rows = _sent(y, part)

        def run(batches):
            sums = None
            for qid, i, _, d in _blocks(sent, batches, name, n_cols, p):
                sums = sums or Digest(qid)
                sums.add(i, d)
            if sums is not None:
                yield sums.batch()

        return rows.mapInArrow(run, DIGESTS)

    return digested(union([one(b) for b in _parts(x)]))


def knn(queries: DataFrame, data: DataFrame, k: int, metric: str, n_cols: int, p: float = 2.0) -> DataFrame:
    """(query_id, rank, id, distance): the k nearest rows of every query; ties by id."""
    name, queries, data = resolve(metric), _valid(queries), _valid(data)
    sign = -1.0 if name in LARGER else 1.0

    def one(part: DataFrame) -> DataFrame:
        sent, rows = _sent(data, part)

        def run(batches):
            best, qid = None, np.zeros(0, np.int64)
            for qid, i, ids, d in _blocks(sent, batches, name, n_cols, p):
                best = best or Best(len(qid), k)
                r, c, near = pick(lambda x, _: x, coarse(sign * d), None, ids, k, worst=best.worst(i, i + len(d)))
                best.add(r + i, ids[c], near)
            if best is not None:
                row, id, d = best.all()
                yield pa.RecordBatch.from_arrays([pa.array(qid[row]), pa.array(id), pa.array(d)], schema=NEIGHBOR_SCHEMA)

        return rows.mapInArrow(run, NEIGHBORS)

    found = rank_rows(union([one(b) for b in _parts(queries)]), k)
    return found.select("query_id", "rank", "id", (F.col("distance") * sign).alias("distance"))
