"""Block execution: a query set, sent to the executors, meets the rows of a table where they lie.

A query set of at most about MAX_SENT_FLOATS numbers is broadcast (its size is bounded by that constant, not by the
data) and the table is scanned once. A larger one, such as the table itself, never passes the driver: both sides are cut
into parts of at most MAX_BLOCK_FLOATS numbers, and every pair of parts meets in a task of its own, of bounded memory.
There are at least as many pairs of parts as keep all cores busy. What a task returns is bounded by its queries x k and
merged by query in one exchange.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vectorloom.functions.arrays import matrix
from vectorloom.functions.distances import resolve

MAX_BLOCK_FLOATS = 8_000_000
MAX_SENT_FLOATS = 2_500_000
#: Query sets of more rows than this are work enough to deal the table out to all cores.
SPREAD_ROWS = 1500
CELLS = 2_000_000
EMPTY = np.iinfo(np.int64).max
NEIGHBORS = "query_id long, id long, distance double"
NEIGHBOR_SCHEMA = pa.schema([("query_id", pa.int64()), ("id", pa.int64()), ("distance", pa.float64())])


def vectors_of(df: DataFrame, id: str = "id", vector: str = "vector", *keep: str) -> DataFrame:
    """(id, vector, kept columns) without the rows whose id or vector is null."""
    out = df.select(F.col(id).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("vector"), *keep)
    return out.where(F.col("id").isNotNull() & F.col("vector").isNotNull())


def coarse(d: np.ndarray) -> np.ndarray:
    """Values rounded to 40 binary digits: equal up to rounding errors means equal. For choices, not for results."""
    bits = np.ascontiguousarray(d, dtype=np.float64).view(np.int64)
    low = np.int64((1 << 12) - 1)
    out = ((bits + (low >> 1) + 1) & ~low).view(np.float64)
    return np.where(np.isfinite(d), out, d)


class Measure:
    """A block function whose small values are close (negated where larger is closer).

    pairs() gives the same values row by row, by sums whose rounding does not depend on the block, so that equal
    vectors have equal distances wherever they lie; block values only choose candidates.
    """

    def __init__(self, metric: str | Callable, p: float = 2.0):
        self.name, self.p, self.negated, self.custom = metric, p, False, metric if callable(metric) else None
        if self.custom is None:
            m = resolve(metric)
            self.name, self.negated = m.name, m.larger
            self.rowwise = m.name in ROWWISE
        else:
            self.rowwise = False

    def __call__(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        if self.custom is not None:
            return self.custom(x, y)
        d = resolve(self.name).block(x, y, self.p)
        return -d if self.negated else d

    def pairs(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        d = ROWWISE[self.name](x, y)
        return -d if self.negated else d


def _cosine_pairs(x, y):
    with np.errstate(divide="ignore", invalid="ignore"):
        return 1 - (x * y).sum(1) / (np.sqrt((x * x).sum(1)) * np.sqrt((y * y).sum(1)))


def _correlation_pairs(x, y):
    k, sx, sy = x.shape[1], x.sum(1), y.sum(1)
    with np.errstate(divide="ignore", invalid="ignore"):
        return 1 - (k * (x * y).sum(1) - sx * sy) / np.sqrt((k * (x * x).sum(1) - sx * sx) * (k * (y * y).sum(1) - sy * sy))


def _l2_pairs(x, y):
    return ((x - y) ** 2).sum(1)


#: metrics whose block form is a matrix product
ROWWISE = {
    "L2Expanded": _l2_pairs,
    "L2Unexpanded": _l2_pairs,
    "L2SqrtExpanded": lambda x, y: np.sqrt(_l2_pairs(x, y)),
    "L2SqrtUnexpanded": lambda x, y: np.sqrt(_l2_pairs(x, y)),
    "InnerProduct": lambda x, y: (x * y).sum(1),
    "CosineExpanded": _cosine_pairs,
    "CorrelationExpanded": _correlation_pairs,
    "HellingerExpanded": lambda x, y: np.sqrt(np.maximum(0.0, 1 - (np.sqrt(x) * np.sqrt(y)).sum(1))),
}


def gather(df: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Ids and matrix of a bounded table (id, vector), in the order of ids."""
    t = df.toArrow()
    ids, m = t["id"].to_numpy(), matrix(t["vector"].combine_chunks()) if t.num_rows else np.zeros((0, 0))
    order = np.argsort(ids, kind="stable")
    return ids[order], m[order]


def n_blocks(rows: DataFrame, dim: int | None = None) -> int:
    """The number of parts of about MAX_BLOCK_FLOATS numbers that a table (id, vector, ...) is cut into."""
    n, size = rows.agg(F.count(F.lit(1)), F.max(F.size("vector"))).first()
    return max(1, -(-(n * (dim or size or 1)) // MAX_BLOCK_FLOATS))


def blocks(queries: DataFrame, dim: int | None = None) -> list[DataFrame]:
    """The query set in parts of bounded size."""
    parts = n_blocks(queries, dim)
    return [queries] if parts == 1 else [queries.where(F.pmod(F.xxhash64("id"), F.lit(parts)) == b) for b in range(parts)]


def _columns(t: pa.Table) -> list[np.ndarray]:
    """Columns of a bounded table as arrays and matrices, in the order of its first one."""
    if not t.num_rows:
        return [np.zeros(0, np.int64), np.zeros((0, 0)), *([np.zeros(0)] * (t.num_columns - 2))]
    order = np.argsort(t.column(0).to_numpy(), kind="stable")
    whole = [c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in t.columns]
    return [(matrix(c) if pa.types.is_list(c.type) else c.to_numpy(zero_copy_only=False))[order] for c in whole]


def meet(queries: DataFrame, data: DataFrame, work: Callable, schema: str, key: str = "id", data_parts: Callable[[], int] | None = None) -> DataFrame:
    """work(query columns, batches of data) for queries (id, vector, ...) and every part of data (id, vector, ...).

    The queries come as arrays ordered by id; work yields record batches and may be called for any pair of parts.
    Data of another form names the column that it is dealt by, and into how many parts.
    """
    n, size = queries.agg(F.count(F.lit(1)), F.max(F.size("vector"))).first()
    floats, cores = n * (size or 1), data.sparkSession.sparkContext.defaultParallelism
    if floats <= min(MAX_SENT_FLOATS, MAX_BLOCK_FLOATS):
        sent = share(data.sparkSession, _columns(queries.toArrow()))
        dealt = data.repartition(4 * cores) if n > SPREAD_ROWS else data
        return dealt.mapInArrow(lambda batches: work(sent.value, batches), schema)
    others = max(1, data_parts()) if data_parts else n_blocks(data)
    parts, wanted = -(-floats // MAX_BLOCK_FLOATS), 3 * cores
    parts = max(parts, min(int(np.sqrt(wanted)), -(-n // SPREAD_ROWS)))
    others = max(others, min(-(-wanted // parts), -(-n // SPREAD_ROWS)))
    names = [f"q{i}" for i in range(len(queries.columns))]
    left = queries.select(F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int"), F.explode(F.sequence(F.lit(0), F.lit(others - 1))), *queries.columns).toDF("qpart", "qother", *names)
    right = data.select(F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"), F.pmod(F.xxhash64(key, F.lit(1)), F.lit(others)).cast("int").alias("other"), *data.columns)

    def run(mine: pa.Table, rows: pa.Table) -> pa.Table:
        got = list(work(_columns(mine.select(names)), rows.drop_columns(["part", "other"]).combine_chunks().to_batches()))
        return pa.Table.from_batches(got) if got else _empty(schema)

    return left.groupBy("qpart", "qother").cogroup(right.groupBy("part", "other")).applyInArrow(run, schema)


ARROW = {"long": pa.int64(), "double": pa.float64(), "int": pa.int32()}


def _empty(schema: str) -> pa.Table:
    return pa.schema([(f.split()[0], ARROW[f.split()[1]]) for f in schema.split(", ")]).empty_table()


def share(spark: SparkSession, value):
    """A broadcast variable; what is sent has a bounded size."""
    return spark.sparkContext.broadcast(value)


def smallest(d: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and column numbers of the k smallest entries of every row, ties by id; nan comes last."""
    r, c = _within(d, k, 0.0)
    return _first(r, c, d[r, c], ids, k, d.shape[0])[:2]


def _within(d: np.ndarray, k: int, slack: float, worst: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The entries that are not clearly beyond the k smallest of their row, nor beyond worst, where that is a number."""
    if worst is None or np.isnan(worst).any():
        if d.shape[1] <= k:
            return tuple(x.ravel() for x in np.indices(d.shape))
        limit = np.partition(d, k - 1, axis=1)[:, k - 1]
        if worst is not None:
            limit = np.where(np.isnan(limit), limit, np.fmin(limit, worst))
    else:
        limit = worst
    if slack:
        size = np.where(np.isfinite(d), np.abs(d), 0.0).max(axis=1, initial=0.0)
        limit = limit + slack * np.abs(limit) + 1e-4 * slack * size
    return _hits((d <= limit[:, None]) | np.isnan(limit)[:, None] if np.isnan(limit).any() else d <= limit[:, None])


def _hits(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of the true entries, which are few."""
    at = np.flatnonzero(mask)
    return at // mask.shape[1], at % mask.shape[1]


def _first(r: np.ndarray, c: np.ndarray, v: np.ndarray, ids: np.ndarray, k: int, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    order = np.lexsort((ids[c], v, r))
    r, c, v = r[order], c[order], v[order]
    keep = np.arange(len(r)) - np.searchsorted(r, np.arange(n))[r] < k
    return r[keep], c[keep], v[keep]


def _pair_values(measure: Callable, q: np.ndarray, m: np.ndarray, r: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.concatenate([measure.pairs(q[r[i : i + 20_000]], m[c[i : i + 20_000]]) for i in range(0, len(r), 20_000)]) if len(r) else np.zeros(0)


def pick(measure: Callable, q: np.ndarray, m: np.ndarray, ids: np.ndarray, k: int, ok: np.ndarray | None = None, worst: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows, columns and distances of the k nearest rows of m for every row of q, ties by id; ok rules pairs out.

    worst: distances beyond which a row of q needs none (nan: no such bound).
    """
    d = measure(q, m)
    if ok is not None:
        d = np.where(ok, d, np.nan)
    exact = getattr(measure, "rowwise", False)
    r, c = _within(d, k, 1e-8 if exact else 0.0, worst)
    if ok is not None:
        keep = ok[r, c]
        r, c = r[keep], c[keep]
    return _first(r, c, _pair_values(measure, q, m, r, c) if exact else d[r, c], ids, k, len(q))


class Best:
    """The k best of every query over many blocks of rows; ties by id, nan last."""

    def __init__(self, n: int, k: int):
        self.k, self.values, self.names = k, np.full((n, k), np.nan), np.full((n, k), EMPTY)

    def worst(self, i: int, j: int) -> np.ndarray:
        """The k-th best distance of the queries i to j, nan where there are fewer."""
        return self.values[i:j, -1]

    def add(self, row: np.ndarray, id: np.ndarray, d: np.ndarray) -> None:
        """Candidates of some queries; only the lists of these are sorted again."""
        keep = ~(d > self.values[row, -1]) | (self.names[row, -1] == EMPTY)
        row, id, d = row[keep], id[keep], d[keep]
        if not len(row):
            return
        some, at = np.unique(row, return_inverse=True)
        at = np.concatenate([np.repeat(np.arange(len(some)), self.k), at])
        id, d = np.concatenate([self.names[some].ravel(), id]), np.concatenate([self.values[some].ravel(), d])
        order = np.lexsort((id, d, at))
        first = np.searchsorted(at[order], np.arange(len(some)))[:, None] + np.arange(self.k)
        self.names[some], self.values[some] = id[order][first], d[order][first]

    def all(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Queries, ids and distances, the nearest first."""
        r, c = np.nonzero(self.names != EMPTY)
        return r, self.names[r, c], self.values[r, c]


class Near:
    """Rows prepared for a search by Euclidean distance: one matrix product in 32 bits finds the candidates."""

    def __init__(self, m: np.ndarray):
        self.m, self.center = m, m.mean(0)
        moved = m - self.center
        norms = (moved * moved).sum(1)
        self.top = float(norms.max())
        self.right = np.concatenate([moved, norms[:, None]], axis=1).astype(np.float32).T.copy()

    @staticmethod
    def fits(measure: Callable, *sides: np.ndarray) -> bool:
        return getattr(measure, "rowwise", False) and measure.name.startswith("L2") and all(len(x) and np.isfinite(x).all() and np.abs(x).max() < 1e15 for x in sides)

    def pick(self, measure: Callable, q: np.ndarray, ids: np.ndarray, k: int, ok: np.ndarray | None, worst: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """As pick()."""
        moved = q - self.center
        own = (moved * moved).sum(1)
        d = np.concatenate([-2 * moved, np.ones((len(q), 1))], axis=1).astype(np.float32) @ self.right
        if ok is not None:
            d[~ok] = np.inf
        slack = 1.2e-7 * len(self.right) * (own + self.top)  # what 32 bits may lose
        limit = (worst * worst if "Sqrt" in measure.name else worst) * (1 + 1e-9) - own
        if np.isnan(limit).any():
            kth = np.partition(d, k - 1, axis=1)[:, k - 1] if d.shape[1] > k else np.full(len(d), np.inf)
            limit = np.where(np.isnan(limit), kth + slack, np.fmin(limit, kth + slack))
        hit = d <= (limit + slack).astype(np.float32)[:, None]
        if ok is not None:
            hit &= ok
        r, c = _hits(hit)
        if len(r) > 20 * k * len(q) + 10_000:  # rows too alike for 32 bits
            return pick(measure, q, self.m, ids, k, ok, worst)
        return _first(r, c, _pair_values(measure, q, self.m, r, c), ids, k, len(q))


def scan(queries: DataFrame, data: DataFrame, k: int, measure: Callable, mask: Callable | None = None) -> DataFrame:
    """Per task, the k rows of data (id, vector, ...) nearest to every query (id, vector, ...).

    mask(query block, batch) may rule pairs out: it gets the slices of the columns of both sides but the vectors.
    """

    def work(block: list[np.ndarray], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        qid, q = block[:2]
        best = Best(len(qid), k)
        for batch in batches:
            if not batch.num_rows or not len(qid):
                continue
            ids, m = batch.column(0).to_numpy(), matrix(batch.column(1))
            columns = [ids, *(batch.column(i).to_numpy(zero_copy_only=False) for i in range(2, batch.num_columns))]
            wide = min(len(ids), 8192)
            tall = max(1, CELLS // wide)
            fast = Near.fits(measure, q, m)
            for j in range(0, len(ids), wide):
                part, own = m[j : j + wide], ids[j : j + wide]
                near = Near(part) if fast else None
                for i in range(0, len(qid), tall):
                    ok = mask([qid[i : i + tall], *(x[i : i + tall] for x in block[2:])], [x[j : j + wide] for x in columns]) if mask else None
                    some, worst = q[i : i + tall], best.worst(i, i + tall)
                    r, c, d = near.pick(measure, some, own, k, ok, worst) if near else pick(measure, some, part, own, k, ok, worst)
                    best.add(r + i, own[c], d)
        row, id, d = best.all()
        yield pa.RecordBatch.from_arrays([pa.array(qid[row]), pa.array(id), pa.array(d)], schema=NEIGHBOR_SCHEMA)

    return meet(queries, data, work, NEIGHBORS)


def rank_rows(found: DataFrame, k: int, descending: bool = False, by: str = "query_id", value: str = "distance") -> DataFrame:
    """The k best rows of every query with their rank, from 1; ties by id."""
    w = Window.partitionBy(by).orderBy(F.col(value).desc() if descending else F.col(value), "id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)
