"""Quantisers: scalar, binary and product codes, learned from bounded samples and applied row by row."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vectorloom.functions.arrays import matrix, vectors
from vectorloom.operators.blocks import coarse, share, vectors_of
from vectorloom.operators.kmeans import balanced, init_plus_plus, sample, squared

MAX_VALUES = 1_000_000


@dataclass(frozen=True)
class ScalarQuantizer:
    """One range for all components, mapped to -128 .. 127."""

    low: float
    high: float

    @property
    def scale(self) -> float:
        return 255.0 / (self.high - self.low) if self.high > self.low else 1.0

    @property
    def offset(self) -> float:
        return -128.0 - self.scale * self.low

    def transform(self, v: Column | str) -> Column:
        v = F.col(v) if isinstance(v, str) else v
        code = lambda x: F.greatest(F.lit(-128.0), F.least(F.lit(127.0), F.round(x * self.scale + self.offset))).cast("byte")
        return F.transform(v.cast("array<double>"), code)

    def inverse(self, codes: Column | str) -> Column:
        codes = F.col(codes) if isinstance(codes, str) else codes
        return F.transform(codes.cast("array<double>"), lambda c: (c - self.offset) / self.scale)


def train_scalar(data: DataFrame, quantile: float = 0.99, max_values: int = MAX_VALUES) -> ScalarQuantizer:
    """Symmetric order statistics of at most about max_values components; of all of them if quantile is 1."""
    if not 0 < quantile <= 1:
        raise ValueError("quantile must be in (0, 1]")
    rows = vectors_of(data)
    if quantile == 1:
        low, high = rows.agg(F.min(F.array_min("vector")), F.max(F.array_max("vector"))).first()
        return ScalarQuantizer(low, high)
    dim = rows.agg(F.max(F.size("vector"))).first()[0] or 1
    values = np.sort(sample(rows, max(1, max_values // dim))[1].ravel())
    top = int(np.ceil((0.5 + 0.5 * quantile) * len(values))) - 1
    return ScalarQuantizer(float(values[len(values) - top - 1]), float(values[top]))


@dataclass(frozen=True)
class BinaryQuantizer:
    """A threshold per component; codes are bytes, lowest bit first."""

    thresholds: tuple[float, ...]

    def transform(self, v: Column | str) -> Column:
        v = F.col(v) if isinstance(v, str) else v
        limits = F.array(*map(F.lit, self.thresholds))
        bits = F.zip_with(v.cast("array<double>"), limits, lambda x, t: (x > t).cast("int"))
        size = -(-len(self.thresholds) // 8)
        byte = lambda b: F.aggregate(F.slice(bits, b * 8 + 1, 8), F.struct(F.lit(0).alias("s"), F.lit(1).alias("w")), lambda a, x: F.struct((a["s"] + a["w"] * x).alias("s"), (a["w"] * 2).alias("w")), lambda a: a["s"])
        return F.transform(F.sequence(F.lit(0), F.lit(size - 1)), byte)


def train_binary(data: DataFrame, threshold: str = "mean", sampling_ratio: float = 0.1, max_values: int = MAX_VALUES) -> BinaryQuantizer:
    """threshold: "zero", "mean" of all rows, or "sampling_median" of a sample of bounded size."""
    rows = vectors_of(data)
    dim = rows.agg(F.max(F.size("vector"))).first()[0] or 0
    if threshold == "zero":
        return BinaryQuantizer((0.0,) * dim)
    if threshold == "mean":
        means = rows.agg(*(F.avg(F.get("vector", F.lit(i))) for i in range(dim))).first()
        return BinaryQuantizer(tuple(means))
    if threshold == "sampling_median":
        n = rows.count()
        m = np.sort(sample(rows, max(1, min(int(np.ceil(n * sampling_ratio)), max_values // max(1, dim))))[1], axis=0)
        return BinaryQuantizer(tuple(m[(len(m) - 1) // 2].tolist()))
    raise ValueError(f"threshold {threshold!r}")


@dataclass(frozen=True)
class ProductQuantizer:
    """Codebooks of shape (pq_dim, codes, width); centres (coarse quantiser, may be None) are subtracted first."""

    codebooks: np.ndarray
    centers: np.ndarray | None = None
    dim: int = 0

    @property
    def bits(self) -> int:
        return int(np.ceil(np.log2(self.codebooks.shape[1])))

    @property
    def quantized_dim(self) -> int:
        """Bytes of a packed code."""
        return -(-self.codebooks.shape[0] * self.bits // 8)

    def labels(self, m: np.ndarray) -> np.ndarray:
        return coarse(squared(m, self.centers)).argmin(1) if self.centers is not None else np.zeros(len(m), dtype=int)

    def _padded(self, m: np.ndarray) -> np.ndarray:
        s, _, w = self.codebooks.shape
        return np.pad(m, ((0, 0), (0, s * w - m.shape[1])))

    def encode(self, m: np.ndarray, label: np.ndarray | None = None) -> np.ndarray:
        """Codes of the rows of m; label: their centres, if known."""
        if self.centers is not None:
            m = m - self.centers[self.labels(m) if label is None else label]
        m = self._padded(m)
        s, _, w = self.codebooks.shape
        return np.stack([coarse(squared(m[:, i * w : (i + 1) * w], self.codebooks[i])).argmin(1) for i in range(s)], axis=1)

    def decode(self, codes: np.ndarray, label: np.ndarray | None = None) -> np.ndarray:
        s, _, w = self.codebooks.shape
        out = self.codebooks[np.arange(s)[None, :], codes].reshape(len(codes), s * w)[:, : self.dim or s * w]
        return out + self.centers[label] if self.centers is not None else out

    def transform(self, data: DataFrame) -> DataFrame:
        """(id, label, codes) of every row."""
        sent = share(data.sparkSession, self)
        schema = pa.schema([("id", pa.int64()), ("label", pa.int32()), ("codes", pa.list_(pa.int32()))])

        def run(batches):
            for b in batches:
                if b.num_rows:
                    m = matrix(b.column(1))
                    label = sent.value.labels(m)
                    yield pa.RecordBatch.from_arrays([b.column(0), pa.array(label.astype(np.int32)), vectors(sent.value.encode(m, label), pa.int32())], schema=schema)

        return vectors_of(data).mapInArrow(run, "id long, label int, codes array<int>")

    def inverse_transform(self, codes: DataFrame) -> DataFrame:
        """(id, vector) decoded from (id, label, codes)."""
        sent = share(codes.sparkSession, self)
        schema = pa.schema([("id", pa.int64()), ("vector", pa.list_(pa.float64()))])

        def run(batches):
            for b in batches:
                if b.num_rows:
                    c = np.array(b.column(2).flatten().to_numpy(), dtype=int).reshape(b.num_rows, -1)
                    yield pa.RecordBatch.from_arrays([b.column(0), vectors(sent.value.decode(c, b.column(1).to_numpy()))], schema=schema)

        return codes.select("id", "label", "codes").mapInArrow(run, "id long, vector array<double>")


def codebook(m: np.ndarray, codes: int, n_iters: int, rng: np.random.Generator, hierarchical: bool) -> np.ndarray:
    """codes centres of the rows of m, by balanced or plain k-means."""
    if hierarchical:
        return balanced(m, codes, n_iters, int(rng.integers(1 << 30)))
    c = init_plus_plus(m, codes, rng)
    for _ in range(n_iters):
        label = squared(m, c).argmin(1)
        size = np.bincount(label, minlength=codes)
        total = np.zeros_like(c)
        np.add.at(total, label, m)
        c = np.where(size[:, None] > 0, total / np.maximum(size, 1)[:, None], c)
    return c


def train_pq(data: DataFrame, pq_bits: int = 8, pq_dim: int = 0, use_vq: bool = False, vq_n_centers: int = 0, n_iters: int = 25, hierarchical: bool = True, max_rows: int = 50_000, seed: int = 0, use_subspaces: bool = True) -> ProductQuantizer:
    """Codebooks from a sample of max_rows rows; pq_dim 0 stands for a quarter of the dimension, vq_n_centers 0 for sqrt(n).

    use_subspaces: a codebook for every subspace; otherwise all share one.
    """
    if not 4 <= pq_bits <= 16:
        raise ValueError("pq_bits must be from 4 to 16")
    rng = np.random.default_rng(seed)
    _, m = sample(vectors_of(data), max_rows, seed)
    dim = m.shape[1]
    s = pq_dim or max(1, dim // 4)
    width = -(-dim // s)
    centers = None
    if use_vq:
        n = vq_n_centers or max(1, int(np.sqrt(len(m))))
        centers = balanced(m, n, n_iters, seed)
        m = m - centers[squared(m, centers).argmin(1)]
    m = np.pad(m, ((0, 0), (0, s * width - dim))).reshape(len(m), s, width)
    if use_subspaces:
        books = np.stack([codebook(m[:, i], 1 << pq_bits, n_iters, rng, hierarchical) for i in range(s)])
    else:
        rows = m.reshape(-1, width)
        one = codebook(rows[rng.permutation(len(rows))[:max_rows]], 1 << pq_bits, n_iters, rng, hierarchical)
        books = np.repeat(one[None], s, axis=0)
    return ProductQuantizer(books, centers, dim)
