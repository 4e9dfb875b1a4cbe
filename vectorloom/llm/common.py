"""What the training-data operators share: table access, Arrow mapping, text-safe helpers."""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator
from types import ModuleType

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WHITE = "\\x20\\x09-\\x0D"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the data set, read by Spark alone (any store that Spark can open)."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def map_rows(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], dict]], schema: str) -> DataFrame:
    """mapInArrow where make(), called once a task, returns a function from a batch to columns (lists or arrays)."""
    names = [f.strip().split(" ")[0] for f in _fields(schema)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = make()
        for batch in batches:
            if batch.num_rows and (cols := f(batch)) is not None:
                yield pa.RecordBatch.from_arrays([pa.array(c, type=t) if not isinstance(c, pa.Array) else c for c, t in zip((cols[n] for n in names), _types(schema), strict=True)], names=names)

    return df.mapInArrow(run, schema)


def _fields(schema: str) -> list[str]:
    return [x.strip() for x in schema.split(",")]


KINDS = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string(), "binary": pa.binary(), "boolean": pa.bool_(), "array<int>": pa.list_(pa.int32()), "array<long>": pa.list_(pa.int64()), "array<double>": pa.list_(pa.float64())}


def _types(schema: str) -> list[pa.DataType]:
    return [KINDS[f.split(" ", 1)[1]] for f in _fields(schema)]


def per_process(key: str, make: Callable):
    """What make() gives, kept for the life of this Python process under a key."""
    held = sys.modules.setdefault("_vectorloom_process", ModuleType("_vectorloom_process")).__dict__
    if key not in held:
        held[key] = make()
    return held[key]


def raw_texts(col: pa.Array) -> list[bytes | None]:
    """The UTF-8 bytes of a string column, without decoding."""
    return col.cast(pa.binary()).to_pylist()


def held_out(modulus: int, rest: int, doc_id: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo modulus, equals rest; false for a null id."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % modulus == rest, F.lit(False))


def fraction_of(col: Column) -> Column:
    """A number in [0, 1) that depends on the value alone."""
    return F.pmod(F.xxhash64(col), F.lit(1_000_003)) / F.lit(1_000_003.0)


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df does not have, whatever its other columns are called."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


class Powers:
    """Polynomial hashes of byte ranges modulo 2 ** 64, by prefix sums."""

    BASE = 0x9E3779B97F4A7C15 | 1

    def __init__(self):
        self.up = self.down = np.ones(1, dtype=np.uint64)

    def grow(self, n: int) -> None:
        """Powers of the base and of its inverse, for exponents below n."""
        if len(self.up) < n:
            n = max(n, 1 << 20)
            inverse = pow(self.BASE, -1, 1 << 64)
            self.up, self.down = (np.cumprod(np.r_[np.uint64(1), np.full(n - 1, b, dtype=np.uint64)], dtype=np.uint64) for b in (self.BASE, inverse))

    def prefix(self, data: np.ndarray) -> np.ndarray:
        self.grow(len(data) + 1)
        return np.r_[np.uint64(0), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * self.up[: len(data)], dtype=np.uint64)]

    def ranges(self, prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mixed((prefix[end] - prefix[start]) * self.down[start])


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection that spreads 64-bit hashes."""
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))
