"""Vector files: a header of two little-endian 32-bit integers (rows, dimension), then the rows.

A data set is a file or a folder of part files. Parts up to WHOLE_BYTES are read through Spark's binaryFile source,
from any store that Spark opens; larger files are read in ranges, each by a task that opens the file itself.
"""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vectorloom.functions.arrays import matrix, vectors
from vectorloom.operators.blocks import vectors_of

WHOLE_BYTES = 512 << 20
RANGE_BYTES = 64 << 20
#: suffix: NumPy type of the components
SUFFIXES = {"fbin": "float32", "f16bin": "float16", "ibin": "int32", "u8bin": "uint8", "i8bin": "int8"}


def dtype_of(path: str) -> np.dtype:
    """The component type that a file name stands for."""
    suffix = path.rstrip("/").rsplit(".", 1)[-1]
    if suffix not in SUFFIXES:
        raise ValueError(f"{path}: the suffix is none of {', '.join(SUFFIXES)}")
    return np.dtype(SUFFIXES[suffix]).newbyteorder("<")


def suffix_of(dtype) -> str:
    return {v: k for k, v in SUFFIXES.items()}[np.dtype(dtype).name]


ROWS = pa.schema([("part", pa.string()), ("pos", pa.int64()), ("vector", pa.list_(pa.float64()))])


def _numbered(rows: DataFrame) -> DataFrame:
    """Positions within parts become ids over all parts, in the order of part names."""
    sizes = sorted((r[0], r[1]) for r in rows.groupBy("part").agg(F.max("pos") + 1).collect())
    start = np.cumsum([0] + [n for _, n in sizes])[:-1]
    if len(sizes) <= 1:
        return rows.select(F.col("pos").alias("id"), "vector")
    at = rows.sparkSession.createDataFrame([(p, int(s)) for (p, _), s in zip(sizes, start, strict=True)], "part string, start long")
    return rows.join(F.broadcast(at), "part").select((F.col("start") + F.col("pos")).alias("id"), "vector")


def read_vectors(spark: SparkSession, path: str, subset: int | None = None, dtype: str | None = None) -> DataFrame:
    """(id, vector) of a vector file or folder of them; ids count from 0, subset keeps the first rows."""
    kind = np.dtype(dtype).newbyteorder("<") if dtype else dtype_of(path)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    large = [(r["path"], r["length"]) for r in files.select("path", "length").where(F.col("length") > WHOLE_BYTES).collect()]

    def whole(batches):
        for b in batches:
            for name, content in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                raw = content.as_buffer()
                n, dim = struct.unpack("<II", memoryview(raw)[:8])
                m = np.frombuffer(raw, kind, n * dim, 8).reshape(n, dim)
                for i in range(0, n, 8192):
                    part = m[i : i + 8192].astype(np.float64)
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(part)), pa.array(np.arange(i, i + len(part))), vectors(part)], schema=ROWS)

    rows = files.where(F.col("length") <= WHOLE_BYTES).select("path", "content").mapInArrow(whole, "part string, pos long, vector array<double>")
    if large:
        rows = rows.unionByName(_ranges(spark, large, kind))
    out = _numbered(rows)
    return out if subset is None else out.where(F.col("id") < subset)


def _open(name: str):
    from pyarrow.fs import FileSystem

    fs, inner = FileSystem.from_uri(name if "://" in name else "file://" + name.removeprefix("file:"))
    return fs.open_input_file(inner)


def _ranges(spark: SparkSession, large: list[tuple[str, int]], kind: np.dtype) -> DataFrame:
    starts = [(p, at, min(RANGE_BYTES, size - at)) for p, size in large for at in range(0, size, RANGE_BYTES)]

    def run(batches):
        for b in batches:
            for name, at, size in zip(*(c.to_pylist() for c in b.columns), strict=True):
                with _open(name) as f:
                    n, dim = struct.unpack("<II", f.read(8))
                    width = dim * kind.itemsize
                    first, last = -(-max(0, at - 8) // width), min(n, -(-max(0, at + size - 8) // width))
                    for i in range(first, last, 8192):
                        f.seek(8 + i * width)
                        m = np.frombuffer(f.read(min(8192, last - i) * width), kind).reshape(-1, dim).astype(np.float64)
                        yield pa.RecordBatch.from_arrays([pa.array([name] * len(m)), pa.array(np.arange(i, i + len(m))), vectors(m)], schema=ROWS)

    return spark.createDataFrame(starts, "path string, at long, size long").repartition(len(starts)).mapInArrow(run, "part string, pos long, vector array<double>")


def write_vectors(df: DataFrame, path: str, dtype: str = "float32", part_rows: int = 1_000_000) -> int:
    """Part files of at most part_rows rows under path, a folder (or the address of a store that Arrow opens) which driver and executors share; the number of parts.

    Rows are ordered by id within and over the parts. A part is written under a name of its task and renamed when complete, so a repeated task replaces it.
    """
    rows = vectors_of(df)
    n = rows.count()
    parts = max(1, -(-n // part_rows))
    kind = np.dtype(dtype).newbyteorder("<")

    def run(batches):
        from pyarrow import fs
        from pyspark import TaskContext

        c = TaskContext.get()
        got = [(b.column(0).to_numpy(), matrix(b.column(1))) for b in batches if b.num_rows]
        if got:
            m = np.concatenate([x for _, x in got])
            store, folder = fs.FileSystem.from_uri(path if "://" in path else f"file://{path.removeprefix('file:')}")
            store.create_dir(folder, recursive=True)
            name = f"{folder}/part-{c.partitionId():06d}.{suffix_of(dtype)}"
            with store.open_output_stream(f"{name}.{c.taskAttemptId()}.tmp") as f:
                f.write(struct.pack("<II", *m.shape) + m.astype(kind).tobytes())
            store.move(f"{name}.{c.taskAttemptId()}.tmp", name)
            yield pa.RecordBatch.from_arrays([pa.array([len(m)])], names=["n"])

    ordered = rows.repartitionByRange(parts, "id").sortWithinPartitions("id")
    return ordered.mapInArrow(run, "n long").count()


def convert(df: DataFrame, dtype: str) -> DataFrame:
    """Vectors rounded to a component type (half precision, bytes)."""
    kind = np.dtype(dtype)
    schema = pa.schema([("id", pa.int64()), ("vector", pa.list_(pa.float64()))])

    def run(batches):
        for b in batches:
            if b.num_rows:
                m = matrix(b.column(1))
                m = np.clip(np.rint(m), np.iinfo(kind).min, np.iinfo(kind).max) if kind.kind in "iu" else m
                yield pa.RecordBatch.from_arrays([b.column(0), vectors(m.astype(kind).astype(np.float64))], schema=schema)

    return vectors_of(df).mapInArrow(run, "id long, vector array<double>")


def blobs(spark: SparkSession, n: int, dim: int, centers: int, std: float = 1.0, seed: int = 0) -> DataFrame:
    """(id, vector, label): n normal rows around uniform centres, made where they are used."""
    at = np.random.default_rng(seed).uniform(-10, 10, (centers, dim))
    schema = pa.schema([("id", pa.int64()), ("vector", pa.list_(pa.float64())), ("label", pa.int32())])

    def run(batches):
        for b in batches:
            ids = b.column(0).to_numpy()
            if len(ids):
                label = ids % centers
                noise = np.array([np.random.default_rng([seed, int(i)]).standard_normal(dim) for i in ids])
                yield pa.RecordBatch.from_arrays([b.column(0), vectors(at[label] + std * noise), pa.array(label.astype(np.int32))], schema=schema)

    return spark.range(n).mapInArrow(run, "id long, vector array<double>, label int")


def split_groundtruth(truth: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Neighbour ids and distances of (query_id, rank, id, distance), one array per query each."""
    rows = truth.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "id", "distance"))).alias("r"))
    return rows.select("query_id", F.col("r.id").alias("neighbors")), rows.select("query_id", F.col("r.distance").alias("distances"))
