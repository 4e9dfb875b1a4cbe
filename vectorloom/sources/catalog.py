"""Public data sets of nearest-neighbour benchmarks: names, sizes, metrics and the files that each is made of."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from vectorloom.sources.binary import read_vectors


@dataclass(frozen=True)
class Dataset:
    """base, queries, neighbours and distances lie in a folder of the data set's name."""

    name: str
    rows: int
    dim: int
    distance: str
    suffix: str = "fbin"

    def files(self, root: str) -> dict[str, str]:
        folder = f"{root.rstrip('/')}/{self.name}"
        return {"base": f"{folder}/base.{self.suffix}", "queries": f"{folder}/query.{self.suffix}", "neighbors": f"{folder}/groundtruth.neighbors.ibin", "distances": f"{folder}/groundtruth.distances.fbin"}

    def load(self, spark: SparkSession, root: str, part: str = "base") -> DataFrame:
        """One of the four files as a table."""
        return read_vectors(spark, self.files(root)[part])


#: fixed values: published sizes and metrics
DATASETS = {
    d.name: d
    for d in (
        Dataset("deep-image-96-angular", 10_000_000, 96, "inner_product"),
        Dataset("fashion-mnist-784-euclidean", 60_000, 784, "euclidean"),
        Dataset("glove-50-angular", 1_100_000, 50, "inner_product"),
        Dataset("glove-100-angular", 1_100_000, 100, "inner_product"),
        Dataset("mnist-784-euclidean", 60_000, 784, "euclidean"),
        Dataset("nytimes-256-angular", 290_000, 256, "inner_product"),
        Dataset("sift-128-euclidean", 1_000_000, 128, "euclidean"),
        Dataset("bigann-100M", 100_000_000, 128, "euclidean", "u8bin"),
    )
}


def catalog(spark: SparkSession) -> DataFrame:
    """(name, rows, dim, distance) of the known data sets."""
    return spark.createDataFrame([(d.name, d.rows, d.dim, d.distance) for d in DATASETS.values()], "name string, rows long, dim int, distance string")
