"""The exact index: a table of vectors, searched without approximation."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from vectorloom.functions.distances import resolve
from vectorloom.operators.blocks import vectors_of
from vectorloom.operators.neighbors import knn
from vectorloom.sources import store


@dataclass
class ExactIndex:
    """Vectors (id, vector) and the metric they are searched by."""

    data: DataFrame
    metric: str
    p: float

    def search(self, queries: DataFrame, k: int, allow: DataFrame | None = None, allow_pairs: DataFrame | None = None, **_) -> DataFrame:
        """(query_id, rank, id, distance) of the k nearest rows."""
        return knn(queries, self.data, k, self.metric, self.p, allow, allow_pairs)

    def extend(self, data: DataFrame) -> ExactIndex:
        return ExactIndex(self.data.unionByName(vectors_of(data)), self.metric, self.p)

    def save(self, path: str, include_dataset: bool = True) -> None:
        """Without the data set, load() needs it given again."""
        store.save(self.data.sparkSession, path, "exact", {"metric": self.metric, "p": self.p, "data": include_dataset}, {"data": self.data} if include_dataset else {})

    @classmethod
    def load(cls, spark: SparkSession, path: str, data: DataFrame | None = None) -> ExactIndex:
        params = store.load_params(spark, path, "exact")
        if data is None and not params["data"]:
            raise ValueError(f"{path} was stored without its data set")
        return cls(vectors_of(data) if data is not None else spark.read.parquet(f"{path}/data"), params["metric"], params["p"])


def build_exact(data: DataFrame, metric: str = "sqeuclidean", p: float = 2.0) -> ExactIndex:
    resolve(metric)
    return ExactIndex(vectors_of(data), metric, p)
