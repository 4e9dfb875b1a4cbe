"""Indexes as folders of Parquet tables with a record of their parameters, in any store that Spark can write."""

from __future__ import annotations

import json

import numpy as np
from pyspark.sql import DataFrame, SparkSession

FORMAT_VERSION = 1


def save(spark: SparkSession, path: str, kind: str, params: dict, tables: dict[str, DataFrame], partition_by: dict[str, str] | None = None) -> None:
    """Tables under path; partition_by: the column whose values become folders of a table."""
    for name, df in tables.items():
        w = df.write.mode("overwrite")
        (w.partitionBy(partition_by[name]) if partition_by and name in partition_by else w).parquet(f"{path}/{name}")
    record = {"format_version": FORMAT_VERSION, "kind": kind, "params": params}
    spark.createDataFrame([(json.dumps(record),)], "record string").coalesce(1).write.mode("overwrite").parquet(f"{path}/params")


def load_params(spark: SparkSession, path: str, kind: str) -> dict:
    """Parameters of a stored index; ValueError for another kind or format."""
    record = json.loads(spark.read.parquet(f"{path}/params").first()[0])
    if record["format_version"] != FORMAT_VERSION or record["kind"] != kind:
        raise ValueError(f"{path} holds {record['kind']} of format {record['format_version']}, not {kind} of format {FORMAT_VERSION}")
    return record["params"]


def matrix_table(spark: SparkSession, m: np.ndarray) -> DataFrame:
    """A small matrix (centres, a rotation, codebooks) as rows (i, v)."""
    return spark.createDataFrame([(i, row.tolist()) for i, row in enumerate(np.asarray(m, dtype=float).reshape(len(m), -1))], "i int, v array<double>")


def load_matrix(spark: SparkSession, path: str, shape: list[int]) -> np.ndarray:
    rows = sorted((r["i"], r["v"]) for r in spark.read.parquet(path).collect())
    return np.array([v for _, v in rows], dtype=float).reshape(shape)
