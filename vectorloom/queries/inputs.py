"""Inputs of the queries: forms of the embeddings table, in Spark and in DuckDB SQL."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vectorloom.functions.arrays import simplex

D = "array<double>"
K = 10

_E = "embedding::DOUBLE[]"
SQL_FORMS = {
    "plain": _E,
    "scaled": f"list_transform({_E}, lambda x: x * (1 + label))",
    "simplex": f"list_transform({_E}, lambda x: abs(x) / list_sum(list_transform({_E}, lambda y: abs(y))))",
    "binary": f"list_transform({_E}, lambda x: CASE WHEN x > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END)",
    "geo": f"[asin(({_E})[1]), pi() * ({_E})[2]]",
    "sparse": f"list_transform({_E}, lambda x: CASE WHEN abs(x) > 0.1 THEN x ELSE 0.0::DOUBLE END)",
    "sparse_abs": f"list_transform({_E}, lambda x: CASE WHEN abs(x) > 0.1 THEN abs(x) ELSE 0.0::DOUBLE END)",
    "sparse_binary": f"list_transform({_E}, lambda x: CASE WHEN abs(x) > 0.1 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END)",
    "head": f"({_E})[1:8]",
}


def _form(e: Column, form: str) -> Column:
    if form == "scaled":
        return F.transform(e, lambda x: x * (1 + F.col("label")))
    if form == "simplex":
        return simplex(e)
    if form == "binary":
        return F.transform(e, lambda x: (x > 0).cast("double"))
    if form == "geo":
        return F.array(F.asin(F.get(e, F.lit(0))), F.lit(np.pi) * F.get(e, F.lit(1)))
    if form.startswith("sparse"):
        value = {"sparse": lambda x: x, "sparse_abs": F.abs, "sparse_binary": lambda x: F.lit(1.0)}[form]
        return F.transform(e, lambda x: F.when(F.abs(x) > 0.1, value(x)).otherwise(0.0))
    if form == "head":
        return F.slice(e, 1, 8)
    return e


def data(spark: SparkSession, sf_dir: str, form: str = "plain") -> DataFrame:
    """(id, vector, label) of all embeddings."""
    t = spark.read.parquet(f"{sf_dir.rstrip('/')}/embeddings.parquet")
    return t.select(F.col("vec_id").alias("id"), _form(F.col("embedding").cast(D), form).alias("vector"), "label")


def queries(rows: DataFrame) -> DataFrame:
    """The stated query set: every row whose id is divisible by 20."""
    return rows.where(F.col("id") % 20 == 0)


def cte(form: str = "plain", name: str = "data") -> str:
    """A common table (id, v, label) of a form, and q, the query set."""
    return f"{name} AS (SELECT vec_id AS id, {SQL_FORMS[form]} AS v, label FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL), q AS (SELECT id AS query_id, v AS qv, label AS qlabel FROM {name} WHERE id % 20 = 0)"


def topk(pairs: str, k: int = K, order: str = "distance") -> str:
    """Ranked and rounded rows of a relation (query_id, id, distance)."""
    return f"SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY {order}, id) AS INT) AS rank, id, distance FROM {pairs} QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY {order}, id) <= {k}"


def rounded(found: DataFrame, digits: int = 6) -> DataFrame:
    return found.select("query_id", "rank", "id", (F.round("distance", digits) + 0.0).alias("distance"))


def sql_rounded(ranked: str, digits: int = 6) -> str:
    return f"SELECT query_id, rank, id, round(distance, {digits}) + 0.0 AS distance FROM ({ranked})"


def label_means(rows: DataFrame) -> np.ndarray:
    """The mean vector of every label, by label: fixed centres that SQL can state too."""
    dim = rows.select(F.max(F.size("vector"))).first()[0] or 0
    means = rows.groupBy("label").agg(*(F.avg(F.get("vector", F.lit(i))).alias(f"m{i}") for i in range(dim)))
    return np.array([[r[f"m{i}"] for i in range(dim)] for r in sorted(means.collect(), key=lambda r: r["label"])])


#: (c, cv): the label means, numbered from 0
CENTERS = """cells AS (SELECT label, unnest(range(1, len(v) + 1)) AS i, unnest(v) AS x FROM data),
means AS (SELECT label, i, avg(x) AS x FROM cells GROUP BY label, i),
centers AS (SELECT CAST(row_number() OVER (ORDER BY label) - 1 AS INT) AS c, list(x ORDER BY i) AS cv FROM means GROUP BY label)"""


def sq(x: str, y: str) -> str:
    """SQL of the squared distance of two lists."""
    return f"list_sum(list_transform(list_zip({x}, {y}), lambda p: (p[1] - p[2]) * (p[1] - p[2])))"
