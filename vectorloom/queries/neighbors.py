"""Selection, filters, range and nearest-neighbour joins, graphs of neighbours, landmark pruning."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from vectorloom.operators import neighbors as N
from vectorloom.operators import stats
from vectorloom.operators.blocks import union, vectors_of
from vectorloom.queries.inputs import K, cte, data, queries, rounded, sq, sql_rounded, topk
from vectorloom.registry import register
from vectorloom.runtime import cut_lineage

_PAIRS = f"(SELECT query_id, id, {sq('qv', 'v')} AS distance, qlabel, label FROM q, data)"
EXACT = f"WITH {cte('scaled')} {sql_rounded(topk(_PAIRS))}"


def _table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _select(largest: bool):
    word = "DESC" if largest else "ASC"
    sql = f"SELECT query_id, rank, id, distance FROM (SELECT o_custkey AS query_id, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice {word}, o_orderkey) AS INT) AS rank, o_orderkey AS id, o_totalprice AS distance FROM orders) WHERE rank <= 3"

    @register("select_k_max" if largest else "select_k_min", sql)
    def query(spark, sf_dir):
        rows = _table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("query_id"), F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("distance"))
        return N.select_k(rows, 3, not largest).select("query_id", "rank", "id", "distance")


_select(False)
_select(True)


@register("merge_parts", f"WITH {cte('scaled')} {sql_rounded(topk(_PAIRS.replace('SELECT query_id, id,', 'SELECT query_id, id + 1000 * (label % 2) AS id,')))}")
def merge_parts(spark, sf_dir):
    """Two parts of the rows searched apart; the ids of the second are moved by 1000."""
    rows = data(spark, sf_dir, "scaled")
    parts = [(N.knn(queries(rows), rows.where(F.col("label") % 2 == i), K), 1000 * i) for i in (0, 1)]
    return rounded(N.merge_parts(parts, K).select("query_id", "rank", "id", "distance"))


@register("knn_multi_part", EXACT)
def knn_multi_part(spark, sf_dir):
    """A table in parts is one table."""
    rows = data(spark, sf_dir, "scaled")
    return rounded(N.knn(queries(rows), union([rows.where(F.col("label") < 5), rows.where(F.col("label") >= 5)]), K))


@register("filter_bitset", f"WITH {cte('scaled')} {sql_rounded(topk(f'(SELECT * FROM {_PAIRS} WHERE label IN (1, 3, 5))'))}")
def filter_bitset(spark, sf_dir):
    rows = data(spark, sf_dir, "scaled")
    return rounded(N.knn(queries(rows), rows, K, allow=rows.where(F.col("label").isin(1, 3, 5)).select("id")))


@register("filter_bitmap", f"WITH {cte('scaled')} {sql_rounded(topk(f'(SELECT * FROM {_PAIRS} WHERE label = (qlabel + 1) % 10)'))}")
def filter_bitmap(spark, sf_dir):
    """Pairs that may meet are a table."""
    rows = data(spark, sf_dir, "scaled")
    pairs = queries(rows).select(F.col("id").alias("query_id"), F.pmod(F.col("label") + 1, F.lit(10)).alias("label")).join(rows.select("id", "label"), "label")
    return rounded(N.knn(queries(rows), rows, K, allow_pairs=pairs))


@register("filter_udf", f"WITH {cte('scaled')} {sql_rounded(topk(f'(SELECT * FROM {_PAIRS} WHERE (id + query_id) % 3 = 0)'))}")
def filter_udf(spark, sf_dir):
    """A predicate over the ids of a pair."""
    rows = data(spark, sf_dir, "scaled")
    return rounded(N.knn(queries(rows), rows, K, mask=lambda q, i: (q[:, None] + i[None, :]) % 3 == 0))


@register("knn_padded", f"WITH {cte('scaled')}, found AS ({topk(f'(SELECT * FROM {_PAIRS} WHERE label = 2 AND id % 7 = 0)')}), slots AS (SELECT query_id, CAST(unnest(range(1, {K + 1})) AS INT) AS rank FROM q) SELECT query_id, rank, coalesce(id, -1) AS id, round(coalesce(distance, -1.0), 6) AS distance FROM slots LEFT JOIN found USING (query_id, rank)")
def knn_padded(spark, sf_dir):
    """Queries with fewer than k candidates, filled up."""
    rows = data(spark, sf_dir, "scaled")
    few = rows.where((F.col("label") == 2) & (F.col("id") % 7 == 0))
    return rounded(N.pad(N.knn(queries(rows), few, K), queries(rows), K, -1.0))


@register("knn_custom_metric", f"WITH {cte('scaled')} {sql_rounded(topk('(SELECT query_id, id, list_sum(list_transform(list_zip(qv, v), lambda p: sqrt(abs(p[1] - p[2])))) AS distance FROM q, data)'))}")
def knn_custom_metric(spark, sf_dir):
    """A metric given as a NumPy function."""
    rows = data(spark, sf_dir, "scaled")

    def measure(x, y):
        return np.stack([np.sqrt(np.abs(row[None, :] - y)).sum(1) for row in x]) if len(x) else np.zeros((0, len(y)))

    return rounded(N.knn(queries(rows), rows, K, measure))


@register("refine", f"WITH {cte('scaled')} {sql_rounded(topk(f'(SELECT * FROM {_PAIRS} WHERE label = qlabel)'))}")
def refine(spark, sf_dir):
    """Exact order of the candidates that share the query's label."""
    rows = data(spark, sf_dir, "scaled")
    candidates = queries(rows).select(F.col("id").alias("query_id"), "label").join(rows.select("id", "label"), "label").select("query_id", "id")
    return rounded(N.refine(rows, queries(rows), candidates, K))


_ONE = "SELECT query_id, id, round(distance, 6) AS distance FROM ({0})"


@register("nearest", f"WITH {cte('scaled')} " + _ONE.format(topk(f"(SELECT * FROM {_PAIRS} WHERE label <> qlabel)", 1)))
def nearest(spark, sf_dir):
    """The nearest row of another label for every query."""
    rows = data(spark, sf_dir, "scaled")
    return N.nearest(queries(rows), rows, group=("label", "label"), different=True).select("query_id", "id", F.round("distance", 6).alias("distance"))


@register("nearest_masked", f"WITH {cte('scaled')} " + _ONE.format(topk(f"(SELECT * FROM {_PAIRS} WHERE label = (qlabel + 1) % 10)", 1)))
def nearest_masked(spark, sf_dir):
    """The nearest row of the next label."""
    rows = data(spark, sf_dir, "scaled")
    x = queries(rows).withColumn("g", F.pmod(F.col("label") + 1, F.lit(10)))
    return N.nearest(x, rows, group=("g", "label")).select("query_id", "id", F.round("distance", 6).alias("distance"))


EPS = 1.5


@register("eps_neighborhood", f"WITH {cte()} SELECT query_id AS xid, id AS yid, round({sq('qv', 'v')}, 6) AS distance FROM q, data WHERE {sq('qv', 'v')} <= {EPS}")
def eps_neighborhood(spark, sf_dir):
    rows = data(spark, sf_dir)
    return N.eps_neighborhood(queries(rows), rows, EPS).select("xid", "yid", F.round("distance", 6).alias("distance"))


@register("eps_degrees", f"WITH {cte()}, d AS (SELECT query_id AS xid, count(*) AS degree FROM q, data WHERE {sq('qv', 'v')} <= {EPS} GROUP BY query_id) SELECT xid, degree FROM d UNION ALL SELECT NULL, CAST(sum(degree) AS BIGINT) FROM d")
def eps_degrees(spark, sf_dir):
    """Degrees and, in the row without an id, their total."""
    rows = data(spark, sf_dir)
    return N.eps_degrees(N.eps_neighborhood(queries(rows), rows, EPS))


_SELF = f"(SELECT a.id AS query_id, b.id, {sq('a.v', 'b.v')} AS distance FROM data a, data b)"
_SELF_ROOT = f"(SELECT a.id AS query_id, b.id, sqrt({sq('a.v', 'b.v')}) AS distance FROM data a, data b)"


@register("all_neighbors", f"WITH {cte()} {sql_rounded(topk(_SELF, 8))}")
def all_neighbors(spark, sf_dir):
    rows = data(spark, sf_dir)
    return rounded(N.all_neighbors(rows, 8))


@register("all_neighbors_batched", f"WITH {cte()} SELECT id AS query_id, 8::BIGINT AS n, true AS first_is_self, true AS recall_holds FROM data")
def all_neighbors_batched(spark, sf_dir):
    """Rows compared within overlapping clusters only: recall is at least 0.9."""
    rows = data(spark, sf_dir)
    found = cut_lineage(N.all_neighbors(rows, 8, n_clusters=8, overlap_factor=7))
    recall = stats.recall(found, N.all_neighbors(rows, 8), 8).first()[0]
    own = F.max((F.col("query_id") == F.col("id")) & (F.col("rank") == 1))
    return found.groupBy("query_id").agg(F.count_distinct("id").alias("n"), own.alias("first_is_self")).withColumn("recall_holds", F.lit(bool(recall >= 0.9)))


@register("core_distances", f"WITH {cte()} SELECT query_id AS id, round(distance, 6) AS core FROM ({topk(_SELF_ROOT, 5)}) WHERE rank = 5")
def core_distances(spark, sf_dir):
    rows = data(spark, sf_dir)
    return N.core_distances(N.all_neighbors(rows, 5, "euclidean"), 5).select("id", F.round("core", 6).alias("core"))


@register("mutual_reachability", f"WITH {cte()}, near AS ({topk(_SELF_ROOT, 5)}), core AS (SELECT query_id AS id, distance AS core FROM near WHERE rank = 5) SELECT query_id AS src, near.id AS dst, round(greatest(a.core, b.core, distance), 6) AS weight FROM near JOIN core a ON a.id = query_id JOIN core b ON b.id = near.id WHERE query_id <> near.id")
def mutual_reachability(spark, sf_dir):
    rows = data(spark, sf_dir)
    found = N.all_neighbors(rows, 5, "euclidean").cache()
    edges = found.where("query_id <> id").select(F.col("query_id").alias("src"), F.col("id").alias("dst"), F.col("distance").alias("weight"))
    return N.mutual_reachability(edges, N.core_distances(found, 5)).select("src", "dst", F.round("weight", 6).alias("weight"))


@register("knn_graph", f"WITH {cte()}, n AS (SELECT least(count(*), greatest(2, CAST(floor(log2(count(*))) AS INT) + 4)) AS k FROM data), near AS (SELECT query_id AS src, id AS dst, distance AS weight FROM ({topk(_SELF_ROOT, 40)}), n WHERE rank <= k AND query_id <> id), both_ways AS (SELECT * FROM near UNION ALL SELECT dst, src, weight FROM near) SELECT src, dst, round(max(weight), 6) AS weight FROM both_ways GROUP BY src, dst")
def knn_graph(spark, sf_dir):
    return N.knn_graph(data(spark, sf_dir), 4).select("src", "dst", F.round("weight", 6).alias("weight"))


@register("cross_component_nn", f"WITH {cte()}, pairs AS (SELECT a.label AS component, a.id AS src, b.id AS dst, {sq('a.v', 'b.v')} AS d FROM data a, data b WHERE a.label <> b.label) SELECT CAST(component AS BIGINT) AS component, src, dst, round(d, 6) AS distance FROM pairs QUALIFY row_number() OVER (PARTITION BY component ORDER BY d, src, dst) = 1")
def cross_component_nn(spark, sf_dir):
    """For every label the nearest pair of rows with another one."""
    return N.cross_component_nn(data(spark, sf_dir), "label").select("component", "src", "dst", F.round("distance", 6).alias("distance"))


_ROOT = f"(SELECT query_id, id, sqrt({sq('qv', 'v')}) AS distance FROM q, data)"


@register("ball_cover_knn", f"WITH {cte('scaled')} {sql_rounded(topk(_ROOT))}")
def ball_cover_knn(spark, sf_dir):
    """Exact neighbours with landmarks and the triangle inequality."""
    rows = data(spark, sf_dir, "scaled")
    return rounded(N.landmark_knn(queries(rows), *N.build_landmarks(rows), K))


@register("ball_cover_haversine", f"WITH {cte('geo')} {sql_rounded(topk('(SELECT query_id, id, 2 * asin(sqrt(pow(sin((qv[1] - v[1]) / 2), 2) + cos(qv[1]) * cos(v[1]) * pow(sin((qv[2] - v[2]) / 2), 2))) AS distance FROM q, data)'))}")
def ball_cover_haversine(spark, sf_dir):
    rows = data(spark, sf_dir, "geo")
    return rounded(N.landmark_knn(queries(rows), *N.build_landmarks(rows, metric="haversine"), K, "haversine"))


@register("ball_cover_all_knn", f"WITH {cte()} {sql_rounded(topk(_SELF_ROOT, 5))}")
def ball_cover_all_knn(spark, sf_dir):
    rows = data(spark, sf_dir)
    return rounded(N.landmark_knn(rows, *N.build_landmarks(rows), 5))


@register("ball_cover_eps", f"WITH {cte('scaled')} SELECT query_id AS xid, id AS yid, round(distance, 6) AS distance FROM {_ROOT} WHERE distance <= 3.0")
def ball_cover_eps(spark, sf_dir):
    rows = data(spark, sf_dir, "scaled")
    return N.landmark_eps(queries(rows), *N.build_landmarks(rows), 3.0).select("xid", "yid", F.round("distance", 6).alias("distance"))


@register("udf_metric", f"WITH {cte('scaled')} SELECT query_id, round(max(d), 6) AS high, round(min(d), 6) AS low FROM (SELECT query_id, list_sum(list_transform(list_zip(qv, v), lambda p: greatest(p[1] * p[2], 0))) AS d FROM q, data WHERE label = qlabel) GROUP BY query_id")
def udf_metric(spark, sf_dir):
    """A metric as a step over components, used as a Column."""
    rows = vectors_of(data(spark, sf_dir, "scaled"), "id", "vector", "label")
    measure = N.udf_metric(lambda acc, x, y: acc + F.greatest(x * y, F.lit(0.0)))
    met = queries(rows).select(F.col("id").alias("query_id"), F.col("vector").alias("qv"), "label").join(rows, "label")
    return met.groupBy("query_id").agg(F.round(F.max(measure(F.col("qv"), F.col("vector"))), 6).alias("high"), F.round(F.min(measure(F.col("qv"), F.col("vector"))), 6).alias("low"))
