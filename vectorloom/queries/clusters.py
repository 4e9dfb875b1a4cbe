"""Clustering, preprocessing and quality scores."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from vectorloom.operators import kmeans, linkage, neighbors, pca, quantizers, stats
from vectorloom.operators.blocks import vectors_of
from vectorloom.queries.inputs import CENTERS, K, cte, data, label_means, queries, sq
from vectorloom.registry import register
from vectorloom.runtime import cut_lineage
from vectorloom.sources import binary

_NEAREST = f"scored AS (SELECT id, v, c, {sq('v', 'cv')} AS d FROM data, centers), best AS (SELECT id, v, c, d FROM scored QUALIFY row_number() OVER (PARTITION BY id ORDER BY d, c) = 1)"


@register("kmeans_predict", f"WITH {cte('scaled')}, {CENTERS}, {_NEAREST} SELECT id, c AS label, round(d, 6) AS distance FROM best")
def kmeans_predict(spark, sf_dir):
    """Nearest of fixed centroids, the label means."""
    rows = data(spark, sf_dir, "scaled")
    return kmeans.predict(rows, label_means(rows)).select("id", "label", F.round("distance", 6).alias("distance"))


@register("kmeans_transform", f"WITH {cte('scaled')}, {CENTERS} SELECT id, c, round(sqrt({sq('v', 'cv')}), 6) AS distance FROM data, centers")
def kmeans_transform(spark, sf_dir):
    rows = data(spark, sf_dir, "scaled")
    return kmeans.transform(rows, label_means(rows)).select("id", F.posexplode("distances").alias("c", "distance")).select("id", "c", F.round("distance", 6).alias("distance"))


@register("kmeans_cluster_cost", f"WITH {cte('scaled')}, {CENTERS}, {_NEAREST} SELECT round(sum(d), 4) AS cost FROM best")
def kmeans_cluster_cost(spark, sf_dir):
    rows = data(spark, sf_dir, "scaled")
    return spark.createDataFrame([(round(kmeans.cluster_cost(rows, label_means(rows)), 4),)], "cost double")


_STEP = """cells1 AS (SELECT c, unnest(range(1, len(v) + 1)) AS i, unnest(v) AS x FROM best),
next AS (SELECT c, i, avg(x) AS x FROM cells1 GROUP BY c, i)"""


@register("kmeans_fit_one_step", f"WITH {cte('scaled')}, {CENTERS}, {_NEAREST}, {_STEP} SELECT c AS label, CAST(i AS INT) AS i, round(x, 6) + 0.0 AS x FROM next")
def kmeans_fit_one_step(spark, sf_dir):
    """One Lloyd iteration from fixed centroids."""
    rows = data(spark, sf_dir, "scaled")
    model = kmeans.fit(rows, 10, label_means(rows), max_iter=1)
    return model.table(spark).select("label", F.posexplode("vector").alias("i", "x")).select("label", (F.col("i") + 1).alias("i"), (F.round("x", 6) + 0.0).alias("x"))


@register("kmeans_fit_weighted", f"WITH {cte('scaled')}, {CENTERS}, {_NEAREST}, w AS (SELECT best.*, 1.0 + label AS w FROM best JOIN data USING (id)), cells1 AS (SELECT c, w, unnest(range(1, len(v) + 1)) AS i, unnest(v) AS x FROM w) SELECT c AS label, CAST(i AS INT) AS i, round(sum(w * x) / sum(w), 6) + 0.0 AS x FROM cells1 GROUP BY c, i")
def kmeans_fit_weighted(spark, sf_dir):
    rows = data(spark, sf_dir, "scaled").withColumn("weight", 1.0 + F.col("label"))
    model = kmeans.fit(rows, 10, label_means(rows), max_iter=1, weight="weight")
    return model.table(spark).select("label", F.posexplode("vector").alias("i", "x")).select("label", (F.col("i") + 1).alias("i"), (F.round("x", 6) + 0.0).alias("x"))


_TOTAL = "(SELECT sum(var_pop_sum) FROM (SELECT var_pop(x) * count(x) AS var_pop_sum FROM (SELECT unnest(range(len(v))) AS i, unnest(v) AS x FROM data) GROUP BY i))"


@register("kmeans_fit_predict", f"WITH {cte()} SELECT count(*) AS n, 8::BIGINT AS clusters, true AS nearest, true AS still, round({_TOTAL}, 5) AS of_one_cluster, true AS better FROM data")
def kmeans_fit_predict(spark, sf_dir):
    """A whole fit: rows have the nearest centroid, one more step changes next to nothing, and the cost is below that of one cluster."""
    rows = data(spark, sf_dir)
    model = kmeans.fit(rows, 8, max_iter=100, tol=1e-6)
    got = cut_lineage(kmeans.predict(rows, model.centroids))
    every = kmeans.transform(rows, model.centroids).select("id", F.array_min("distances").alias("least"))
    cost = kmeans.cluster_cost(rows, model.centroids)
    one = kmeans.fit(rows, 1, max_iter=2).centroids
    total = kmeans.cluster_cost(rows, one)
    after = kmeans.cluster_cost(rows, kmeans.fit(rows, 8, model.centroids, max_iter=1).centroids)
    near = F.every(F.abs(F.sqrt("distance") - F.col("least")) <= 1e-6)
    out = got.join(every, "id").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("label").alias("clusters"), near.alias("nearest"))
    return out.withColumns({"still": F.lit(bool(abs(after - cost) <= 1e-3 * cost)), "of_one_cluster": F.lit(round(total, 5)), "better": F.lit(bool(cost < total))})


@register("kmeans_balanced", f"WITH {cte()} SELECT count(*) AS n, 16::BIGINT AS clusters, true AS balanced FROM data")
def kmeans_balanced(spark, sf_dir):
    """No cluster has more than four times its share of the rows."""
    rows = data(spark, sf_dir)
    sizes = kmeans.predict(rows, kmeans.balanced_fit(rows, 16)).groupBy("label").agg(F.count(F.lit(1)).alias("size"))
    return sizes.agg(F.sum("size").alias("n"), F.count(F.lit(1)).alias("clusters"), (F.max("size") * 16 <= 4 * F.sum("size")).alias("balanced"))


@register("kmeans_find_k", "SELECT 5 AS k, true AS tight")
def kmeans_find_k(spark, sf_dir):
    """The number of generated blobs, whose spread the inertia shows."""
    k, inertia = kmeans.find_k(cut_lineage(binary.blobs(spark, 1000, 16, 5, 0.05)), 12, max_iter=20)
    return spark.createDataFrame([(k, bool(inertia < 1000 * 16 * 0.05**2 * 1.2))], "k int, tight boolean")


@register("calinski_harabasz", f"WITH {cte('scaled')}, {CENTERS}, {_NEAREST}, sizes AS (SELECT c, count(*) AS n FROM best GROUP BY c), cc AS (SELECT c, unnest(range(1, len(cv) + 1)) AS i, unnest(cv) AS x FROM centers), m AS (SELECT i, sum(n * x) / sum(n) AS x FROM cc JOIN sizes USING (c) GROUP BY i), disp AS (SELECT sqrt(sum(n * (cc.x - m.x) * (cc.x - m.x))) AS d FROM cc JOIN sizes USING (c) JOIN m USING (i)) SELECT round((SELECT (count(*) - 10) // 9 FROM data) * (SELECT d FROM disp) / (SELECT sum(d) FROM best), 6) AS score")
def calinski_harabasz(spark, sf_dir):
    rows = data(spark, sf_dir, "scaled")
    return spark.createDataFrame([(round(kmeans.calinski_harabasz(rows, label_means(rows)), 6),)], "score double")


_FLAT = f"WITH {cte()} SELECT count(*) AS n, 10::BIGINT AS clusters, true AS apart FROM data"


def _flat(rows, labels):
    """No row is nearer to another cluster than the nearest two clusters are to each other, unless it is alone in its own."""
    labels = cut_lineage(labels)
    placed = vectors_of(rows).join(labels, "id")
    near = neighbors.cross_component_nn(placed, "label", "euclidean").agg(F.min("distance")).first()[0]
    own = neighbors.knn(rows, rows, 2, "euclidean").where("query_id <> id").join(labels.select(F.col("id").alias("query_id"), F.col("label").alias("a")), "query_id").join(labels.select("id", F.col("label").alias("b")), "id")
    loose = own.where((F.col("a") != F.col("b")) & (F.col("distance") < near * (1 - 1e-9))).count()
    return labels.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("label").alias("clusters")).withColumn("apart", F.lit(loose == 0))


@register("single_linkage", _FLAT)
def single_linkage(spark, sf_dir):
    """Flat clusters over the neighbour graph (equal to a brute-force version in the tests)."""
    rows = data(spark, sf_dir)
    return _flat(rows, linkage.single_linkage(rows, 10, c=5))


@register("single_linkage_pairwise", _FLAT)
def single_linkage_pairwise(spark, sf_dir):
    rows = data(spark, sf_dir)
    return _flat(rows, linkage.single_linkage(rows, 10, connectivity="pairwise"))


_CORE = f"near AS (SELECT a.id, b.id AS other, sqrt({sq('a.v', 'b.v')}) AS d, row_number() OVER (PARTITION BY a.id ORDER BY {sq('a.v', 'b.v')}, b.id) AS r FROM data a, data b), core AS (SELECT id, d AS core FROM near WHERE r = 5)"


@register("linkage_mutual_reachability", f"WITH {cte()}, {_CORE} SELECT count(*) - 1 AS edges, true AS spans, true AS above_cores, round(sum(core), 4) AS cores FROM core")
def linkage_mutual_reachability(spark, sf_dir):
    """The spanning tree by mutual reachability: it spans all rows, and no edge is below the core distances of its ends."""
    rows = data(spark, sf_dir)
    tree, cores = linkage.build_linkage(rows, min_samples=5)
    tree = cut_lineage(tree)
    one = neighbors.graph_components(tree.select("src", "dst")).agg(F.count_distinct("component"), F.count(F.lit(1))).first()
    a, b = (cores.select(F.col("id").alias(c), F.col("core").alias(f"of_{c}")) for c in ("src", "dst"))
    held = tree.join(a, "src").join(b, "dst").agg(F.count(F.lit(1)).alias("edges"), F.every(F.col("weight") >= F.greatest("of_src", "of_dst") - 1e-9).alias("above_cores"))
    total = cores.agg(F.round(F.sum("core"), 4)).first()[0]
    return held.withColumns({"spans": F.lit(one[0] == 1 and one[1] == vectors_of(rows).count()), "cores": F.lit(total)})


@register("spectral_embedding", f"WITH {cte()} SELECT count(*) AS n, 3::BIGINT AS dims, true AS finite, true AS varies FROM data")
def spectral_embedding(spark, sf_dir):
    """Three coordinates of every row, none of them constant."""
    emb = pca.spectral_embedding(pca.connectivity_graph(data(spark, sf_dir), 12), 3)
    cells = cut_lineage(emb.select("id", F.posexplode("vector").alias("i", "x")))
    per = cells.groupBy("i").agg(F.var_pop("x").alias("s"), F.count(F.lit(1)).alias("n"), F.every(F.col("x").isNotNull() & ~F.isnan("x")).alias("finite"))
    return per.agg(F.max("n").alias("n"), F.count(F.lit(1)).alias("dims"), F.every("finite").alias("finite"), F.every(F.col("s") > 1e-12).alias("varies"))


@register("spectral_clustering", "SELECT 4::BIGINT AS clusters, 800::BIGINT AS n, true AS pure")
def spectral_clustering(spark, sf_dir):
    """Generated blobs are found again."""
    rows = cut_lineage(binary.blobs(spark, 800, 16, 4, 0.2))
    got = pca.spectral_clustering(pca.connectivity_graph(rows, 12), 4)
    met = rows.select("id", F.col("label").alias("blob")).join(got, "id").groupBy("blob").agg(F.count_distinct("label").alias("k"), F.min("label").alias("label"), F.count(F.lit(1)).alias("n"))
    return met.agg(F.count_distinct("label").alias("clusters"), F.sum("n").alias("n"), F.every(F.col("k") == 1).alias("pure"))


@register("connectivity_graph", f"WITH {cte()}, near AS (SELECT a.id AS src, b.id AS dst FROM data a, data b QUALIFY row_number() OVER (PARTITION BY a.id ORDER BY {sq('a.v', 'b.v')}, b.id) <= 6), e AS (SELECT src, dst FROM near WHERE src <> dst), both_ways AS (SELECT * FROM e UNION ALL SELECT dst, src FROM e) SELECT src, dst, count(*) * 0.5::DOUBLE AS weight FROM both_ways GROUP BY src, dst")
def connectivity_graph(spark, sf_dir):
    return pca.connectivity_graph(data(spark, sf_dir), 6)


# quantisers

_RANGE = "SELECT min(x) AS lo, max(x) AS hi FROM (SELECT unnest(v) AS x FROM data)"
_CODE = "greatest(-128, least(127, round(x * 255.0 / (hi - lo) + (-128.0 - 255.0 / (hi - lo) * lo))))"


@register("scalar_quantizer", f"WITH {cte('scaled')}, r AS ({_RANGE}), c AS (SELECT id, unnest(v) AS x FROM data) SELECT id, CAST(sum({_CODE}) AS BIGINT) AS total, CAST(min({_CODE}) AS INT) AS low, CAST(max({_CODE}) AS INT) AS high FROM c, r GROUP BY id")
def scalar_quantizer(spark, sf_dir):
    """Codes over the whole range, digested by row."""
    rows = vectors_of(data(spark, sf_dir, "scaled"))
    codes = rows.select("id", quantizers.train_scalar(rows, 1.0).transform("vector").cast("array<int>").alias("c"))
    return codes.select("id", F.aggregate("c", F.lit(0).cast("long"), lambda a, x: a + x).alias("total"), F.array_min("c").alias("low"), F.array_max("c").alias("high"))


_Q = 0.9


@register("scalar_quantizer_quantile", f"WITH {cte('scaled')}, x AS (SELECT unnest(v) AS x FROM data), o AS (SELECT x, row_number() OVER (ORDER BY x) - 1 AS pos, count(*) OVER () AS n FROM x) SELECT round(min(x), 6) AS low, round(max(x), 6) AS high FROM o WHERE pos IN (CAST(ceil({0.5 + 0.5 * _Q} * n) AS BIGINT) - 1, n - CAST(ceil({0.5 + 0.5 * _Q} * n) AS BIGINT))")
def scalar_quantizer_quantile(spark, sf_dir):
    q = quantizers.train_scalar(data(spark, sf_dir, "scaled"), _Q)
    return spark.createDataFrame([(round(q.low, 6), round(q.high, 6))], "low double, high double")


@register("scalar_quantizer_inverse", f"WITH {cte('scaled')}, r AS ({_RANGE}), c AS (SELECT id, unnest(v) AS x FROM data) SELECT id, round(sum(({_CODE} - (-128.0 - 255.0 / (hi - lo) * lo)) / (255.0 / (hi - lo))), 5) + 0.0 AS total FROM c, r GROUP BY id")
def scalar_quantizer_inverse(spark, sf_dir):
    rows = vectors_of(data(spark, sf_dir, "scaled"))
    q = quantizers.train_scalar(rows, 1.0)
    return rows.select("id", (F.round(F.aggregate(q.inverse(q.transform("vector")), F.lit(0.0), lambda a, x: a + x), 5) + 0.0).alias("total"))


def _binary(threshold: str, limit: str, **args):
    sql = f"WITH {cte()}, c AS (SELECT id, unnest(range(len(v))) AS i, unnest(v) AS x FROM data), t AS (SELECT i, {limit} AS t FROM c GROUP BY i) SELECT id, CAST(i // 8 AS INT) AS byte, CAST(sum(CASE WHEN x > t THEN pow(2, i % 8) ELSE 0 END) AS INT) AS code FROM c JOIN t USING (i) GROUP BY id, i // 8"

    @register(f"binary_quantizer_{threshold}", sql)
    def query(spark, sf_dir):
        rows = vectors_of(data(spark, sf_dir))
        codes = rows.select("id", quantizers.train_binary(rows, f"sampling_{threshold}" if args else threshold, **args).transform("vector").alias("c"))
        return codes.select("id", F.posexplode("c").alias("byte", "code"))


_binary("zero", "0.0")
_binary("mean", "avg(x)")
_binary("median", "quantile_disc(x, 0.5)", sampling_ratio=1.0)


def _books(rows) -> np.ndarray:
    """Codebooks that SQL can state: the subvectors of the label means, 8 components wide."""
    means = label_means(rows)
    return np.stack([means[:, s * 8 : s * 8 + 8] for s in range(means.shape[1] // 8)])


_SUB = f"parts AS (SELECT id, s, v[s * 8 + 1 : s * 8 + 8] AS p FROM data, range(8) t(s)), books AS (SELECT s, c, cv[s * 8 + 1 : s * 8 + 8] AS b FROM centers, range(8) t(s)), coded AS (SELECT id, s, c, {sq('p', 'b')} AS d FROM parts JOIN books USING (s) QUALIFY row_number() OVER (PARTITION BY id, s ORDER BY {sq('p', 'b')}, c) = 1)"


@register("pq_transform", f"WITH {cte()}, {CENTERS}, {_SUB} SELECT id, CAST(s AS INT) AS s, c AS code FROM coded")
def pq_transform(spark, sf_dir):
    rows = data(spark, sf_dir)
    codes = quantizers.ProductQuantizer(_books(rows), None, 64).transform(rows)
    return codes.select("id", F.posexplode("codes").alias("s", "code"))


@register("pq_inverse_transform", f"WITH {cte()}, {CENTERS}, {_SUB} SELECT id, round(sum(d), 6) AS loss FROM coded GROUP BY id")
def pq_inverse_transform(spark, sf_dir):
    """Squared distance of every row to its decoded form."""
    q, rows = quantizers.ProductQuantizer(_books(data(spark, sf_dir)), None, 64), vectors_of(data(spark, sf_dir))
    back = q.inverse_transform(q.transform(rows)).withColumnRenamed("vector", "b")
    return rows.join(back, "id").select("id", F.round(F.aggregate(F.zip_with("vector", "b", lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda a, v: a + v), 6).alias("loss"))


_CODED = f"WITH {cte()} SELECT count(*) AS n, round({_TOTAL}, 5) AS spread, true AS coded FROM data"


def _coded(rows, quantizer):
    """The loss of a round trip is at most seven tenths of the spread about the mean."""
    back = quantizer.inverse_transform(quantizer.transform(rows)).withColumnRenamed("vector", "b")
    loss = F.aggregate(F.zip_with("vector", "b", lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda a, v: a + v)
    spread = kmeans.cluster_cost(rows, kmeans.fit(rows, 1, max_iter=2).centroids)
    return vectors_of(rows).join(back, "id").agg(F.count(F.lit(1)).alias("n"), F.lit(round(spread, 5)).alias("spread"), (F.sum(loss) <= 0.7 * spread).alias("coded"))


@register("pq_trained", _CODED)
def pq_trained(spark, sf_dir):
    """A trained quantiser."""
    rows = data(spark, sf_dir)
    return _coded(rows, quantizers.train_pq(rows, 4, 16, n_iters=8))


@register("vpq_trained", _CODED)
def vpq_trained(spark, sf_dir):
    """Codes of residuals to a coarse quantiser."""
    rows = data(spark, sf_dir)
    return _coded(rows, quantizers.train_pq(rows, 4, 16, use_vq=True, n_iters=8))


@register("pca_fit", f"WITH {cte('scaled')}, c AS (SELECT unnest(range(len(v))) AS i, unnest(v) AS x FROM data), m AS (SELECT i, avg(x) AS m, var_samp(x) AS s FROM c GROUP BY i) SELECT count(*) AS dim, round(sum(s), 5) AS variance, round(sum(m * m), 5) AS mean2 FROM m")
def pca_fit(spark, sf_dir):
    """Total variance and the mean; components are tested against known ones."""
    p = pca.fit_pca(data(spark, sf_dir, "scaled"), 64)
    return spark.createDataFrame([(len(p.mean), round(float(p.explained_variance.sum()), 5), round(float((p.mean**2).sum()), 5))], "dim long, variance double, mean2 double")


@register("pca_transform", f"WITH {cte('scaled')}, c AS (SELECT id, unnest(range(len(v))) AS i, unnest(v) AS x FROM data), m AS (SELECT i, avg(x) AS m FROM c GROUP BY i) SELECT id, round(sum((x - m) * (x - m)), 5) AS norm2 FROM c JOIN m USING (i) GROUP BY id")
def pca_transform(spark, sf_dir):
    """With all components a rotation: squared norms of the centred rows stay."""
    rows = data(spark, sf_dir, "scaled")
    out = pca.fit_pca(rows, 64).transform(rows)
    return out.select("id", F.round(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x * x), 5).alias("norm2"))


@register("pca_inverse_transform", f"WITH {cte('scaled')} SELECT id, round(list_sum(list_transform(v, lambda x: x * x)), 5) AS norm2 FROM data")
def pca_inverse_transform(spark, sf_dir):
    rows = data(spark, sf_dir, "scaled")
    p = pca.fit_pca(rows, 64, whiten=True)
    return p.inverse_transform(p.transform(rows)).select("id", F.round(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x * x), 5).alias("norm2"))


# scores

_SIL = f"""sums AS (SELECT a.id, a.label, b.label AS other, sum({{d}}) AS total, count(*) AS size FROM data a, data b GROUP BY a.id, a.label, b.label),
ab AS (SELECT id, label, max(CASE WHEN other = label THEN CASE WHEN size > 1 THEN total / (size - 1) ELSE -1 END END) AS a, min(CASE WHEN other <> label THEN total / size END) AS b FROM sums GROUP BY id, label),
s AS (SELECT id, label, CASE WHEN a < 0 OR a = b THEN 0 ELSE (b - a) / greatest(a, b) END AS s FROM ab)"""


@register("silhouette_samples", f"WITH {cte()}, {_SIL.format(d=sq('a.v', 'b.v'))} SELECT id, CAST(label AS BIGINT) AS label, round(s, 6) AS silhouette FROM s")
def silhouette_samples(spark, sf_dir):
    return stats.silhouette_samples(data(spark, sf_dir)).select("id", "label", F.round("silhouette", 6).alias("silhouette"))


@register("silhouette_score", f"WITH {cte()}, {_SIL.format(d='list_sum(list_transform(list_zip(a.v, b.v), lambda p: abs(p[1] - p[2])))')} SELECT round(avg(s), 6) AS silhouette FROM s")
def silhouette_score(spark, sf_dir):
    return stats.silhouette_score(data(spark, sf_dir), metric="L1").select(F.round("silhouette", 6).alias("silhouette"))


@register("trustworthiness", f"""WITH {cte()},
d AS (SELECT a.id AS i, b.id AS j, {sq('a.v', 'b.v')} AS dx, {sq('a.v[1:8]', 'b.v[1:8]')} AS de FROM data a, data b WHERE a.id <> b.id),
r AS (SELECT i, j, row_number() OVER (PARTITION BY i ORDER BY dx, j) AS rx, row_number() OVER (PARTITION BY i ORDER BY de, j) AS re FROM d),
n AS (SELECT count(*) AS n FROM data)
SELECT round(1 - sum(greatest(0, rx - 5)) * 2.0 / (any_value(n) * 5 * (2.0 * any_value(n) - 16)), 6) AS trustworthiness FROM r, n WHERE re <= 5""")
def trustworthiness(spark, sf_dir):
    return stats.trustworthiness(data(spark, sf_dir), data(spark, sf_dir, "head"), 5).select(F.round("trustworthiness", 6).alias("trustworthiness"))


_NEAR = "SELECT query_id, id, distance, row_number() OVER (PARTITION BY query_id ORDER BY distance, id) AS rank FROM (SELECT query_id, id, {0} AS distance FROM q, data)"


@register("recall", f"WITH {cte()}, t AS (SELECT * FROM ({_NEAR.format(sq('qv', 'v'))}) WHERE rank <= {K}), f AS (SELECT * FROM ({_NEAR.format(sq('qv[1:8]', 'v[1:8]'))}) WHERE rank <= {K}) SELECT round(count(f.id)::DOUBLE / count(*), 6) AS recall FROM t LEFT JOIN f USING (query_id, id)")
def recall(spark, sf_dir):
    """Of neighbours by the first eight components."""
    rows, head = data(spark, sf_dir), data(spark, sf_dir, "head")
    return stats.recall(neighbors.knn(queries(head), head, K), neighbors.knn(queries(rows), rows, K), K).select(F.round("recall", 6).alias("recall"))


@register("tolerant_recall", f"WITH {cte()}, t AS (SELECT * FROM ({_NEAR.format(sq('qv', 'v'))}) WHERE rank <= {K}), f AS (SELECT * FROM ({_NEAR.format(sq('qv[1:8]', 'v[1:8]'))}) WHERE rank <= {K}) SELECT round((SELECT count(*) FROM f LEFT JOIN t s ON s.query_id = f.query_id AND s.rank = f.rank WHERE EXISTS (SELECT 1 FROM t WHERE t.query_id = f.query_id AND t.id = f.id) OR abs(f.distance - s.distance) <= 0.2)::DOUBLE / (SELECT count(*) FROM t), 6) AS recall")
def tolerant_recall(spark, sf_dir):
    rows, head = data(spark, sf_dir), data(spark, sf_dir, "head")
    return stats.tolerant_recall(neighbors.knn(queries(head), head, K), neighbors.knn(queries(rows), rows, K), K, 0.2).select(F.round("recall", 6).alias("recall"))
