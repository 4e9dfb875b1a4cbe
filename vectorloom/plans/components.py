"""Connected components of an edge table by alternating large-star and small-star rounds."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vectorloom.runtime import cut_lineage


def label_components(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest index reachable from each of n nodes over the in-memory links a[i] - b[i]."""
    lab = np.arange(n)
    while len(a):
        m = np.minimum(lab[a], lab[b])
        np.minimum.at(lab, lab[a], m)
        np.minimum.at(lab, lab[b], m)
        while True:
            up = lab[lab]
            if np.array_equal(up, lab):
                break
            lab = up
        keep = lab[a] != lab[b]
        a, b = a[keep], b[keep]
    return lab


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """(node, component) for every node of edges; component is the smallest node reachable.

    Each round links every larger neighbour, then every smaller one, to the smallest neighbour known
    (O(log n) rounds), until no edge changes; only counts come to the driver. Null endpoints and self loops are dropped.
    """
    e = edges.select(F.col(src).alias("u"), F.col(dst).alias("v")).where("u <> v")
    e = cut_lineage(e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    before = None
    while True:
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("x")).select("x.u", "x.v").where("u <> v")
        e = cut_lineage(small.distinct())
        # a set of edges is known by its size and 128 bits of hashes
        now = tuple(e.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.bit_xor(F.xxhash64(F.lit(7), "v", "u"))).first())
        if before == now:
            break
        before = now
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(e.select(F.col("v"), F.col("v")).distinct())
