"""Tiered indexes: an approximate index over most rows and an exact scan of the rows added since."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vectorloom.functions.distances import resolve
from vectorloom.operators.blocks import rank_rows, union, vectors_of
from vectorloom.operators.neighbors import knn


@dataclass
class TieredIndex:
    """base: rows of the approximate tier, ann: its index (or None); delta: rows that only exact scans see."""

    base: DataFrame
    delta: DataFrame
    ann: object | None
    build: Callable[[DataFrame], object]
    metric: str
    min_ann_rows: int
    compact_on_extend: bool

    def search(self, queries: DataFrame, k: int, allow: DataFrame | None = None, **args) -> DataFrame:
        """(query_id, rank, id, distance) over both tiers; args go to the approximate one."""
        exact = knn(queries, self.delta if self.ann is not None else self.base.unionByName(self.delta), k, self.metric, allow=allow)
        if self.ann is None:
            return exact
        found = union([x.select("query_id", "id", "distance") for x in (self.ann.search(queries, k, allow=allow, **args), exact)])
        return rank_rows(found, k, resolve(self.metric).larger).select("query_id", "rank", "id", "distance")

    def extend(self, data: DataFrame) -> TieredIndex:
        out = replace(self, delta=self.delta.unionByName(vectors_of(data)))
        return out.compact() if self.compact_on_extend and out.rows().limit(self.min_ann_rows + 1).count() > self.min_ann_rows else out

    def compact(self) -> TieredIndex:
        """All rows in the approximate tier."""
        rows = self.rows()
        return replace(self, base=rows, delta=rows.where(F.lit(False)), ann=self.build(rows))

    def rows(self) -> DataFrame:
        return self.base.unionByName(self.delta)


def build_tiered(data: DataFrame, build: Callable[[DataFrame], object], metric: str = "sqeuclidean", min_ann_rows: int = 100_000, create_ann_index_on_extend: bool = False) -> TieredIndex:
    """build: from a table to an index with search(); used only for more than min_ann_rows rows."""
    rows = vectors_of(data)
    large = rows.limit(min_ann_rows + 1).count() > min_ann_rows
    none = rows.where(F.lit(False))
    return TieredIndex(rows, none, build(rows) if large else None, build, metric, min_ann_rows, create_ann_index_on_extend)


def merge_tiered(parts: list[TieredIndex]) -> TieredIndex:
    """One index over the rows of several, with an approximate tier if there are enough."""
    first = parts[0]
    return build_tiered(union([p.rows() for p in parts]), first.build, first.metric, first.min_ann_rows, first.compact_on_extend)
