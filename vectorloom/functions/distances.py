"""Distance metrics over vectors: as Column expressions, as NumPy blocks and as DuckDB SQL.

Expressions use higher-order functions and are meant for small query sets and ad-hoc columns; blocks are what
the operators run inside mapInArrow. All arithmetic is in double precision. Smaller is closer, except for
inner products. A null vector gives a null distance.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

D = "array<double>"


def _sum(c: Column) -> Column:
    return F.aggregate(c, F.lit(0.0), lambda a, v: a + v)


def _zip(x: Column, y: Column, f: Callable[[Column, Column], Column]) -> Column:
    return _sum(F.zip_with(x.cast(D), y.cast(D), f))


def _each(x: Column, f: Callable[[Column], Column]) -> Column:
    return _sum(F.transform(x.cast(D), f))


def _zero_log(v: Column) -> Column:
    return F.when(v == 0, 0.0).otherwise(F.ln(F.abs(v)))


def dot(x: Column, y: Column) -> Column:
    return _zip(x, y, lambda a, b: a * b)


def squared_l2(x: Column, y: Column) -> Column:
    return _zip(x, y, lambda a, b: (a - b) * (a - b))


def _cosine(x: Column, y: Column) -> Column:
    norms = F.sqrt(dot(x, x)) * F.sqrt(dot(y, y))
    return F.when(norms == 0, F.lit(float("nan"))).otherwise(1 - F.try_divide(dot(x, y), norms))


def _correlation(x: Column, y: Column) -> Column:
    k, sx, sy = F.size(x), _each(x, lambda a: a), _each(y, lambda a: a)
    spread = F.sqrt((k * dot(x, x) - sx * sx) * (k * dot(y, y) - sy * sy))
    return F.when(spread == 0, F.lit(float("nan"))).otherwise(1 - F.try_divide(k * dot(x, y) - sx * sy, spread))


def _js_term(a: Column, b: Column) -> Column:
    m = (a + b) / 2
    return -a * (_zero_log(m) - _zero_log(a)) - b * (_zero_log(m) - _zero_log(b))


def _haversine(x: Column, y: Column) -> Column:
    a, b = (F.element_at(x.cast(D), i) for i in (1, 2))
    c, d = (F.element_at(y.cast(D), i) for i in (1, 2))
    h = F.pow(F.sin((a - c) / 2), 2) + F.cos(a) * F.cos(c) * F.pow(F.sin((b - d) / 2), 2)
    return 2 * F.asin(F.sqrt(h))


# blocks: X of shape (m, d), Y of shape (n, d), both float64


def _over(x: np.ndarray, y: np.ndarray, f: Callable[[np.ndarray, np.ndarray], np.ndarray], limit: int = 131_072) -> np.ndarray:
    """f(x[:, None, :], y[None, :, :]) reduced over the last axis, in blocks of bounded memory."""
    out = np.empty((len(x), len(y)))
    step = max(1, limit // max(1, len(y) * x.shape[1]))
    wide = max(1, limit // max(1, x.shape[1]))
    for i in range(0, len(x), step):
        for j in range(0, len(y), wide):
            out[i : i + step, j : j + wide] = f(x[i : i + step, None, :], y[None, j : j + wide, :])
    return out


def _np_l2(x, y):
    out = np.maximum((x * x).sum(1)[:, None] + (y * y).sum(1)[None, :] - 2 * (x @ y.T), 0.0)
    # the expanded form cancels for near points; those few are computed again
    near = out < 1e-6 * ((x * x).sum(1)[:, None] + (y * y).sum(1)[None, :])
    i, j = np.nonzero(near)
    out[i, j] = ((x[i] - y[j]) ** 2).sum(1)
    return out


def _np_cosine(x, y):
    with np.errstate(divide="ignore", invalid="ignore"):
        return 1 - (x @ y.T) / (np.linalg.norm(x, axis=1)[:, None] * np.linalg.norm(y, axis=1)[None, :])


def _np_canberra(a, b):
    num, den = np.abs(a - b), np.abs(a) + np.abs(b)
    return np.where(den == 0, 0.0, num / np.where(den == 0, 1.0, den)).sum(-1)


def _np_correlation(x, y):
    k, sx, sy = x.shape[1], x.sum(1), y.sum(1)
    vx, vy = k * (x * x).sum(1) - sx * sx, k * (y * y).sum(1) - sy * sy
    with np.errstate(divide="ignore", invalid="ignore"):
        return 1 - (k * (x @ y.T) - sx[:, None] * sy[None, :]) / np.sqrt(vx[:, None] * vy[None, :])


def _np_log(v):
    return np.where(v == 0, 0.0, np.log(np.where(v == 0, 1.0, np.abs(v))))


def _np_js(x, y):
    """With t(v) = v log v: the sum of t(x) + t(y) - 2 t((x + y) / 2), so that a pair of components costs one logarithm."""
    tx, ty = (x * _np_log(x)).sum(1), (y * _np_log(y)).sum(1)
    tiny = np.finfo(float).tiny

    def joint(a, b):
        m = (a + b) * 0.5
        size = np.abs(m)
        np.log(np.maximum(size, tiny, out=size), out=size)
        size *= m
        return size.sum(-1)

    return np.sqrt(np.maximum(0.0, 0.5 * (tx[:, None] + ty[None, :]) - _over(x, y, joint)))


def _np_haversine(x, y):
    h = np.sin((x[:, None, 0] - y[None, :, 0]) / 2) ** 2 + np.cos(x[:, None, 0]) * np.cos(y[None, :, 0]) * np.sin((x[:, None, 1] - y[None, :, 1]) / 2) ** 2
    return 2 * np.arcsin(np.sqrt(h))


def _np_bits(x, y):
    return _over(x, y, lambda a, b: np.bitwise_count(a.astype(np.uint8) ^ b.astype(np.uint8)).sum(-1))


def _q(x: str, y: str, term: str) -> str:
    return f"list_sum(list_transform(list_zip({x}::DOUBLE[], {y}::DOUBLE[]), lambda p: {term}))"


def _q_dot(x: str, y: str) -> str:
    return _q(x, y, "p[1] * p[2]")


def _q_corr(x: str, y: str) -> str:
    k, sx, sy = f"len({x})", f"list_sum({x}::DOUBLE[])", f"list_sum({y}::DOUBLE[])"
    return f"(1 - ({k} * {_q_dot(x, y)} - {sx} * {sy}) / sqrt(({k} * {_q_dot(x, x)} - {sx} * {sx}) * ({k} * {_q_dot(y, y)} - {sy} * {sy})))"


def _q_log(v: str) -> str:
    return f"(CASE WHEN {v} = 0 THEN 0 ELSE ln(abs({v})) END)"


@dataclass(frozen=True)
class Metric:
    """One distance: expression(x, y, p), block(X, Y, p), sql(x, y, p); larger: larger is closer."""

    name: str
    expression: Callable[..., Column]
    block: Callable[..., np.ndarray]
    sql: Callable[..., str]
    larger: bool = False


def _metric(name, expression, block, sql, larger=False) -> Metric:
    return Metric(name, lambda x, y, p=2.0: expression(x, y, p), lambda x, y, p=2.0: block(x, y, p), lambda x, y, p=2.0: sql(x, y, p), larger)


_L2 = (lambda x, y, p: squared_l2(x, y), lambda x, y, p: _np_l2(x, y), lambda x, y, p: _q(x, y, "(p[1] - p[2]) * (p[1] - p[2])"))
_L2R = (lambda x, y, p: F.sqrt(squared_l2(x, y)), lambda x, y, p: np.sqrt(_np_l2(x, y)), lambda x, y, p: f"sqrt({_q(x, y, '(p[1] - p[2]) * (p[1] - p[2])')})")

METRICS = {
    m.name: m
    for m in (
        _metric("L2Expanded", *_L2),
        _metric("L2SqrtExpanded", *_L2R),
        _metric("L2Unexpanded", *_L2),
        _metric("L2SqrtUnexpanded", *_L2R),
        _metric("CosineExpanded", lambda x, y, p: _cosine(x, y), lambda x, y, p: _np_cosine(x, y), lambda x, y, p: f"(1 - {_q_dot(x, y)} / (sqrt({_q_dot(x, x)}) * sqrt({_q_dot(y, y)})))"),
        _metric("L1", lambda x, y, p: _zip(x, y, lambda a, b: F.abs(a - b)), lambda x, y, p: _over(x, y, lambda a, b: np.abs(a - b).sum(-1)), lambda x, y, p: _q(x, y, "abs(p[1] - p[2])")),
        _metric("InnerProduct", lambda x, y, p: dot(x, y), lambda x, y, p: x @ y.T, lambda x, y, p: _q_dot(x, y), True),
        _metric("Linf", lambda x, y, p: F.array_max(F.zip_with(x.cast(D), y.cast(D), lambda a, b: F.abs(a - b))), lambda x, y, p: _over(x, y, lambda a, b: np.abs(a - b).max(-1)), lambda x, y, p: _q(x, y, "abs(p[1] - p[2])").replace("list_sum", "list_max", 1)),
        _metric("Canberra", lambda x, y, p: _zip(x, y, lambda a, b: F.when(F.abs(a) + F.abs(b) == 0, 0.0).otherwise(F.try_divide(F.abs(a - b), F.abs(a) + F.abs(b)))), lambda x, y, p: _over(x, y, _np_canberra), lambda x, y, p: _q(x, y, "CASE WHEN abs(p[1]) + abs(p[2]) = 0 THEN 0 ELSE abs(p[1] - p[2]) / (abs(p[1]) + abs(p[2])) END")),
        _metric("LpUnexpanded", lambda x, y, p: F.pow(_zip(x, y, lambda a, b: F.pow(F.abs(a - b), F.lit(float(p)))), F.lit(1.0 / p)), lambda x, y, p: _over(x, y, lambda a, b: (np.abs(a - b) ** p).sum(-1)) ** (1 / p), lambda x, y, p: f"pow({_q(x, y, f'pow(abs(p[1] - p[2]), {p})')}, 1.0 / {p})"),
        _metric("CorrelationExpanded", lambda x, y, p: _correlation(x, y), lambda x, y, p: _np_correlation(x, y), lambda x, y, p: _q_corr(x, y)),
        _metric("HellingerExpanded", lambda x, y, p: F.sqrt(F.greatest(F.lit(0.0), 1 - _zip(x, y, lambda a, b: F.sqrt(a) * F.sqrt(b)))), lambda x, y, p: np.sqrt(np.maximum(0.0, 1 - np.sqrt(x) @ np.sqrt(y).T)), lambda x, y, p: f"sqrt(greatest(0.0, 1 - {_q(x, y, 'sqrt(p[1]) * sqrt(p[2])')}))"),
        _metric("Haversine", lambda x, y, p: _haversine(x, y), lambda x, y, p: _np_haversine(x, y), lambda x, y, p: f"(2 * asin(sqrt(pow(sin(({x}[1]::DOUBLE - {y}[1]::DOUBLE) / 2), 2) + cos({x}[1]::DOUBLE) * cos({y}[1]::DOUBLE) * pow(sin(({x}[2]::DOUBLE - {y}[2]::DOUBLE) / 2), 2))))"),
        _metric("JensenShannon", lambda x, y, p: F.sqrt(F.greatest(F.lit(0.0), _zip(x, y, _js_term) / 2)), lambda x, y, p: _np_js(x, y), lambda x, y, p: f"sqrt(greatest(0.0, 0.5 * {_q(x, y, f'-p[1] * ({_q_log("((p[1] + p[2]) / 2)")} - {_q_log("p[1]")}) - p[2] * ({_q_log("((p[1] + p[2]) / 2)")} - {_q_log("p[2]")})')}))"),
        _metric("HammingUnexpanded", lambda x, y, p: _zip(x, y, lambda a, b: (a != b).cast("double")) / F.size(x), lambda x, y, p: _over(x, y, lambda a, b: (a != b).mean(-1)), lambda x, y, p: f"({_q(x, y, '(p[1] <> p[2])::INT')}::DOUBLE / len({x}))"),
        _metric("KLDivergence", lambda x, y, p: _zip(x, y, lambda a, b: a * (_zero_log(a) - _zero_log(b))) / 2, lambda x, y, p: _over(x, y, lambda a, b: 0.5 * (a * (_np_log(a) - _np_log(b))).sum(-1)), lambda x, y, p: f"(0.5 * {_q(x, y, f'p[1] * ({_q_log("p[1]")} - {_q_log("p[2]")})')})"),
        _metric("RusselRaoExpanded", lambda x, y, p: (F.size(x) - dot(x, y)) / F.size(x), lambda x, y, p: (x.shape[1] - x @ y.T) / x.shape[1], lambda x, y, p: f"((len({x}) - {_q_dot(x, y)}) / len({x}))"),
        _metric("BitwiseHamming", lambda x, y, p: _sum(F.zip_with(x.cast("array<int>"), y.cast("array<int>"), lambda a, b: F.bit_count(a.bitwiseXOR(b)).cast("double"))), lambda x, y, p: _np_bits(x, y), lambda x, y, p: f"list_sum(list_transform(list_zip({x}::INT[], {y}::INT[]), lambda p: bit_count(xor(p[1], p[2]))))::DOUBLE"),
    )
}

ALIASES = {
    "euclidean": "L2SqrtExpanded",
    "l2": "L2SqrtExpanded",
    "sqeuclidean": "L2Expanded",
    "cosine": "CosineExpanded",
    "l1": "L1",
    "cityblock": "L1",
    "manhattan": "L1",
    "inner_product": "InnerProduct",
    "chebyshev": "Linf",
    "linf": "Linf",
    "canberra": "Canberra",
    "minkowski": "LpUnexpanded",
    "lp": "LpUnexpanded",
    "correlation": "CorrelationExpanded",
    "hellinger": "HellingerExpanded",
    "haversine": "Haversine",
    "jensenshannon": "JensenShannon",
    "hamming": "HammingUnexpanded",
    "kl_divergence": "KLDivergence",
    "russellrao": "RusselRaoExpanded",
    "bitwise_hamming": "BitwiseHamming",
    "jaccard": "JaccardExpanded",
    "dice": "DiceExpanded",
    "braycurtis": "BrayCurtis",
}
SPARSE_ONLY = ("JaccardExpanded", "DiceExpanded")


def resolve(metric: str) -> Metric:
    """The metric of a name or alias; ValueError for those that have no dense form."""
    name = ALIASES.get(metric, metric)
    if name not in METRICS:
        raise ValueError(f"metric {metric!r} is not supported for dense vectors" + (", only for sparse ones" if name in SPARSE_ONLY else ""))
    return METRICS[name]


def distance(metric: str, x: Column | str, y: Column | str, p: float = 2.0) -> Column:
    """Distance of two array columns."""
    x, y = (F.col(c) if isinstance(c, str) else c for c in (x, y))
    return resolve(metric).expression(x, y, p)


KERNELS = ("linear", "polynomial", "tanh", "rbf")


def gram(kernel: str, x: Column, y: Column, gain: float = 1.0, offset: float = 0.0, exponent: int = 3) -> Column:
    """Kernel value of two array columns."""
    if kernel == "linear":
        return dot(x, y)
    if kernel == "polynomial":
        return F.pow(gain * dot(x, y) + offset, F.lit(float(exponent)))
    if kernel == "tanh":
        return F.tanh(gain * dot(x, y) + offset)
    if kernel == "rbf":
        return F.exp(-gain * squared_l2(x, y))
    raise ValueError(f"kernel {kernel!r} is not one of {KERNELS}")


def register_sql_functions(spark, prefix: str = "vl_") -> list[str]:
    """SQL functions <prefix><alias>(x, y) for the metrics that SQL can state in one expression."""
    bodies = {
        "sqeuclidean": "aggregate(zip_with(x, y, (a, b) -> (a - b) * (a - b)), 0D, (s, v) -> s + v)",
        "euclidean": "sqrt(aggregate(zip_with(x, y, (a, b) -> (a - b) * (a - b)), 0D, (s, v) -> s + v))",
        "inner_product": "aggregate(zip_with(x, y, (a, b) -> a * b), 0D, (s, v) -> s + v)",
        "cityblock": "aggregate(zip_with(x, y, (a, b) -> abs(a - b)), 0D, (s, v) -> s + v)",
        "chebyshev": "array_max(zip_with(x, y, (a, b) -> abs(a - b)))",
        "hamming": "aggregate(zip_with(x, y, (a, b) -> CAST(a <> b AS DOUBLE)), 0D, (s, v) -> s + v) / size(x)",
    }
    for name, body in bodies.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {prefix}{name}(x ARRAY<DOUBLE>, y ARRAY<DOUBLE>) RETURNS DOUBLE RETURN {body}")
    return [prefix + n for n in bodies]
