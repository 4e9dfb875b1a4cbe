"""Quality rules with robust multivariate outliers, with DataFrame functions only.

Every text gets a few counts. Texts that fail the base rules are rejected; of the others, a vector of
transformed counts is compared with the others of its language and source by the minimum covariance
determinant: of several starts (marginal spreads, covariance of squashed values, covariance of directions)
concentration steps keep the SUPPORT share of vectors nearest by Mahalanobis distance and estimate mean and
covariance from them; the start with the least determinant goes on until the determinant falls no more. The
covariance is made consistent by the chi-square law, estimated once more from the vectors within its REWEIGHT
quantile, and vectors beyond its CUTOFF quantile are rejected.

The same is done for every language and for all texts. The estimate of n texts counts n / (n + SHRINK) against
the one above it (source, language, all), whatever n is, so a small group leans on its language without a
switch. RESOLUTION is the variance that counting alone gives a feature (one more symbol or repeated word
in a short text); it is added to every covariance, which keeps groups of equal texts regular.

Estimates are rows of a table, joined by group, by broadcast if a count finds at most MAX_BROADCAST_GROUPS
groups, salted otherwise, so that rows of a large group stay where they are; nothing but sums and sketches is gathered
per group, however large it is. Quantiles have a rank error below 1 / ACCURACY; they are exact for groups below half of it.

Null texts have no words and fail; empty ones as well; null lang or source form groups of their own; texts of
any length count whole; equal distances are on the same side of every bound; repeated rows are rows like others.
Columns to keep may have any name but those of the results (ValueError). An empty table gives an empty result.
"""

from __future__ import annotations

from math import exp, factorial

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vectorloom.llm.common import table
from vectorloom.runtime import cut_lineage, fits

SUPPORT, REWEIGHT, CUTOFF = 0.75, 0.975, 0.9999
SHRINK = 100.0
TOLERANCE = 1e-3
ACCURACY = 5000
MAX_BROADCAST_GROUPS = 10_000
SALTS = 64
#: Standard deviation of a feature that counting alone explains.
RESOLUTION = {"x0": 0.25, "x1": 0.1, "x2": 0.1, "x3": 0.06, "x4": 0.05, "x5": 0.02}
XS = list(RESOLUTION)
N = len(XS)
PAIRS = [(i, j) for i in range(N) for j in range(i + 1)]
MEANS, COVS, INVERSE = [f"m{i}" for i in range(N)], [f"c{i}_{j}" for i, j in PAIRS], [f"p{i}_{j}" for i, j in PAIRS]
SPACE = r"[\x20\x09-\x0D]"
COUNTS = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_upper")


def chi_square(x: float, dof: int) -> float:
    """Distribution function of the chi-square law for an even number of degrees."""
    return 1 - exp(-x / 2) * sum((x / 2) ** i / factorial(i) for i in range(dof // 2))


def chi_square_quantile(p: float, dof: int) -> float:
    low, high = 0.0, 1000.0
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if chi_square(mid, dof) < p else (low, mid)
    return (low + high) / 2


def consistency(share: float) -> float:
    """What the covariance of the share of normal vectors nearest to the mean falls short by."""
    return share / chi_square(chi_square_quantile(share, N), N + 2)


def text_stats(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", keep: tuple[str, ...] = ()) -> DataFrame:
    """kept (a struct of the columns in keep), lang, source and COUNTS of every row."""
    held = F.struct(*(F.col(c) for c in keep)) if keep else F.struct(F.lit(0).alias("none"))
    t = F.coalesce(F.col(text).cast("string"), F.lit(""))
    keep = ("kept", "lang", "source")
    step = docs.select(held.alias("kept"), F.col(lang).cast("string").alias("lang"), F.col(source).cast("string").alias("source"), t.alias("__t"))
    step = step.select(*keep, "__t", F.filter(F.split("__t", SPACE + "+", -1), lambda w: w != "").alias("__w"))
    t, w = F.col("__t"), F.col("__w")
    bare = t
    for c in " \t\n\x0b\x0c\r":
        bare = F.replace(bare, F.lit(c), F.lit(""))
    lines = F.filter(F.split(t, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    n = F.size(w)
    window = F.when(n < 3, F.array().cast("array<bigint>")).otherwise(F.transform(F.sequence(F.lit(0), F.greatest(n - 3, F.lit(0))), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2))))
    step = step.select(
        *keep,
        n.cast("long").alias("n_words"),
        F.length(bare).cast("long").alias("word_chars"),
        F.length(F.regexp_replace(t, r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        F.length(F.regexp_replace(t, r"[^A-Z]+", "")).cast("long").alias("n_upper"),
        lines.alias("__l"),
        window.alias("__g"),
    )
    step = step.select(*(c for c in step.columns if c[:2] != "__"), F.size("__l").cast("long").alias("n_lines"), (F.size("__l") - F.size(F.array_distinct("__l"))).cast("long").alias("n_dup_lines"), "__g", F.size(F.array_distinct("__g")).alias("__u"))
    g = F.col("__g")
    order = F.array_sort(F.transform(g, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    step = step.withColumn("__s", F.when(F.col("__u") < F.size(g), order))
    s = F.col("__s")
    twice = F.filter(F.transform(s, lambda x, i: F.when((F.get(s, i - 1)["h"] == x["h"]) | (F.get(s, i + 1)["h"] == x["h"]), x["i"])), lambda x: x.isNotNull())
    step = step.withColumn("__p", F.sort_array(twice))
    covered = F.aggregate(F.col("__p"), F.struct(F.lit(-3).alias("last"), F.lit(0).alias("n")), lambda a, p: F.struct(p.alias("last"), (a["n"] + F.least(F.lit(3), p - a["last"])).alias("n")), lambda a: a["n"])
    return step.withColumn("n_repeat_words", F.when(s.isNull(), 0).otherwise(covered).cast("long")).drop("__g", "__u", "__s", "__p")


def _features() -> dict[str, Column]:
    n, lines, chars = (F.greatest(F.col(c), F.lit(1)).cast("double") for c in ("n_words", "n_lines", "word_chars"))
    return {
        "x0": F.log(n),
        "x1": F.col("word_chars") / n,
        "x2": F.sqrt(F.col("n_symbols") / n),
        "x3": F.col("n_dup_lines") / (lines + 10),
        "x4": F.col("n_repeat_words") / (n + 100),
        "x5": F.col("n_upper") / chars,
    }


def _key(*parts: str) -> Column:
    """One string for some columns, distinct for distinct values; null is a value of its own."""
    return F.concat(*(F.coalesce(F.concat(F.length(c).cast("string"), F.lit(":"), F.col(c)), F.lit("-")) for c in parts))


def _at(name: str, i: int, j: int) -> str:
    return f"{name}{max(i, j)}_{min(i, j)}"


def _inverted(estimates: DataFrame, scale: float = 1.0) -> DataFrame:
    """estimates with p_i_j, the negative inverse of scale * c_i_j plus the resolution, by sweeps, and the log-determinant ld."""
    rest = estimates.columns
    whole = [f"c{i}_{j} * {scale!r}D + {RESOLUTION[XS[i]] ** 2 if i == j else 0.0!r}D AS p{i}_{j}" for i, j in PAIRS]
    out = estimates.selectExpr(*(f"`{c}`" for c in rest), *whole, "0D AS ld")
    for k in range(N):
        swept = []
        for i, j in PAIRS:
            if i == j == k:
                new = f"-1 / p{k}_{k}"
            elif k in (i, j):
                new = f"p{i}_{j} / p{k}_{k}"
            else:
                new = f"p{i}_{j} - {_at('p', i, k)} * {_at('p', j, k)} / p{k}_{k}"
            swept.append(f"{new} AS p{i}_{j}")
        out = out.selectExpr(*(f"`{c}`" for c in rest), *swept, f"ld + ln(p{k}_{k}) AS ld")
    return out


class _Join:
    """Rows meet the estimates of their group: by broadcast where there are few groups, else over salted keys."""

    def __init__(self, few: bool):
        self.few = few

    def __call__(self, rows: DataFrame, estimates: DataFrame) -> DataFrame:
        if self.few:
            return rows.join(F.broadcast(estimates), "g")
        salted = rows.withColumn("salt", F.pmod(F.xxhash64(*XS), F.lit(SALTS)))
        return salted.join(estimates.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), ["g", "salt"]).drop("salt")

    def distances(self, rows: DataFrame, estimates: DataFrame, *keep: str) -> DataFrame:
        """rows with v_i, their difference to the mean of their group, d2, the squared Mahalanobis distance, and some columns of the estimates."""
        met = self(rows, estimates.select("g", *keep, *MEANS, *INVERSE))
        names = [f"`{c}`" for c in (*rows.columns, *keep)]
        apart = met.selectExpr(*names, *INVERSE, *(f"{x} - m{i} AS v{i}" for i, x in enumerate(XS)))
        d2 = " + ".join(f"{1 if i == j else 2} * p{i}_{j} * v{i} * v{j}" for i, j in PAIRS)
        return apart.selectExpr(*names, *(f"v{i}" for i in range(N)), f"-({d2}) AS d2")


def _moments(near: DataFrame, estimates: DataFrame, *by: str) -> DataFrame:
    """(by, n, m_i, c_i_j) of some of the rows that distances() gave for estimates."""
    sums = near.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), *(F.avg(f"v{i}").alias(f"a{i}") for i in range(N)), *(F.expr(f"avg(v{i} * v{j}) AS q{i}_{j}") for i, j in PAIRS))
    return sums.join(estimates.select(*by, *MEANS), list(by)).selectExpr(*by, "n", *(f"m{i} + a{i} AS m{i}" for i in range(N)), *(f"q{i}_{j} - a{i} * a{j} AS c{i}_{j}" for i, j in PAIRS))


def _starts(rows: DataFrame, join: _Join) -> DataFrame:
    """(g, s, m_i, c_i_j, p_i_j, ld): per group three first estimates about the medians."""
    center = rows.groupBy("g").agg(*(F.percentile_approx(x, [0.16, 0.5, 0.84], ACCURACY).alias(f"p{i}") for i, x in enumerate(XS)))
    center = center.selectExpr("g", *(f"p{i}[1] AS m{i}" for i in range(N)), *(f"pow((p{i}[2] - p{i}[0]) / 2, 2) AS w{i}" for i in range(N)))
    center = cut_lineage(center.selectExpr("*", *(f"sqrt(w{i} + {RESOLUTION[x] ** 2!r}D) AS s{i}" for i, x in enumerate(XS))))
    near = join(rows, center).selectExpr("g", *(f"({x} - m{i}) / s{i} AS z{i}" for i, x in enumerate(XS)))
    near = near.selectExpr("*", f"greatest({' + '.join(f'z{i} * z{i}' for i in range(N))}, 1e-24D) AS norm", *(f"tanh(z{i}) AS h{i}" for i in range(N)))
    sums = [F.expr(f"avg(h{i}) AS a{i}") for i in range(N)]
    sums += [F.expr(f"avg(h{i} * h{j}) AS h{i}_{j}") for i, j in PAIRS] + [F.expr(f"avg(z{i} * z{j} / norm) AS u{i}_{j}") for i, j in PAIRS]
    both = center.join(near.groupBy("g").agg(*sums), "g")
    first = {
        0: [f"{f'w{i}' if i == j else '0D'} AS c{i}_{j}" for i, j in PAIRS],
        1: [f"(h{i}_{j} - a{i} * a{j}) * s{i} * s{j} AS c{i}_{j}" for i, j in PAIRS],
        2: [f"u{i}_{j} * s{i} * s{j} * {N} AS c{i}_{j}" for i, j in PAIRS],
    }
    each = ", ".join(f"struct({s} AS s, {', '.join(covs)})" for s, covs in first.items())
    return cut_lineage(_inverted(both.selectExpr("g", *MEANS, f"explode(array({each})) AS e").select("g", *MEANS, "e.*")))


def _concentrated(rows: DataFrame, estimates: DataFrame, join: _Join) -> DataFrame:
    """One concentration step: estimates from the SUPPORT share of each group that is nearest by those given."""
    near = join.distances(rows, estimates, "s")
    bound = near.groupBy("g", "s").agg(F.percentile_approx("d2", SUPPORT, ACCURACY).alias("bound"))
    limited = cut_lineage(estimates.join(bound, ["g", "s"]))
    return cut_lineage(_inverted(_moments(join.distances(rows, limited, "s", "bound").where("d2 <= bound"), limited, "g", "s")))


def least_determinant(rows: DataFrame, join: _Join) -> DataFrame:
    """(g, n, m_i, c_i_j): the reweighted minimum-covariance-determinant estimate of every group of rows (g, x_i)."""
    now = _starts(rows, join)
    for _ in range(2):
        now = _concentrated(rows, now, join)
    best = now.groupBy("g").agg(F.min(F.struct(F.round("ld", 9).alias("ld"), "s")).alias("m")).select("g", F.col("m.s").alias("s"))
    live, done = cut_lineage(now.join(best, ["g", "s"])), []
    while True:
        # a group goes on while its determinant falls by more than TOLERANCE, so this ends
        then = _concentrated(rows, live, join)
        both = then.join(live.select("g", F.col("ld").alias("was")), "g")
        falls = F.col("was") - F.col("ld") > TOLERANCE
        done.append(live.join(both.where(falls).select("g"), "g", "left_anti").select("g", *MEANS, *COVS))
        live = cut_lineage(both.where(falls).select("g", "s", *MEANS, *COVS, *INVERSE, "ld"))
        if live.isEmpty():
            break
    raw = done[0]
    for more in done[1:]:
        raw = raw.unionByName(more)
    wide = cut_lineage(_inverted(raw, consistency(SUPPORT)))
    inside = join.distances(rows, wide).where(F.col("d2") <= chi_square_quantile(REWEIGHT, N))
    return cut_lineage(_moments(inside, wide, "g"))


def _shrunk(groups: DataFrame, estimates: DataFrame) -> DataFrame:
    """(g, m_i, p_i_j) of every group of language and source, leaning on its language and that on all texts."""
    scale = {**dict.fromkeys(MEANS, 1.0), **dict.fromkeys(COVS, consistency(REWEIGHT))}
    out = groups
    for level in ("all", "of_lang", "g"):
        own = estimates.selectExpr(f"g AS `{level}`", "n", *(f"{c} * {f!r}D AS own_{c}" for c, f in scale.items()))
        mixed = [f"own_{c} AS {c}" if level == "all" else f"coalesce((n * own_{c} + {SHRINK!r}D * {c}) / (n + {SHRINK!r}D), {c}) AS {c}" for c in scale]
        out = out.join(own, level, "left").selectExpr("g", "of_lang", "all", *mixed)
    return cut_lineage(_inverted(out.drop("of_lang", "all")))


def outlier_distances(stats: DataFrame) -> DataFrame:
    """stats (lang, source, COUNTS, ...) with d2, the squared robust distance of each row's features to its group; stats should be cut from its lineage."""
    names = {"all": F.lit("*"), "of_lang": F.concat(F.lit("l"), _key("lang")), "g": F.concat(F.lit("s"), _key("lang", "source"))}
    rows = stats.withColumns({**_features(), **names})
    groups = cut_lineage(rows.groupBy("g", "of_lang", "all").agg(F.count(F.lit(1)).alias("size")).drop("size"))
    join = _Join(fits(groups, MAX_BROADCAST_GROUPS))
    leveled = rows.select(F.explode(F.array("all", "of_lang", "g")).alias("g"), *XS)
    estimates = _shrunk(groups, least_determinant(leveled, join))
    return join.distances(rows.drop("all", "of_lang"), estimates).drop("g", *XS, *(f"v{i}" for i in range(N)))


def judge(docs: DataFrame, keep: tuple[str, ...] = ("doc_id", "lang", "source"), text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """The columns in keep, the counts, base_failed, kept and d2 (null if base_failed) of every row."""
    results = (*COUNTS, "base_failed", "kept", "d2")
    if clash := {c.lower() for c in keep} & set(results):
        raise ValueError(f"columns of the results cannot be kept: {sorted(clash)}")
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    marked = cut_lineage(text_stats(docs, text, lang, source, keep)).withColumn("base_failed", failed)
    judged = outlier_distances(marked.where(~F.col("base_failed")))
    rest = marked.where("base_failed").withColumn("d2", F.lit(None).cast("double"))
    near = F.coalesce(F.col("d2") <= chi_square_quantile(CUTOFF, N), F.lit(False))
    held = [F.col("kept")[c].alias(c) for c in keep]
    return judged.unionByName(rest).select(*held, *COUNTS, "base_failed", near.alias("kept"), "d2")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract of op10: doc_id, the counts, base_failed, kept (and d2)."""
    out = judge(table(spark, sf_dir, "documents"), keep=("doc_id",))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "d2")
